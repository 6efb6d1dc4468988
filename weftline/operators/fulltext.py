"""English full-text search: a query language over stems with positions, ranks, headlines.

A query is an expression of words with ``&``, ``|``, ``!``, ``<->`` or ``<n>`` (followed by, n words on), brackets, and ``:*``
behind a word for a beginning. Only the words of the texts that a query can match are gathered with their positions; the
expression is evaluated on these by native expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.english import lexeme
from weftline.operators.search import TOKEN, tokens
from weftline.sources.folders import stored

_PARTS = re.compile(r"\s*(?:(<->|<\d+>|[&|!()])|([^\s&|!()<>:]+)(:\*)?)|\s*(\S)")


class Term(NamedTuple):
    lexeme: str
    prefix: bool = False


class Node(NamedTuple):
    """op is and, or, not or phrase; a phrase has the distance of its second operand from its first."""

    op: str
    parts: tuple
    distance: int = 1


Tree = Term | Node | None


def parse(query: str) -> Tree:
    """The expression tree of a query; null where only stop words are left.

    Stop words vanish with their operator; in a phrase they widen its distance. ``!`` binds closest, then phrases, ``&``,
    ``|``. Operands of a phrase are words or phrases. Raises ValueError where the query is malformed.
    """
    items = []
    for operator, word, prefix, odd in _PARTS.findall(query):
        if odd:
            raise ValueError(f"unexpected {odd!r}")
        if operator:
            items.append(operator)
        elif word:
            found = re.findall(TOKEN, word.lower())
            if not found:
                continue
            for k, w in enumerate(found):
                items += (["<->"] if k else []) + [(w, bool(prefix) and k == len(found) - 1)]
    at = 0

    def peek():
        return items[at] if at < len(items) else None

    def take():
        nonlocal at
        at += 1
        return items[at - 1]

    def atom():
        token = peek()
        if token == "!":
            take()
            inner = atom()
            return Node("not", (inner,)) if inner else None
        if token == "(":
            take()
            inner = either()
            if peek() != ")":
                raise ValueError("a bracket is not closed")
            take()
            return inner
        if not isinstance(token, tuple):
            raise ValueError(f"a word is missing before {token!r}")
        take()
        own = lexeme(token[0])
        return Term(own, token[1]) if own is not None else None

    def phrase():
        left, gap = atom(), 0
        while isinstance(peek(), str) and peek().startswith("<"):
            sign = take()
            gap += 1 if sign == "<->" else int(sign[1:-1])
            right = atom()
            for side in (left, right):
                if isinstance(side, Node) and side.op != "phrase":
                    raise ValueError("operands of a phrase are words or phrases")
            if right is None:
                continue
            left, gap = (Node("phrase", (left, right), gap), 0) if left else (right, 0)
        return left

    def joined(own, sign, op):
        parts = [own()]
        while peek() == sign:
            take()
            parts.append(own())
        parts = [p for p in parts if p is not None]
        return Node(op, tuple(parts)) if len(parts) > 1 else parts[0] if parts else None

    def every():
        return joined(phrase, "&", "and")

    def either():
        return joined(every, "|", "or")

    if not items:
        return None
    out = either()
    if at < len(items):
        raise ValueError(f"unexpected {peek()!r}")
    return out


def all_words(text: str) -> Tree:
    """A query of all words of a plain text."""
    found = list(dict.fromkeys(x for w in re.findall(TOKEN, text.lower()) if (x := lexeme(w)) is not None))
    parts = tuple(Term(x) for x in found)
    return Node("and", parts) if len(parts) > 1 else parts[0] if parts else None


def beginnings(text: str) -> Tree:
    """A query of the beginnings of all words of a plain text, as a search box sends it."""
    words = [w for w in (re.sub(r"[^\w-]", "", t) for t in text.split()) if w]
    return parse(" & ".join(f"{w}:*" for w in words)) if words else None


def leaves(tree: Tree) -> list[Term]:
    """The distinct terms of a tree in order."""
    if tree is None:
        return []
    return [tree] if isinstance(tree, Term) else list(dict.fromkeys(t for p in tree.parts for t in leaves(p)))


def holds(tree: Tree, places: dict[Term, Column]) -> Column:
    """Whether the tree matches, from an array of positions for each term."""
    if isinstance(tree, Term):
        return F.size(places[tree]) > 0
    if tree.op == "phrase":
        return F.size(_ends(tree, places)) > 0
    parts = [holds(p, places) for p in tree.parts]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if tree.op == "and" else out | p
    return ~out if tree.op == "not" else out


def _ends(tree: Tree, places: dict[Term, Column]) -> Column:
    """Positions at which a match of a word or phrase ends; a second operand that is a phrase begins at its own first word."""
    if isinstance(tree, Term):
        return places[tree]
    gap = tree.distance + _length(tree.parts[1])
    return F.array_intersect(F.transform(_ends(tree.parts[0], places), lambda x: x + gap), _ends(tree.parts[1], places))


def _length(tree: Tree) -> int:
    """Words from the first to the last of a phrase."""
    return 0 if isinstance(tree, Term) else _length(tree.parts[0]) + tree.distance + _length(tree.parts[1])


def matched(tree: Tree, present: dict[Term, list[int]]) -> bool:
    """The same on plain lists."""

    def ends(t):
        if isinstance(t, Term):
            return set(present[t])
        gap = t.distance + _length(t.parts[1])
        return {x + gap for x in ends(t.parts[0])} & ends(t.parts[1])

    if tree is None:
        return False
    if isinstance(tree, Term):
        return bool(present[tree])
    if tree.op == "phrase":
        return bool(ends(tree))
    values = [matched(p, present) for p in tree.parts]
    return not values[0] if tree.op == "not" else all(values) if tree.op == "and" else any(values)


def surfaces(words: DataFrame, tree: Tree) -> DataFrame:
    """(word, leaf): the words of a table of distinct ``word`` that a term of the tree can match, with the terms' numbers."""
    terms = leaves(tree)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(w, k) for w in batch.column(0).to_pylist() if (x := lexeme(w)) is not None for k, t in enumerate(terms) if (x.startswith(t.lexeme) if t.prefix else x == t.lexeme)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([k for _, k in out], pa.int32())], ["word", "leaf"])

    return words.select("word").mapInArrow(find, "word string, leaf int")


def postings(docs: DataFrame, tree: Tree, id_col: str, text_col: str) -> DataFrame:
    """(id, places): for each text with one of the tree's terms an array of sorted positions (from 1) for each term.

    Distinct words are stemmed once, then only those that match are gathered; positions count all words, stop words too.
    """
    terms = leaves(tree)
    words = docs.select(F.col(id_col).alias("id"), F.posexplode(tokens(F.col(text_col))).alias("at", "word"))
    distinct = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("word")).distinct()
    known = stored(surfaces(distinct, tree), "surfaces")  # its size is known then, so the words of all texts need no shuffle
    hits = words.join(known, "word").groupBy("id", "leaf").agg(F.array_sort(F.collect_list(F.col("at") + 1)).alias("at"))
    none = F.array().cast("array<int>")
    own = [F.coalesce(F.max(F.when(F.col("leaf") == k, F.col("at"))), none) for k in range(len(terms))]
    return hits.groupBy("id").agg(F.array(*own).alias("places"))


def rank(tree: Tree, places: list[list[int]], weight: float = 0.1) -> float:
    """The usual text rank of a match: pairs of terms near each other where all are asked for, else repeats, each less than the last.

    A term's occurrences add weight / k**2, over the sum of all such. With ``&`` or a phrase on top and two terms or more,
    pairs of positions add the root of the weights times a factor that falls with their distance; sums never pass 1.
    """
    terms = leaves(tree)
    if not terms:
        return 0.0
    if isinstance(tree, Node) and tree.op in ("and", "phrase") and len(terms) > 1:
        rest, found = 1.0, False
        at = [np.array(p) for p in places]
        for i in range(len(terms)):
            for k in range(i):
                gap = np.abs(at[i][:, None] - at[k][None, :]).ravel() if len(at[i]) and len(at[k]) else np.zeros(0)
                gap = gap[gap > 0]
                near = np.where(gap > 100, 1e-30, 1 / (1.005 + 0.05 * np.exp(np.minimum(gap, 100) / 1.5 - 2)))
                rest *= float(np.prod(1 - weight * np.sqrt(near)))
                found = found or len(gap) > 0
        return 1 - rest if found else 1e-20
    return sum(sum(weight / (j + 1) ** 2 for j in range(len(p))) / 1.64493406685 for p in places) / len(terms)


def search(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, places) of the texts that match; none for an empty tree. Ids are unique; null texts match nothing but negations."""
    if tree is None:
        return docs.sparkSession.createDataFrame([], f"{id_col} {docs.schema[id_col].dataType.simpleString()}, rank double, places array<array<int>>")
    terms = leaves(tree)
    found = postings(docs, tree, id_col, text_col)
    if matched(tree, {t: [] for t in terms}):  # texts without any of the terms match as well
        none = F.array(*[F.array().cast("array<int>") for _ in terms])
        found = docs.select(F.col(id_col).alias("id")).join(found, "id", "left").withColumn("places", F.coalesce("places", none))
    hit = found.where(holds(tree, {t: F.col("places")[k] for k, t in enumerate(terms)}))

    @F.pandas_udf("double")
    def ranked(places: pd.Series) -> pd.Series:
        return places.map(lambda p: rank(tree, [list(x) for x in p]))

    return hit.select(F.col("id").alias(id_col), ranked("places").alias("rank"), "places")


def best_window(places: list[list[int]], most: int) -> tuple[int, int]:
    """The shortest stretch of at most ``most`` words that holds the most distinct terms, the first of equals, as (first, last) positions."""
    events = sorted((p, k) for k, own in enumerate(places) for p in own)
    if not events:
        return 1, 0
    best, inside, low = None, {}, 0
    for high, (p, k) in enumerate(events):
        inside[k] = inside.get(k, 0) + 1
        while p - events[low][0] >= most or inside[events[low][1]] > 1:
            inside[events[low][1]] -= 1
            if not inside[events[low][1]]:
                del inside[events[low][1]]
            low += 1
        score = (-len(inside), p - events[low][0], events[low][0])
        if best is None or score < best[0]:
            best = (score, events[low][0], p)
    return best[1], best[2]


def fragment(text: str, places: list[list[int]], most: int = 30, start: str = "<b>", stop: str = "</b>") -> str:
    """Up to ``most`` words about the best window, widened to both sides, with the matched words marked."""
    spans = [m.span() for m in re.finditer(TOKEN, text)]
    first, last = best_window(places, most)
    if last < first:
        first = last = 1
    while last - first + 1 < min(most, len(spans)):
        if first > 1:
            first -= 1
        if last < len(spans) and last - first + 1 < most:
            last += 1
    hits = {p for own in places for p in own}
    out, at = [], spans[first - 1][0] if spans else 0
    for p in range(first, min(last, len(spans)) + 1):
        a, b = spans[p - 1]
        out.append(text[at:a] + (f"{start}{text[a:b]}{stop}" if p in hits else text[a:b]))
        at = b
    return re.sub(r"\s+", " ", "".join(out))


def headlines(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 30) -> DataFrame:
    """``found`` of ``search`` with a ``fragment`` of each text; only the texts that were found are read again into the join."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([fragment(t or "", [list(x) for x in p], most) for t, p in zip(text, places, strict=True)], dtype=object)

    return found.join(docs.select(id_col, F.col(text_col).alias("_text")), id_col).withColumn("fragment", cut("_text", "places")).drop("_text")
