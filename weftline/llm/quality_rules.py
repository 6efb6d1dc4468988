"""Quality statistics of texts, and decision lists over them learned by sequential covering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import textkernel as K
from weftline.llm.shared import labelled_texts, row_type, with_row

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_stops", "n_lines")

_SYMBOL, _UPPER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_MARK[[ord(c) for c in "!?;:\"'()[]{}=_+~^@/\\"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True

def features() -> dict[str, Column]:
    """The features as Spark expressions over ``COUNTS``; 0 where a text has no words."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    pairs = {"mean_word_chars": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "word_chars")}
    pairs |= {"digit_share": ("n_digits", "word_chars"), "marks_per_word": ("n_marks", "n_words"), "words_per_line": ("n_words", "n_lines")}
    per_stop = F.col("n_words") / (F.col("n_stops") + 1).cast("double")
    return {"n_words": F.col("n_words").cast("double"), "words_per_stop": per_stop, **{k: ratio(*v) for k, v in pairs.items()}}


def text_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The ``COUNTS`` of a chunk's rows."""
    rows = len(offsets) - 1
    w = K.words(data, offsets, K.SPACE)
    total = lambda mask: K.sums_by_row(mask.astype(np.int64), offsets)
    inside = ~K.SPACE[data]
    newline = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    start = start[start < len(data)] if len(data) else start[:0]
    row = np.searchsorted(offsets, start, "right") - 1
    stop = np.append(start[1:], len(data))
    content = stop - ((stop > start) & (data[np.maximum(stop - 1, 0)] == 0x0A)) if len(data) else stop
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=filled[1:])
    has = filled[content] > filled[start]
    line, line_row = K.span_hashes(data, start[has], content[has]), row[has]
    n_lines = np.bincount(line_row, minlength=rows)
    pairs = np.unique(np.stack([line_row.astype(np.uint64), line], 1), axis=0) if len(line) else np.zeros((0, 2), np.uint64)
    n_dup = n_lines - np.bincount(pairs[:, 0].astype(np.int64), minlength=rows)
    hashes, at = K.windows(w.hashes, w.first, 5)
    order = K._sort_within(hashes, w.row[at]) if len(at) else np.zeros(0, np.int64)
    h, r = hashes[order], w.row[at][order]
    same = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(w.hashes) + 1, np.int64)
    begins = at[order[twice]]
    np.add.at(cover, begins, 1)
    np.add.at(cover, begins + 5, -1)
    n_repeat = K.sums_by_row((np.cumsum(cover)[:-1] > 0).astype(np.int64), w.first)
    n_stops = K.sums_by_row(_STOP[data[w.end - 1]].astype(np.int64), w.first) if len(w.end) else np.zeros(rows, np.int64)
    word_chars = total(inside & ((data & 0xC0) != 0x80))
    return [np.diff(w.first), word_chars, total(_SYMBOL[data]), n_dup, n_repeat, total(_UPPER[data]), total(_DIGIT[data]), total(_MARK[data]), n_stops, n_lines]


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns in a struct ``row`` with the ``COUNTS`` of each whole text.

    Words are runs without white space (space, U+0009 to U+000D). word_chars: code points in words; n_symbols:
    characters of ``#*$%&|<>``; n_dup_lines: lines with a word equal to an earlier line; n_repeat_words: words in
    5-word windows that occur twice or more in the text, the first occurrence included. Null and empty texts count 0.
    """
    carried = with_row(docs, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                values = text_counts(c.data, c.offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0)[c.rows], *(pa.array(v.astype(np.int64)) for v in values)], ["row", *COUNTS])

    return carried.mapInArrow(count, f"row {row_type(carried)}, " + ", ".join(f"{c} long" for c in COUNTS))


class Condition(NamedTuple):
    feature: str
    above: bool  # feature >= threshold, else feature < threshold
    threshold: float


Rule = list[Condition]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return reduce(np.logical_and, [(x[c.feature] >= c.threshold) if c.above else (x[c.feature] < c.threshold) for c in rule])


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 24, most_conditions: int = 4, precision: float = 0.9, least: int = 5, seed: int = 5) -> list[Rule]:
    """An ordered list of rules for ``bad`` rows by sequential covering.

    Each round splits the rows that no rule covers into a growing and a pruning part. Conditions are added by the
    largest information gain until no good rows are covered, then the last ones are cut while that raises the rule's
    precision on the pruning part. A rule stays if it covers ``least`` rows at ``precision`` or better; the first that
    does not ends the list.
    """
    rules: list[Rule] = []
    rest = np.ones(len(bad), bool)
    rng = np.random.default_rng(seed)
    part = rng.random(len(bad)) < 2 / 3
    while len(rules) < most_rules and (rest & bad).sum() >= least:
        grow, prune = rest & part, rest & ~part
        rule: Rule = []
        live = grow.copy()
        while len(rule) < most_conditions and (live & ~bad).any():
            p0, n0 = (live & bad).sum(), (live & ~bad).sum()
            base, best, choice = np.log2(p0 / (p0 + n0)) if p0 else 0.0, 0.0, None
            for f, values in x.items():
                own, label = values[live], bad[live]
                cuts = np.unique(np.quantile(own[label], np.linspace(0, 1, 33))) if label.any() else []
                for t in cuts:
                    for above in (True, False):
                        hit = own >= t if above else own < t
                        p, n = (hit & label).sum(), (hit & ~label).sum()
                        if p and (gain := p * (np.log2(p / (p + n)) - base)) > best:
                            best, choice = gain, Condition(f, above, float(t))
            if choice is None:
                break
            rule.append(choice)
            live &= _covers([choice], x)
        value = lambda k: ((hit := _covers(rule[:k], x) & prune) & bad).sum() / max(1, hit.sum())  # noqa: E731, B023
        while len(rule) > 1 and value(len(rule) - 1) >= value(len(rule)):
            rule.pop()
        hit = _covers(rule, x) & rest if rule else np.zeros(len(bad), bool)
        if hit.sum() < least or (hit & bad).sum() < precision * hit.sum():
            break
        rules.append(rule)
        rest &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: true (keep) unless a rule fires."""
    known = features()
    test = lambda c: known[c.feature] >= c.threshold if c.above else known[c.feature] < c.threshold
    out = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        out = out.when(reduce(Column.__and__, map(test, rule)), F.lit(False))
    return out.otherwise(F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20000, **options) -> list[Rule]:
    """Learn rules for label 0 from at most ``sample`` labelled ids, those with the least hash; one text and label of each."""
    rows = labelled_texts(docs, labels, id_col, text_col, label_col, sample).select("label", "text")
    got = text_stats(rows).select(F.col("row.label").alias("label"), *(c.alias(n) for n, c in features().items())).toArrow()
    x = {n: got[n].to_numpy() for n in features()}
    label = got["label"].to_numpy()
    order = np.lexsort([*x.values(), label])  # whatever order the rows come in
    return learn({n: v[order] for n, v in x.items()}, label[order] == 0, **options) if len(label) else []


def quality(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Per document: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    base_failed: fewer than 10 words, or more than 20 in 100 words repeated. Others are kept unless a rule fires; the
    rules are learned from ``labels`` where none are given (no labels: none fire). Each row is judged by itself.
    """
    if rules is None:
        rules = train(docs, labels, id_col, text_col) if labels is not None else []
    stats = text_stats(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.select(F.col("row.id").alias(id_col), *COUNTS[:5], failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
