"""Full-text search over tokens: prefix and all-terms matching, ranks, headlines, facets, an inverted index."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.exprs import bound

#: Word characters of both engines: ASCII letters and digits, and everything from U+0080.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = TOKEN.replace("[^", "[")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def prefixes(query: str) -> list[str]:
    """Lower-case word beginnings of a query; other characters are dropped."""
    return [w for w in re.sub(r"[^\w-]+", " ", query.lower()).split() if w]


def matches_prefixes(words: Column, terms: list[str]) -> Column:
    """Every term begins some word; no term matches nothing."""
    out = F.lit(bool(terms))
    for t in terms:
        out = out & F.exists(words, _starts(t))
    return out


def _starts(term: str):
    return lambda w: w.startswith(term)


def matches_all(words: Column, terms: list[str]) -> Column:
    out = F.lit(bool(terms))
    for t in terms:
        out = out & F.array_contains(words, t)
    return out


def frequency_rank(words: Column, terms: list[str]) -> Column:
    """Occurrences of the terms per thousand words."""
    hits = F.size(F.filter(words, lambda w: w.isin(terms)))
    return F.round(F.try_divide(1000.0 * hits, F.size(words)), 6)


def _term(term: str, whole: bool) -> str:
    """A pattern for a word, or for a word's beginning, over lower-case text."""
    word = TOKEN.removesuffix("+")
    return f"(?<!{word}){re.escape(term)}" + (f"(?!{word})" if whole else "")


def _spaced(low: Column) -> Column:
    """The words of a lower-case text, two spaces between them and one at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, _BETWEEN, "  ")), F.lit(" "))


def text_has(text: Column, terms: list[str], whole: bool = True) -> Column:
    """As matches_all (or matches_prefixes) over the text's tokens, without building them: texts that hold all terms anywhere are spaced out once."""
    out, low = F.lit(bool(terms)), F.lower(text)
    for t in terms:
        out = out & low.contains(t)
    plain = [t for t in terms if re.fullmatch(TOKEN, t)]
    if plain:
        out = out & bound(_spaced(low), lambda s: reduce(and_, (s.contains(f" {t} " if whole else f" {t}") for t in plain)))
    for t in terms:
        if t not in plain:
            out = out & low.rlike(_term(t, whole))
    return out


def text_rank(text: Column, terms: list[str]) -> Column:
    """As frequency_rank over the text's tokens, without building them."""
    low, plain = F.lower(text), [t for t in dict.fromkeys(terms) if re.fullmatch(TOKEN, t)]

    def of(s: Column) -> Column:
        times = lambda part: F.floor((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("int")
        hits = sum((times(f" {t} ") for t in plain), F.lit(0))
        words = F.when(s == "  ", 0).otherwise(times("  ") + 1)
        return F.round(F.try_divide(1000.0 * hits, words), 6)

    return bound(_spaced(low), of)


def postings(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """(term, id, tf) of the few ``terms(term)`` of a query: other words go before anything is grouped."""
    words = docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("term"))
    return words.join(terms, "term", "left_semi").groupBy("term", id_col).agg(F.count(F.lit(1)).alias("tf"))


def inverted_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf): explode and count, for searches that join on terms instead of scanning texts."""
    return docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("term")).groupBy("term", id_col).agg(F.count(F.lit(1)).alias("tf"))


@F.pandas_udf(T.StringType())
def headline(text: pd.Series, term: pd.Series) -> pd.Series:
    """Up to 30 words around the first word that begins with the term."""

    def cut(t: str | None, q: str) -> str | None:
        if t is None:
            return None
        words = t.split()
        at = next((i for i, w in enumerate(words) if w.lower().startswith(q)), 0)
        return " ".join(words[max(0, at - 5) : at + 25])

    return pd.Series([cut(t, q) for t, q in zip(text, term, strict=True)])
