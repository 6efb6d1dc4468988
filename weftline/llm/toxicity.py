"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import held_out, labelled_texts, row_type, unpacked, with_row

#: Look-alikes of Latin letters in Greek and Cyrillic, and substitutes of letters by digits and signs.
HOMOGLYPHS = dict(zip("авсԁеһіјкӏмнорԛгѕтѵԝхуѐёїαβεηικνορτυχγωι", "abcdehijklmhopqrstvwxyeeiabehikvoptuxywi", strict=True))
SUBSTITUTES = dict(zip("013456789@$!|+", "oieasgtbgasiit", strict=True))
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "clownfish", "scumble", "moronic acid", "not stupid", "no idiot")


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for code in [*range(0x100, 0x250), *range(0x1E00, 0x1F00), *range(0x2100, 0x2150), *range(0xFF10, 0xFF5B), *range(0x1D400, 0x1D800)]:
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0].isascii() and base[0].isalnum():
            out[code] = base[0].lower()
    out |= {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(k): v for k, v in SUBSTITUTES.items()}
    out |= {c: SUBSTITUTES.get(v, v) for c, v in out.items() if v}
    out |= {c: "i" for c, v in out.items() if v == "l"} | {ord("l"): "i"}  # 1, i and l stand for each other
    return out | dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)])


_FOLD = _table()


def fold(text: str) -> str:
    """Lower case with look-alikes and digit substitutes folded to letters, and invisible characters removed.

    Letters of Latin-1 keep their accents, which tell words of several languages apart.
    """
    return text.lower().translate(_FOLD)


def words_of(folded: str) -> list[str]:
    return "".join(c if c.isalpha() else " " for c in folded).split() if not folded.isascii() else folded.translate(_LETTERS).split()


_LETTERS = {c: " " for c in range(128) if not chr(c).isalpha()}


class Lexicon(NamedTuple):
    weights: dict[str, float]  # folded words, marked "$" at the end, and strict beginnings of words, marked "+"
    exceptions: tuple[str, ...]  # folded phrases
    fit: tuple[float, float, float]  # of the logistic score


class Matcher:
    """Sum of the weights of the heaviest lexicon entry of each word, outside exception phrases."""

    def __init__(self, lexicon: Lexicon):
        self.machine = ahocorasick.Automaton()
        entries: dict[str, list] = {e: [None, None, True] for e in lexicon.exceptions}
        for w, weight in lexicon.weights.items():
            entries.setdefault(w[:-1], [None, None, False])[w[-1] == "+"] = weight
        for e, (whole, begun, spared) in entries.items():
            self.machine.add_word(e, (len(e), whole, begun, spared))
        if len(self.machine):
            self.machine.make_automaton()

    def total(self, folded: str) -> float:
        if not len(self.machine):
            return 0.0
        hits: dict[int, tuple[int, float]] = {}
        spared = []
        for end, (length, whole, begun, spares) in self.machine.iter(folded):
            start = end - length + 1
            if start and folded[start - 1].isalpha():
                continue
            goes_on = end + 1 < len(folded) and folded[end + 1].isalpha()
            weight = begun if goes_on else whole
            if spares and not goes_on:
                spared.append((start, end))
            if weight is not None and weight > hits.get(start, (0, 0.0))[1]:
                hits[start] = (end, weight)
        if spared:
            hits = {s: h for s, h in hits.items() if not any(a <= s and h[0] <= b for a, b in spared)}
        return sum(w for _, w in hits.values())


def _inputs(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Model inputs: the weight found, and the weight for each hundred words."""
    return np.stack([np.log1p(total), np.log1p(100 * total / (size + 50)), np.ones(len(total))], 1)


def _size(text: str) -> int:
    return text.count(" ") + text.count("\n") + 1


def _score(fit: tuple[float, float, float], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.array(fit), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + 1e-2 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), slope)
    return tuple(float(v) for v in w)


def choose(counts: dict[str, tuple[int, int]], positives: int, negatives: int, support: int, precision: float) -> dict[str, float]:
    """Entries from (toxic, other) counts of words and beginnings: the longest that keep nearly all of a stem's toxic uses."""
    children: dict[str, list[str]] = {}
    for p in counts:
        children.setdefault(p[:-2], []).append(p)
    chosen: dict[str, float] = {}
    stack = [p for p in counts if p[:-2] + "+" not in counts]
    while stack:
        p = stack.pop()
        pos, neg = counts[p]
        longer = children.get(p[:-1], []) if p[-1] == "+" else []
        if pos < support:
            continue
        if pos >= precision * (pos + neg) and not any(counts[c][0] >= 0.95 * pos for c in longer):
            chosen[p] = max(0.1, math.log((pos + 0.5) / (positives + 1)) - math.log((neg + 0.5) / (negatives + 1)))
        else:
            stack += longer
    return chosen


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20000, support: int = 4, precision: float = 0.8, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn the lexicon, its exceptions and the score from at most ``sample`` labelled ids, one text each.

    The sample are the ids with the least hash. Entries are folded words and strict beginnings of words, of
    3 to 12 letters, that at least ``support`` toxic texts and mostly toxic ones have; words that begin with an entry but
    stand mostly in other texts join the exceptions, all of them: the labelled sample bounds their number. The score is a logistic function of the weight found and its density.
    """
    rows = labelled_texts(docs, labels, id_col, text_col, label_col, sample).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (Counter(), Counter())
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[label == 1].update({w for w in words_of(fold(text)) if len(w) >= 3})
                found[label == 1][""] += 1
            for k in (0, 1):
                n = [*found[k].values()]
                yield pa.RecordBatch.from_arrays([pa.array([*found[k]], pa.string()), pa.array(n if k else [0] * len(n), pa.int64()), pa.array([0] * len(n) if k else n, pa.int64())], ["word", "pos", "neg"])

    words = rows.mapInArrow(count, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).persist()
    starts = F.transform(F.sequence(F.lit(3), F.least(F.lit(12), F.length("word") - 1)), lambda k: F.concat(F.substring("word", 1, k), F.lit("+")))
    starts = F.when(F.length("word") > 3, starts).otherwise(F.array().cast("array<string>"))
    begun = words.where("word <> ''").select(F.explode(F.array_append(starts, F.concat("word", F.lit("$")))).alias("word"), "pos", "neg")
    begun = begun.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= support)
    whole = words.where("word = ''").select("pos", "neg").first() or (0, 0)
    counts = {r["word"]: (r["pos"], r["neg"]) for r in begun.where("2 * pos > neg").collect()}
    weights = choose(counts, *whole, support, precision)
    entries = F.array(*[F.lit(w[:-1]) for w in weights if w[-1] == "+"], F.lit("+"))
    benign = words.where(f"neg >= {support} and neg > 4 * pos").where(F.exists(entries, lambda e: F.startswith("word", e)))
    folded = tuple(sorted({fold(e) for e in exceptions} | {r["word"] for r in benign.collect()}))
    words.unpersist()
    matcher = docs.sparkSession.sparkContext.broadcast(Lexicon(weights, folded, (0.0, 0.0, 0.0)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(matcher.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.total(fold(t)) for t in texts], pa.float64()), pa.array([_size(t) for t in texts], pa.int64())], ["label", "total", "size"])

    got = rows.select(F.col("label").cast("int"), "text").mapInArrow(measure, "label int, total double, size long").toArrow()
    x, y = _inputs(got["total"].to_numpy(), got["size"].to_numpy()), (got["label"].to_numpy() == 1).astype(float)
    order = np.lexsort([*x.T, y])
    fit = _logistic(x[order], y[order]) if 0 < y.sum() < len(y) else (0.0, 0.0, 30.0 if len(y) and y.all() else -30.0)
    return Lexicon(weights, folded, fit)


def toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", below: float | None = None) -> DataFrame:
    """The other columns in a struct ``row`` and ``score``, from 0 to 1; with ``below`` only such rows, with their ``text``.

    Texts are folded and matched whole; a null or empty text scores as one without lexicon words. Each row is scored
    by its text alone, so repeated rows score alike and clashing column names need no care.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    carried = with_row(docs, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                total, size = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
                for i, value in enumerate(batch.column(1)):
                    text = value.as_py() or ""
                    total[i], size[i] = matcher.total(fold(text)), _size(text)
                scores = _score(shared.value.fit, _inputs(total, size))
                if below is None:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["row", "score"])
                else:
                    batch, scores = batch.filter(pa.array(scores < below)), scores[scores < below]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], ["row", "text", "score"])

    return carried.mapInArrow(score, f"row {row_type(carried)}, " + ("score double" if below is None else "text string, score double"))


def toxic_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """Per document: the id, held_out, score, predicted; learned from the labels outside the held-out fold."""
    lexicon = train(docs.select(id_col, text_col), labels.where(~held_out(id_col)), id_col, text_col, **options)
    scored = toxicity(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), lexicon, "text")
    out = scored.select(F.col("row.id").alias(id_col), "score")
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    lexicon = train(docs, labels.where(~held_out("doc_id")), text_col=text_col, **options)
    return toxicity(docs, lexicon, text_col, below=threshold).select(unpacked(docs, text_col))
