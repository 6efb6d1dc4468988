"""Quality scores by histogram gradient-boosted trees over statistics of the text, held as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.quality_rules import COUNTS, text_counts
from weftline.llm import textkernel as K
from weftline.llm.shared import held_out, labelled_texts, row_type, with_row

FEATURES = (
    "n_words", "n_lines", "mean_word_chars", "symbols_per_word", "marks_per_word", "upper_share", "digit_share", "dup_line_share",
    "repeat_share", "words_per_line", "words_per_stop", "stops_per_word", "distinct_share", "follow_share",
)


class Trees(NamedTuple):
    """Complete binary trees of one depth: inner nodes level by level, then the leaves, each tree a row."""

    feature: np.ndarray  # int16 [trees, 2**depth - 1]
    threshold: np.ndarray  # float64, goes right at feature >= threshold
    value: np.ndarray  # float64 [trees, 2**depth]
    prior: float


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ``FEATURES`` of a chunk's rows, one column each; shares of nothing are 0."""
    c = dict(zip(COUNTS, (x.astype(np.float64) for x in text_counts(data, offsets)), strict=True))
    w = K.words(data, offsets, K.SPACE)
    rows = len(offsets) - 1
    order = K._sort_within(w.hashes, w.row) if len(w.hashes) else np.zeros(0, np.int64)
    h, r = w.hashes[order], w.row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[new], minlength=rows)
    follows = (w.hashes[1:] == w.hashes[:-1]) & (w.row[1:] == w.row[:-1])
    follow = np.bincount(w.row[1:][follows], minlength=rows)
    share = lambda a, b: np.divide(a, b, out=np.zeros(rows), where=b > 0)
    n = c["n_words"]
    return np.column_stack([
        n, c["n_lines"], share(c["word_chars"], n), share(c["n_symbols"], n), share(c["n_marks"], n), share(c["n_upper"], c["word_chars"]), share(c["n_digits"], c["word_chars"]),
        share(c["n_dup_lines"], c["n_lines"]), share(c["n_repeat_words"], n), share(n, c["n_lines"]), n / (c["n_stops"] + 1), share(c["n_stops"], n), share(distinct, n), share(follow, n),
    ])


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boost trees for the log odds of y = 1 by histograms of gradients over at most ``bins`` quantile bins of each feature.

    Trees are grown level by level. A node splits where that gains most and leaves a hessian of ``least`` on both
    sides; else all its rows go left. Without both classes the score is the smoothed share of label 1 everywhere.
    """
    inner, width = (1 << depth) - 1, x.shape[1]
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    none = Trees(np.zeros((0, inner), np.int16), np.zeros((0, inner)), np.zeros((0, inner + 1)), prior)
    if not 0 < y.sum() < len(y):
        return none
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.column_stack([np.searchsorted(c, column, "right") for c, column in zip(cuts, x.T, strict=True)])
    flat = binned + np.arange(width) * bins
    score = np.full(len(y), prior)
    feature, threshold, value = np.zeros((trees, inner), np.int16), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            nodes = 1 << level
            at = ((node * width * bins)[:, None] + flat).ravel()
            g, h = (np.bincount(at, np.repeat(v, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(2) for v in (gradient, hessian))
            g_all, h_all = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            gain[(h < least) | (h_all - h < least)] = 0
            for k in range(width):
                gain[:, k, len(cuts[k]) :] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            has = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            f, b = best // bins, best % bins
            base = nodes - 1
            feature[t, base : base + nodes] = np.where(has, f, 0)
            threshold[t, base : base + nodes] = [cuts[f[i]][b[i]] if has[i] else np.inf for i in range(nodes)]
            right = has[node] & (binned[np.arange(len(y)), f[node]] > b[node])
            node = 2 * node + right
        g, h = np.bincount(node, gradient, inner + 1), np.bincount(node, hessian, inner + 1)
        value[t] = -rate * g / (h + ridge)
        score += value[t][node]
    return Trees(feature, threshold, value, prior)


def apply(model: Trees, x: np.ndarray, together: int = 1 << 14) -> np.ndarray:
    """Scores from 0 to 1; all trees step down one level at a time for a block of rows."""
    out = np.empty(len(x))
    trees, inner = model.feature.shape
    row_of_tree = np.arange(trees)
    for at in range(0, len(x), together):
        block = x[at : at + together]
        node = np.zeros((len(block), trees), np.int64)
        rows = np.arange(len(block))[:, None]
        for _ in range(inner.bit_length()):
            right = block[rows, model.feature[row_of_tree, node]] >= model.threshold[row_of_tree, node]
            node = 2 * node + 1 + right
        out[at : at + together] = 1 / (1 + np.exp(-(model.prior + model.value[row_of_tree, node - inner].sum(1))))
    return out


def with_statistics(docs: DataFrame, text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """The other columns in a struct ``row``, with the ``FEATURES`` of each whole text, or a model's ``score`` of them."""
    carried = with_row(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                x, own = statistics(c.data, c.offsets), batch.column(0)[c.rows]
                columns, names = ([*x.T], FEATURES) if shared.value is None else ([apply(shared.value, x)], ("score",))
                yield pa.RecordBatch.from_arrays([own, *(pa.array(np.ascontiguousarray(v)) for v in columns)], ["row", *names])

    return carried.mapInArrow(measure, f"row {row_type(carried)}, " + ", ".join(f"{n} double" for n in (FEATURES if model is None else ("score",))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20000, **options) -> Trees:
    """Learn from at most ``sample`` labelled ids, those with the least hash; one text and label of each."""
    rows = labelled_texts(docs, labels, id_col, text_col, label_col, sample)
    got = with_statistics(rows.select("label", "text")).select(F.col("row.label").alias("label"), *FEATURES).toArrow()
    x, y = np.column_stack([got[n].to_numpy() for n in FEATURES]), (got["label"].to_numpy() == 1).astype(float)
    order = np.lexsort([*x.T, y])  # whatever order the rows come in
    return fit(x[order], y[order], **options)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """Per document: the id, held_out, score, predicted; learned from the labels outside the held-out fold.

    The score is a function of the whole text alone, so repeated rows score alike; null and empty texts score as a text
    of no words. Labels of null and rows without an id teach nothing; with no labels at all every score is one half.
    Other columns are not read.
    """
    model = train(docs.select(id_col, text_col), labels.where(~held_out(id_col)), id_col, text_col, **options)
    scored = with_statistics(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", model).select(F.col("row.id").alias(id_col), "score")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
