"""Hard negatives by largest inner product, searched over one-dimensional distance keys.

Vectors get one more coordinate that gives all the same norm, so the largest inner product with an anchor is the least
distance from it. Each vector is stored under its nearest pivot and the distance from that, sorted by both. A search scans
the blocks whose keys lie in a ring about the anchor's own distance from each pivot, and widens the ring until no block
outside can hold a better row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import drop, stash

BLOCK = 1024  # vectors that share the bounds of their keys
CELLS = 1 << 21  # products held at once
PENDING = 1 << 17  # candidates held before the best are chosen
SLICE_BYTES = 8 << 20  # vectors of the anchors sent to the tasks at once
PARTITION_BYTES = 16 << 20
INDEX = "vec_id long, label long, pivot int, key double, low double, high double, vec binary"


class Index(NamedTuple):
    rows: DataFrame  # INDEX and rid
    kind: str  # number type of the stored components
    width: int
    norm: float  # the common squared norm of the lengthened vectors
    pivots: np.ndarray
    rings: list[float]  # radii of the rounds, the last one infinite


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Stored vectors as rows of numbers whose products are exact."""
    if not len(column):
        return np.zeros((0, width), np.float64)
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), width)


def _integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) of each component; shorter vectors end in zeros."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(column)), size)
    place = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], size)
    out[row, place] = np.floor(256.0 * values[offsets[0] : offsets[-1]].astype(np.float64))
    return out


def _nearest(x: np.ndarray, norm: float, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of integers the nearest pivot and the distance from it."""
    away = _distances(x, norm, pivots)
    pivot = away.argmin(1)
    return pivot, away[np.arange(len(x)), pivot]


def _distances(x: np.ndarray, norm: float, pivots: np.ndarray, anchors: bool = False) -> np.ndarray:
    """Distances from all pivots of the lengthened rows; an anchor's own last coordinate is 0."""
    x = x.astype(np.float64)
    own = (x * x).sum(1)
    last = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(norm - own, 0.0))
    square = (own + last**2)[:, None] + (pivots**2).sum(1)[None] - 2 * (x @ pivots[:, :-1].T + last[:, None] * pivots[None, :, -1])
    return np.sqrt(np.maximum(square, 0.0))


def choose_pivots(sample: np.ndarray, most: int, rounds: int = 8) -> np.ndarray:
    """Centres of the lengthened sample by Lloyd's rounds from evenly spaced rows."""
    count = max(1, min(most, len(sample) // 16))
    centres = sample[np.linspace(0, len(sample) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        near = ((sample**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * sample @ centres.T).argmin(1)
        for c in range(count):
            if (near == c).any():
                centres[c] = sample[near == c].mean(0)
    return centres


def build_index(vectors: DataFrame, pivots: int = 64, sample: int = 4096) -> Index | None:
    """The stored index of all (vec_id, label, embedding) rows; null without rows.

    The pivots are fitted to at most ``sample`` rows, those with the least hash; every row is indexed.
    """
    spark = vectors.sparkSession
    squares = F.aggregate(F.transform("embedding", lambda x: F.pow(F.floor(256 * x.cast("double")).cast("double"), 2)), F.lit(0.0), lambda a, b: a + b)
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(256 * x.cast("double")) + 1))
    n, norm, top, width = vectors.agg(F.count("*"), F.max(squares), F.max(largest), F.max(F.size("embedding"))).first()
    if not n:
        return None
    norm, top, width = norm or 0.0, top or 1.0, width or 0
    if norm >= 2.0**63:
        raise ValueError("inner products pass 64 bits")
    kind = next(k for k, bound in (("<i2", 2**15), ("<i4", 2**31), ("<i8", math.inf)) if top < bound)

    hashed = F.shiftrightunsigned(F.xxhash64("vec_id", "embedding"), 1)
    some = vectors.where(hashed < int((2 * sample + 200) / n * 2**63)) if n > 4 * sample else vectors
    some = some.orderBy(hashed, "vec_id").limit(sample).select("embedding").toArrow()
    x = _integers(some["embedding"].combine_chunks(), width) if len(some) else np.zeros((1, width))
    centres = choose_pivots(np.column_stack([x, np.sqrt(np.maximum(norm - (x * x).sum(1), 0.0))]), pivots)
    pivot, key_of = _nearest(x, norm, centres)
    gaps = np.abs(_distances(x[:256], norm, centres, anchors=True)[:, pivot] - key_of)
    rings = [*(float(r) for r in np.quantile(gaps, [0.04, 0.3])), math.inf]
    shared = spark.sparkContext.broadcast(centres)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _integers(batch.column(2), width)
            pivot, away = _nearest(own, norm, shared.value)
            own = own.astype(kind)
            size = own.dtype.itemsize * width
            vec = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((np.arange(len(own) + 1) * size).astype(np.int32)), pa.py_buffer(own.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pivot.astype(np.int32)), pa.array(away), vec], ["vec_id", "label", "pivot", "key", "vec"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, away = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            low, high = np.empty(len(away)), np.empty(len(away))
            for a, b in _stretches(pivot, np.arange(len(pivot)) // BLOCK):
                low[a:b], high[a:b] = away[a:b].min(), away[a:b].max()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(low), pa.array(high), batch.column(4)], ["vec_id", "label", "pivot", "key", "low", "high", "vec"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * width * np.dtype(kind).itemsize // PARTITION_BYTES)
    keyed = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(key, "vec_id long, label long, pivot int, key double, vec binary")
    keyed = keyed.repartitionByRange(parts, "pivot", "key", "vec_id").sortWithinPartitions("pivot", "key", "vec_id")
    rows = stash(keyed.mapInArrow(bound, INDEX).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    return Index(rows, kind, width, float(norm), centres, rings)


def _stretches(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches in which all columns stay equal."""
    n = len(columns[0])
    if not n:
        return []
    new = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), n]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


class Search(NamedTuple):
    """What the tasks need of a slice of anchors: one row each, and one column for each of its searches."""

    rid: np.ndarray
    vec: np.ndarray
    label: np.ndarray
    same: bool  # rows of the same label, or of others
    floor: np.ndarray  # least score that counts, [anchors, searches]
    ceiling: np.ndarray
    keep: int


def best(anchor: np.ndarray, search: np.ndarray, score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Places of the first ``keep`` candidates of each search: by score downwards, then id."""
    order = np.lexsort((ids, -score, search, anchor))
    a, s = anchor[order], search[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    begin = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < keep]


class Scan:
    """Candidates of the blocks that one task reads; bounds rise as better rows are found."""

    def __init__(self, s: Search, index: tuple[str, int, float, np.ndarray], inner: float, outer: float):
        self.s, (self.kind, self.width, self.norm, self.pivots) = s, index
        self.inner, self.outer = inner, outer
        exact = np.float64 if self.norm < 2**52 else np.int64
        self.vec = s.vec.astype(exact)
        self.away = _distances(s.vec, self.norm, self.pivots, anchors=True)
        self.reach = (s.vec.astype(np.float64) ** 2).sum(1) + self.norm  # twice a score plus the squared distance
        self.slack = 1 + 1e-9 * self.reach
        self.floor = s.floor.astype(np.float64)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.pending = 0

    def block(self, pivot: int, low: float, high: float, ids: np.ndarray, labels: np.ndarray, rids: np.ndarray, vec: np.ndarray) -> None:
        away = self.away[:, pivot]
        gap = np.maximum(0.0, np.maximum(low - away, away - high))
        most = (self.reach - gap**2) / 2 + self.slack
        least = (self.reach - (away + high) ** 2) / 2 - self.slack
        useful = ((most[:, None] >= self.floor) & (least[:, None] <= self.s.ceiling) & (self.floor <= self.s.ceiling)).any(1)
        near = np.flatnonzero(useful & (gap > self.inner) & (gap <= self.outer))
        for at in range(0, len(near), max(1, CELLS // max(1, len(ids)))):
            own = near[at : at + max(1, CELLS // max(1, len(ids)))]
            score = self.vec[own] @ vec.astype(self.vec.dtype).T
            alike = labels[None] == self.s.label[own][:, None]
            fits = alike & (rids[None] != self.s.rid[own][:, None]) if self.s.same else ~alike
            for j in range(self.s.floor.shape[1]):
                a, b = np.nonzero(fits & (score >= self.floor[own, j][:, None]) & (score <= self.s.ceiling[own, j][:, None]))
                if len(a):
                    self.found.append((own[a], np.full(len(a), j), score[a, b].astype(np.int64), ids[b]))
                    self.pending += len(a)
            if self.pending > PENDING:
                self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.found:
            return (np.zeros(0, np.int64),) * 4
        all_of = tuple(np.concatenate(c) for c in zip(*self.found, strict=True))
        chosen = best(*all_of, self.s.keep)
        out = tuple(c[chosen] for c in all_of)
        a, s = out[0], out[1]
        new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])))
        full = np.diff(np.append(new, len(a))) == self.s.keep
        last = new[full] + self.s.keep - 1
        self.floor[a[last], s[last]] = np.maximum(self.floor[a[last], s[last]], out[2][last])
        self.found, self.pending = [out], 0
        return out


def _top(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("anchor", "search").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def search(index: Index, s: Search) -> DataFrame:
    """(anchor, search, score, vec_id, rank) of the first ``keep`` rows of each search, stored; anchor is its place in ``s``.

    Each round scans the blocks between two radii. When the best that an unscanned block could hold is worse than what
    every search has, the rest need not be read.
    """
    spark = index.rows.sparkSession
    plain = (index.kind, index.width, index.norm, index.pivots)
    away = _distances(s.vec, index.norm, index.pivots, anchors=True)
    reach = (s.vec.astype(np.float64) ** 2).sum(1) + index.norm
    result, inner = None, -1.0
    for outer in index.rings:
        if inner >= 0 and not (((reach - inner**2) / 2 + 1 + 1e-9 * reach)[:, None] >= s.floor)[s.floor <= s.ceiling].any():
            break
        shared = spark.sparkContext.broadcast((s, plain, inner, outer))
        rows = index.rows
        if outer < math.inf:  # keys that some anchor's ring can meet
            lows, highs = away.min(0) - outer, away.max(0) + outer
            rows = rows.where(" or ".join(f"(pivot = {j} and high >= {a!r}D and low <= {b!r}D)" for j, (a, b) in enumerate(zip(lows.tolist(), highs.tolist(), strict=True))))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Scan(*shared.value)
            for batch in batches:
                ids, labels, pivot, low, high, rids = (batch.column(i).to_numpy() for i in (0, 1, 2, 3, 4, 5))
                vec = _matrix(batch.column(6), own.kind, own.width)
                for a, b in _stretches(pivot, low, high):
                    for at in range(a, b, BLOCK):
                        part = slice(at, min(b, at + BLOCK))
                        own.block(int(pivot[a]), float(low[a]), float(high[a]), ids[part], labels[part], rids[part], vec[part])
            anchor, number, score, ids = own.settle()
            for at in range(0, len(anchor), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (anchor.astype(np.int32), number.astype(np.int32), score, ids)], ["anchor", "search", "score", "vec_id"])

        found = rows.select("vec_id", "label", "pivot", "low", "high", "rid", "vec").mapInArrow(scan, "anchor int, search int, score long, vec_id long")
        before = result
        result = stash(_top(found if before is None else found.unionByName(before.drop("rank")), s.keep), "nearest")
        if before is not None:
            drop(before)
        full = result.where(F.col("rank") == s.keep).select("anchor", "search", "score").toArrow()
        floor = s.floor.copy()
        at = (full["anchor"].to_numpy(), full["search"].to_numpy())
        floor[at] = np.maximum(floor[at], full["score"].to_numpy())
        s, inner = s._replace(floor=floor), outer
        shared.destroy()
    return result


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, **options) -> DataFrame:
    """Per anchor and positive the first ``negatives`` rows of another label whose score lies between two shares of the positive's.

    ``anchors`` is a condition on ``id_col``. Scores are inner products of floor(256 * x), exact integers; higher ones come
    first, ties by smaller id. An anchor's positives are its first ``positives`` other rows of its label. A negative has
    low * positive_score <= 100 * negative_score <= high * positive_score, so a positive below 0 has none.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Rows with a null id, label or vector
    and those with a null or non-finite component take no part; shorter vectors count as ending in zeros. Repeated rows
    count each by itself, as positives, negatives and anchors. Empty tables give no rows; other columns are not read.
    Scores that pass 64 bits raise an error.

    The anchors go to the tasks in slices of about 8 MB of vectors, whatever their number; each slice searches all rows.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    wide = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    wide = wide.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    index = build_index(wide, **options)
    if index is None:
        return spark.createDataFrame([], schema)
    own = index.rows.where(anchors)
    part = F.shiftright("rid", 33)  # of monotonically_increasing_id: the partition, at most about PARTITION_BYTES
    counts = sorted((r[0], r[1]) for r in own.groupBy(part.alias("part")).count().collect())
    most = max(1, SLICE_BYTES // max(1, index.width * np.dtype(index.kind).itemsize))
    slices, size = [], most + 1
    for p, n in counts:
        if size + n > most:
            slices.append([p, p])
            size = 0
        slices[-1][1], size = p, size + n
    out: list[DataFrame] = []
    for first, last in slices:
        got = own.where((F.col("rid") >= first << 33) & (F.col("rid") < (last + 1) << 33)).select("rid", "vec_id", "label", "vec").orderBy("rid").toArrow()
        out.append(_slice(index, got, positives, negatives, low, high))
    drop(index.rows)
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)


def _slice(index: Index, got: pa.Table, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result rows of some anchors, stored."""
    spark = index.rows.sparkSession
    n = len(got)
    vec = _matrix(got["vec"].combine_chunks(), index.kind, index.width)
    rid, ids, label = (got[c].to_numpy() for c in ("rid", "vec_id", "label"))
    everything = Search(rid, vec, label, True, np.full((n, 1), -(2.0**63)), np.full((n, 1), 2.0**63), positives)
    near = search(index, everything)
    friends = near.toArrow()
    drop(near)
    a, j = friends["anchor"].to_numpy(), friends["rank"].to_numpy() - 1
    floor, ceiling = np.full((n, positives), np.inf), np.full((n, positives), -np.inf)
    friend, score = np.zeros((n, positives), np.int64), np.zeros((n, positives), np.int64)
    friend[a, j], score[a, j] = friends["vec_id"].to_numpy(), friends["score"].to_numpy()
    floor[a, j] = [-(-low * x // 100) for x in friends["score"].to_pylist()]
    ceiling[a, j] = [high * x // 100 for x in friends["score"].to_pylist()]
    found = search(index, Search(rid, vec, label, False, floor, ceiling, negatives))
    shared = spark.sparkContext.broadcast((ids, friend, score))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, friend, score = shared.value
        for batch in batches:
            a, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(friend[a, j]), batch.column(4), batch.column(3), pa.array(score[a, j]), batch.column(2)], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    out = stash(found.mapInArrow(name, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"), "negatives")
    drop(found)
    return out


def mine(embeddings: DataFrame) -> DataFrame:
    """The registered search: ids divisible by 100 are anchors; where an id is divisible by 7 the label first becomes (label + 1) % 10."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)
