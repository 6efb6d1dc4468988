"""Benchmark passages in training documents, found by an FM-index of each training shard."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import textkernel as K
from weftline.llm.fm_index import FMIndex
from weftline.llm.shared import row_type, stash, unpacked, with_row

SHARD = 2 << 20
FOUND = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"


class Phrases(NamedTuple):
    """Distinct windows of some items: by length, their word numbers and, from offsets, places of the items that have each."""

    vocabulary: np.ndarray
    names: list[str]
    by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def phrases(names: list[str | None], texts: pa.Array, width: int) -> Phrases:
    """Windows of ``width`` words of each item; an item of fewer words, but not none, is one window."""
    known = sorted({n for n in names if n is not None})
    place = {n: i for i, n in enumerate(known)}
    own = np.array([place.get(n, -1) for n in names], np.int64)
    found = []
    for c in K.chunks(texts, 1 << 40):
        w = K.words(K.LOWER[c.data], c.offsets, K.NOT_ALNUM)
        vocabulary = np.unique(w.hashes)
        number = (np.searchsorted(vocabulary, w.hashes) + 1).astype(np.int32)
        count = np.diff(w.first)
        for length in sorted({width, *count[(count > 0) & (count < width)].tolist()}):
            hashes, at = K.windows(w.hashes, w.first, length)
            if length < width:
                hashes, at = hashes[count[w.row[at]] == length], at[count[w.row[at]] == length]
            if not len(at):
                continue
            _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([which, own[w.row[at]]], 1), axis=0)
            pairs = pairs[pairs[:, 1] >= 0]
            found.append((number[at[first][:, None] + np.arange(length)], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)), pairs[:, 1].astype(np.int32)))
        return Phrases(vocabulary, known, found)
    return Phrases(np.zeros(0, np.uint64), [], [])


def search(data: np.ndarray, offsets: np.ndarray, wanted: Phrases) -> tuple[K.Words, np.ndarray, list[list[str]]]:
    """The words of a shard, which of them lie in an occurrence, and the items that occur in each row.

    An occurrence can only lie in a run of words that the items know, so the shard's index holds the runs that
    are as long as the shortest window, between separators.
    """
    w = K.words(K.LOWER[data], offsets, K.NOT_ALNUM)
    hit = np.zeros(len(w.hashes) + 1, np.int64)
    found: list[set[str]] = [set() for _ in range(len(offsets) - 1)]
    if not len(wanted.vocabulary) or not len(w.hashes):
        return w, hit[:-1] > 0, [[] for _ in found]
    number = np.searchsorted(wanted.vocabulary, w.hashes)
    known = wanted.vocabulary[np.minimum(number, len(wanted.vocabulary) - 1)] == w.hashes
    begins = known.copy()
    begins[1:] &= ~known[:-1] | (w.row[1:] != w.row[:-1])
    run = np.cumsum(begins) - 1
    length = np.bincount(run[known], minlength=1)
    at = np.flatnonzero(known & (length[run] >= min(p.shape[1] for p, *_ in wanted.by_length)))
    if not len(at):
        return w, hit[:-1] > 0, [[] for _ in found]
    last = np.append(run[at[1:]] != run[at[:-1]], True)
    place = np.arange(len(at)) + np.append(0, np.cumsum(last)[:-1])
    text = np.zeros(int(place[-1]) + 2, np.int64)
    text[place] = number[at] + 1
    word = np.full(len(text), -1, np.int64)
    word[place] = at
    index = FMIndex(text, len(wanted.vocabulary))
    for patterns, owner_at, owners in wanted.by_length:
        lo, hi = index.count(patterns)
        some = np.flatnonzero(hi > lo)
        if not len(some):
            continue
        times = (hi - lo)[some]
        which = np.repeat(some, times)
        rows = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo[some], times)
        first = word[index.locate(rows)]
        np.add.at(hit, first, 1)
        np.add.at(hit, first + patterns.shape[1], -1)
        for pattern, row in np.unique(np.stack([which, w.row[first]], 1), axis=0).tolist():
            found[row].update(wanted.names[k] for k in owners[owner_at[pattern] : owner_at[pattern + 1]])
    return w, np.cumsum(hit)[:-1] > 0, [sorted(x) for x in found]


def _spans(data: np.ndarray, offsets: np.ndarray, w: K.Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged runs of hit words as rows and code point offsets within them."""
    begins, ends = hit.copy(), hit.copy()
    same = w.row[1:] == w.row[:-1]
    begins[1:] &= ~(hit[:-1] & same)
    ends[:-1] &= ~(hit[1:] & same)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    row = w.row[begins]
    base = points[offsets[row]]
    return row, points[w.start[begins]] - base, points[w.end[ends]] - base


def find_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10, broadcast_bytes: int = 32 << 20, cut: bool = False) -> DataFrame:
    """Occurrences of the benchmark's word windows in each document.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and of other characters from U+0080; a window is
    ``width`` consecutive words of an item, or all of an item's words where it has fewer. Returns the other
    columns in a struct ``row`` with n_words, n_hit (words inside any occurrence), item_ids (distinct items with an
    occurring window, as strings in order) and spans (merged runs of hit words, as code point offsets); with ``cut``
    also the ``text`` without its spans.

    A null or empty text has no words; a null or wordless item has no window; an item without an id still marks
    its words but is not listed. Repeated documents and items are treated alike, each document by itself; texts are
    searched whole. Clashing column names stay inside ``row``. Empty tables give no rows, or rows without hits.

    The windows are built in tasks, and sent to every task only up to about ``broadcast_bytes`` as they are sent; a
    benchmark with more is dealt by hash of the items into parts of about that size, which pass over the documents one
    after another. An item is never divided, so one larger than a part is a part.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    a_word = 4 * width + 24

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(len(K.words(K.LOWER[c.data], c.offsets, K.NOT_ALNUM).start) for c in K.chunks(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    def build(table: pa.Table) -> pa.Table:
        wanted = phrases(table["item"].to_pylist(), table["text"], width)
        return pa.table({"part": table["part"][:1], "blob": pa.array([pickle.dumps(wanted)], pa.binary())})

    words = items.mapInArrow(measure, "n long").agg(F.sum("n")).first()[0] or 0
    parts = 1 + words * a_word // broadcast_bytes
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)).cast("int"))
    built = stash(dealt.groupBy("part").applyInArrow(build, "part int, blob binary"), "phrases")
    out = with_row(docs, text_col).select("*", F.lit(None).cast("binary").alias("marks"), F.lit(None).cast("array<string>").alias("found"))
    kept = row_type(out)
    for part in range(parts):
        blob = built.where(F.col("part") == part).select("blob").first()
        wanted = docs.sparkSession.sparkContext.broadcast(pickle.loads(blob[0]) if blob else phrases([], pa.array([], pa.string()), width))
        last = part == parts - 1

        def scan(batches: Iterator[pa.RecordBatch], wanted=wanted, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c in K.chunks(batch.column(1), SHARD):
                    w, hit, found = search(c.data, c.offsets, wanted.value)
                    if batch.column(2).null_count < len(batch):
                        before = batch.column(2)[c.rows].to_pylist()
                        hit |= np.concatenate([np.frombuffer(x, bool) for x in before]) if before else hit
                        found = [sorted({*a, *b}) for a, b in zip(found, batch.column(3)[c.rows].to_pylist(), strict=True)]
                    items_ = pa.array(found, pa.list_(pa.string()))
                    if not last:
                        marks = pa.array([hit[w.first[i] : w.first[i + 1]].tobytes() for i in range(len(found))], pa.binary())
                        yield pa.RecordBatch.from_arrays([batch.column(0)[c.rows], batch.column(1)[c.rows], marks, items_], ["row", "text", "marks", "found"])
                        continue
                    total = np.append(0, np.cumsum(hit))
                    row, start, end = _spans(c.data, c.offsets, w, hit)
                    pairs = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"])
                    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(found) + 1)), pa.int32()), pairs)
                    counts = [pa.array(np.diff(w.first)), pa.array(total[w.first[1:]] - total[w.first[:-1]])]
                    columns = [batch.column(0)[c.rows], *counts, items_, spans]
                    if cut:
                        texts = batch.column(1)[c.rows]
                        if (bad := np.diff(spans.offsets.to_numpy()) > 0).any():
                            new = [without_spans(texts[int(i)].as_py(), spans[int(i)].as_py()) for i in np.flatnonzero(bad)]
                            texts = pa.compute.replace_with_mask(texts, pa.array(bad), pa.array(new, texts.type))
                        columns.append(texts)
                    yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "n_hit", "item_ids", "spans", *(["text"] if cut else [])])

        out = out.mapInArrow(scan, f"row {kept}, {FOUND}" + ", text string" * cut if last else f"row {kept}, text string, marks binary, found array<string>")
        if not last:
            out = stash(out, "searched")
    return out


def without_spans(text: str, spans: list[dict]) -> str:
    """The text without its spans."""
    at, out = 0, []
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["end"]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents with all benchmark passages cut out of their texts; see ``find_passages``.

    Every row and column is kept; the text of a row without hits, and a null text, stays as it is.
    """
    return find_passages(docs, benchmark, text_col, cut=True, **options).select(unpacked(docs, text_col))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: the id, n_words, n_hit, n_items, items_sha256 of the comma-joined item ids, contaminated."""
    found = find_passages(docs.select(id_col, options.get("text_col", "text")), benchmark, **options)
    return found.select(
        F.col(f"row.`{id_col}`").alias(id_col), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
