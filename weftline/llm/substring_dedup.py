"""Repeated passages across documents, by hashing normalised units."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm import textkernel as K
from weftline.llm.shared import drop, stash

U = np.uint64
NEWLINE = 0x0A
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?"]] = True
_MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def chosen(hashes: np.ndarray, row: np.ndarray, among: int) -> np.ndarray:
    """Places that have the least hash of some ``among`` neighbours in their row (or of all, where there are fewer); the last of equals.

    The choice depends on the neighbours alone: equal stretches of ``among`` hashes have the same place chosen.
    """
    n = len(hashes)
    reach = np.ones(n, np.int64)
    for step, least in ((-1, np.greater_equal), (1, np.greater)):
        on = np.ones(n, bool)
        for j in range(1, min(among, n)):
            a, b = (slice(j, n), slice(0, n - j)) if step < 0 else (slice(0, n - j), slice(j, n))
            on[a] &= (row[a] == row[b]) & least(hashes[b], hashes[a])
            on[: j if step < 0 else 0] = False
            on[n - j if step > 0 else n :] = False
            reach += on
    return np.flatnonzero(reach >= np.minimum(among, np.bincount(row)[row] if n else 0))


def units(data: np.ndarray, offsets: np.ndarray, unit: str, window: int = 0, among: int = 12) -> tuple[np.ndarray, ...]:
    """Units of a chunk's rows: row, first word in the row, start and end code point, words, and two 64-bit digests.

    A unit is normalised to its words in lower case (A-Z), so white space and blank lines around it don't count.
    With ``window`` there follow, wherever they stand, the windows of so many words that ``chosen`` picks.
    """
    w = K.words(K.LOWER[data], offsets, K.SPACE)
    if not len(w.start):
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    lines = np.zeros(len(data) + 1, np.int64)
    newline = data == NEWLINE
    np.cumsum(newline, out=lines[1:])
    between = lines[w.start[1:]] - lines[w.end[:-1]]
    cut = np.ones(len(w.start), bool)
    cut[1:] = (between >= (2 if unit == "paragraph" else 1)) | (w.row[1:] != w.row[:-1])
    if unit == "sentence":
        cut[1:] |= STOPS[data[w.end[:-1] - 1]]
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(w.start))
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    digests = []
    for m in _MULTIPLIERS:
        sums = np.zeros(len(w.hashes) + 1, np.uint64)
        np.cumsum(w.hashes * K._power(m, len(w.hashes)), out=sums[1:])
        digests.append(K.mix((sums[last] - sums[first]) * K._power(pow(m, -1, 1 << 64), len(w.hashes) + 1)[first] + (last - first).astype(np.uint64)).view(np.int64))
    if window:
        hashes, at = K.windows(w.hashes, w.first, window)
        pick = chosen(hashes, w.row[at], among)
        first, last = np.append(first, at[pick]), np.append(last, at[pick] + window)
        digests = [np.append(digests[0], hashes[pick].view(np.int64)), np.append(digests[1], np.full(len(pick), -window))]
    row = w.row[first]
    base = points[offsets[row]]
    return row, first - w.first[row], points[w.start[first]] - base, points[w.end[last - 1]] - base, last - first, *digests


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 20, windows: int = 0) -> DataFrame:
    """Spans to remove: runs of units and windows that occur earlier, of at least ``min_words`` words.

    Units are lines, paragraphs (parts between blank lines) or sentences (parts of a line that end in a word with
    one of ``.!?``), compared by their lower-cased words. Occurrences rank by (id, start); the first stays, all
    others are marked, and adjacent marked units of a document merge. Returns a row per span: the id, start and end
    (code points of the original text), n_words, n_units, kept_doc_id and kept_start of the first unit's earliest
    occurrence.

    With ``windows`` also windows of ``min_words`` words are compared, wherever they stand: of every ``windows``
    neighbours the one with the least hash, so that each run of min_words + windows - 1 words or more that occurs
    earlier is marked but for fewer than ``windows`` words at either end. Marked windows merge with what they touch
    or overlap and count in n_units.

    Null and empty texts have no units; rows without an id have no rank and take no part. Repeated rows of one id
    and text share their ranks, so they stay or go together. Texts are read whole; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                row, word, start, end, n, d1, d2 = units(c.data, c.offsets, unit, min_words if windows else 0, windows)
                ids = batch.column(0)[c.rows].take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (word.astype(np.int32), start.astype(np.int32), end.astype(np.int32), n.astype(np.int32), d1, d2))], ["id", "word", "start", "end", "n", "d1", "d2"])

    parts = stash(docs.mapInArrow(cut, "id long, word int, start int, end int, n int, d1 long, d2 long"), "units")
    seen = parts.groupBy("d1", "d2").agg(F.min(F.struct("id", "start")).alias("kept"), F.max(F.struct("id", "start")).alias("last"))
    seen = stash(seen.where("kept <> last").select("d1", "d2", F.col("kept.id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start")), "repeats")
    again = parts.join(seen, ["d1", "d2"]).where("id <> kept_doc_id or start <> kept_start")
    again = stash(again.select("id", "word", "start", "end", "n", "kept_doc_id", "kept_start"), "again")
    drop(parts)
    order = W.partitionBy("id").orderBy("word", "n", "start", "end", "kept_doc_id", "kept_start")
    stop = F.col("word") + F.col("n")
    new = F.col("word") > F.coalesce(F.max(stop).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    islands = again.distinct().withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = islands.groupBy("id", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max(stop) - F.min("word")).cast("long").alias("n_words"), F.count(F.lit(1)).alias("n_units"),
        F.min_by(F.struct("kept_doc_id", "kept_start"), F.struct("start", "kept_doc_id", "kept_start")).alias("kept"),
    )
    spans = spans.where(F.col("n_words") >= min_words)
    return spans.select(F.col("id").alias(id_col), F.col("start").cast("long"), F.col("end").cast("long"), "n_words", "n_units", "kept.kept_doc_id", F.col("kept.kept_start").cast("long").alias("kept_start"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "removed", **options) -> DataFrame:
    """``docs`` with the repeated spans cut out of the texts and listed, with original offsets, in ``removed_col``.

    All rows and columns are kept; null texts and rows without an id stay as they are. A column that is already named
    ``removed_col`` is replaced.
    """
    spans = repeated_spans(docs, id_col, text_col, **options).groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    carried = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(spans, "id", "left")
    text, cuts = F.col("text"), F.col("cuts")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts, lambda s: s["end"]))
    ends = F.concat(F.transform(cuts, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    rest = F.when(cuts.isNull(), text).otherwise(F.array_join(pieces, ""))
    kept = [rest.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != removed_col]
    return carried.select(*kept, cuts.alias(removed_col))
