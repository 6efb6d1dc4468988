"""N-gram Jaccard self-join: a blocked sparse product of the document by n-gram incidence.

A document is the set of its word n-grams. Two documents link when their Jaccard similarity reaches the
threshold, exactly. The product of the incidence matrix with its transpose is never formed as a whole:

1. Equal sets become one row of the matrix, named by a 64-bit digest of the set together with its size.
2. A set of size n can only link with sets that share ceil(t n) of its columns, so under any one order of the columns
   linked sets share a column among the first n - ceil(t n) + 1 of each. The order puts rare columns first, by exact
   counts. Nearly all columns are in one row only and few rows need more than a fraction of theirs, so the counts are
   taken in two steps:

   a. of the columns whose hash lies in a fixed share of all hashes, over all rows. A row whose first columns are all
      found among those in few rows (``FEW`` at most) is finished; the others give all they have of these.
   b. of all columns, over the rows that step a leaves (those made mostly of columns that many rows share, and very
      short ones). Their pairs are found under the order of these counts.

   The rows of an early column with few rows are paired where their sizes and the column's places leave room for enough
   overlap; those of a column with many rows join one family. All other pairs are below their size-derived bound and
   are discarded unseen.
3. For the pairs, and inside each family, the product is accumulated over tiles of rows and blocks of columns.
   Before it, pairs whose sizes alone exclude a link are dropped; after each block of columns, those whose overlap so
   far plus what their sizes leave is below the bound. A family larger than a block is cut into blocks by bytes and
   rows, and each pair of blocks is a task; inside it tiles bound the memory whatever the number of rows.
4. The links' connected components give the classes.

A column that many rows of one task share is known to be crowded there: it leaves the task as one marker, or as a star
around one representative, so a column shared by a third of the rows arrives as a few rows a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import textkernel as K
from weftline.llm.components import connected_components
from weftline.llm.shared import drop, stash

U = np.uint64
KEYS_A_BUCKET = 250_000
FLUSH = 400_000  # column entries that a task gathers before it sends them
BLOCK_BYTES, BLOCK_ROWS, LEAST_ROWS, SPLITS = 32 << 20, 32_768, 2048, 4
FILTER_BITS, FILTER_IDS = 26, 4_000_000
COLUMNS, TILE = 4096, 1024
FEW = 8  # rows of a column that are paired one by one
ENTRY = np.dtype([("key", "<u8"), ("name", "<u8"), ("size", "<u4"), ("place", "<u4")])
SEEN = np.dtype([("key", "<u8"), ("name", "<u8"), ("count", "u1")])
PLAIN = np.dtype([("key", "<u8"), ("name", "<u8")])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of the rows of a chunk: hashes, offsets, digests."""
    words = K.words(K.LOWER[data], offsets, K.SPACE)
    hashes, at = K.distinct_shingles(words, n)
    digest = K.mix(K.sums_by_row(K.mix(hashes + U(0x51ED27)), at) + np.diff(at).astype(np.uint64))
    return hashes, at, digest


def low_bound(percent: int) -> int:
    """Hashes below it are the share of step a: somewhat more columns than a row's first n - ceil(t n) + 1."""
    return min(2**64 - 1, 7 * (100 - percent) * 2**64 // 400)


def early_count(sizes: np.ndarray, percent: int) -> np.ndarray:
    return sizes - -(-sizes * percent // 100) + 1


def by_bucket(entries: np.ndarray, field: str, bits: int, kind: int) -> Iterator[pa.RecordBatch]:
    """The entries as one blob for each range of the field's top bits."""
    entries = entries[np.argsort(entries[field], kind="stable")]
    cut = np.append(np.searchsorted(entries[field] >> U(64 - bits), np.arange(1 << bits, dtype=np.uint64)), len(entries))
    some = np.flatnonzero(np.diff(cut))
    if len(some):
        blobs = pa.array([entries[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([kind] * len(some), pa.int32()), blobs], ["bucket", "kind", "blob"])


def joined(table: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    blobs = [b for k, b in zip(table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True) if k == kind]
    return np.frombuffer(b"".join(blobs), dtype)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: where each run of equals starts, and for each key its run."""
    lead = np.ones(len(keys), bool)
    lead[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(lead), np.cumsum(lead) - 1


def distinct(entries: np.ndarray) -> np.ndarray:
    """Entries sorted by key and name, one of each such pair: the last, so the one with the highest count."""
    order = np.lexsort((*([entries["count"]] if "count" in entries.dtype.names else []), entries["name"], entries["key"]))
    entries = entries[order]
    keep = np.ones(len(entries), bool)
    keep[:-1] = (entries["key"][1:] != entries["key"][:-1]) | (entries["name"][1:] != entries["name"][:-1])
    return entries[keep]


def send_low(docs: DataFrame, n: int, percent: int, bits: int) -> DataFrame:
    """Step a, by text: (key, name) of the low columns by key (kind 0); keys crowded in the task (1) and their rows by name (2)."""
    bound = U(low_bound(percent))

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        entries = distinct(np.concatenate(parts))
        start, run = runs(entries["key"])
        many = np.diff(np.append(start, len(entries))) > FEW
        yield from by_bucket(entries[~many[run]], "key", bits, 0)
        yield from by_bucket(entries[start[many]], "key", bits, 1)
        yield from by_bucket(entries[many[run]], "name", bits, 2)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts, held = [np.zeros(0, PLAIN)], 0
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            for c in K.chunks(batch.column(1)):
                hashes, at, digest = shingle_sets(c.data, c.offsets, n)
                fresh = np.array([d not in seen for d in digest.tolist()], bool)
                seen.update(digest[fresh].tolist())
                keep = (hashes < bound) & np.repeat(fresh, np.diff(at))
                part = np.empty(int(keep.sum()), PLAIN)
                part["key"], part["name"] = hashes[keep], np.repeat(digest, np.diff(at))[keep]
                parts.append(part)
                held += len(part)
                if held >= FLUSH:
                    yield from flush(parts)
                    parts, held = [np.zeros(0, PLAIN)], 0
        if held:
            yield from flush(parts)

    return docs.mapInArrow(send, "bucket int, kind int, blob binary")


def count_low(sent: DataFrame, bits: int) -> DataFrame:
    """Step a, by key: (key, name, count) of the columns in two rows or more, sent by name; a count above FEW is FEW + 1."""

    def count(table: pa.Table) -> pa.Table:
        entries, crowded = distinct(joined(table, 0, PLAIN)), np.unique(joined(table, 1, PLAIN)["key"])
        start, run = runs(entries["key"])
        counts = np.minimum(np.diff(np.append(start, len(entries))), FEW + 1)
        counts[np.isin(entries["key"][start], crowded)] = FEW + 1
        counts = counts[run]
        out = np.zeros(int((counts > 1).sum()), SEEN)
        out["key"], out["name"], out["count"] = entries["key"][counts > 1], entries["name"][counts > 1], counts[counts > 1]
        own = joined(table, 2, PLAIN)
        local = np.zeros(len(own), SEEN)
        local["key"], local["name"], local["count"] = own["key"], own["name"], FEW + 1
        sent = list(by_bucket(np.concatenate([out, local]), "name", bits, 0))
        return pa.Table.from_batches(sent or [pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["bucket", "kind", "blob"])])

    return sent.groupBy("bucket").applyInArrow(count, "bucket int, kind int, blob binary")


def first_low(counted: DataFrame, sets: DataFrame, percent: int, bits: int) -> DataFrame:
    """Step a, by row: its first columns as entries by key (kind 0), and names of the rows left to step b (1)."""

    def choose(seen: pa.Table, sets: pa.Table) -> pa.Table:
        order = np.argsort(sets["digest"].to_numpy().view(np.uint64))
        name, size, low = (sets[c].to_numpy()[order] for c in ("digest", "n", "low"))
        name = name.view(np.uint64)
        start, run = runs(name)  # sets of equal digests and other sizes count as the first
        name, size, low = name[start], size[start], low[start]
        entries = distinct(joined(seen, 0, SEEN))
        at = np.searchsorted(name, entries["name"])
        order = np.lexsort((entries["key"], entries["count"], at))
        entries, at = entries[order], at[order]
        light = entries["count"] <= FEW
        shared, several = np.bincount(at, minlength=len(name)), np.bincount(at[light], minlength=len(name))
        entries, at = entries[light], at[light]
        early, alone = early_count(size, percent), low - shared
        left = alone + several < early
        place = alone[at] + np.arange(len(at)) - np.searchsorted(at, np.arange(len(name)))[at]
        use = place < early[at]
        out = np.zeros(int(use.sum()), ENTRY)
        out["key"], out["name"], out["size"], out["place"] = entries["key"][use], entries["name"][use], size[at[use]], place[use]
        rest = np.zeros(int(left.sum()), PLAIN)
        rest["name"] = name[left]
        sent = [*by_bucket(out, "key", bits, 0), *by_bucket(rest, "name", bits, 1)]
        return pa.Table.from_batches(sent or [pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["bucket", "kind", "blob"])])

    by_name = sets.withColumn("bucket", F.shiftrightunsigned("digest", 64 - bits).cast("int"))
    return counted.groupBy("bucket").cogroup(by_name.groupBy("bucket")).applyInArrow(choose, "bucket int, kind int, blob binary")


def all_columns(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Step b, by text: (key, name, n) of every column of the named rows."""

    docs, pick = chosen(docs, ids)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(pick, batches):
            for c in K.chunks(batch.column(1)):
                hashes, at, digest = shingle_sets(c.data, c.offsets, n)
                sizes = np.diff(at)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.repeat(digest, sizes).view(np.int64)), pa.array(np.repeat(sizes, sizes))], ["key", "name", "n"])

    return docs.mapInArrow(columns, "key long, name long, n long")


def first_of_all(columns: DataFrame, percent: int, total: int, bits: int) -> DataFrame:
    """Step b: the first columns of each row by exact counts, as entries by key (kind 0) and stars of crowded columns (1)."""
    counts = columns.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = columns.join(counts, "key").groupBy(F.expr(f"cast(pmod(name, {max(1, total // KEYS_A_BUCKET)}) as int)").alias("part"))

    def choose(table: pa.Table) -> pa.Table:
        key, name = (table[c].to_numpy().view(np.uint64) for c in ("key", "name"))
        size, rows = table["n"].to_numpy(), table["rows"].to_numpy()
        order = np.lexsort((key, rows, name))
        key, name, size, rows = key[order], name[order], size[order], rows[order]
        keep = np.ones(len(key), bool)  # texts that repeat under one id
        keep[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name, size = key[keep], name[keep], size[keep]
        start, run = runs(name)
        place = size - np.diff(np.append(start, len(name)))[run] + np.arange(len(name)) - start[run]
        use = place < early_count(size, percent)
        entries = np.empty(int(use.sum()), ENTRY)
        entries["key"], entries["name"], entries["size"], entries["place"] = key[use], name[use], size[use], place[use]
        entries, many, head = by_column(entries)
        edges = star(entries, many, head)
        crowd = entries[many & (head == np.arange(len(entries)))]
        crowd["size"] = 0
        sent = list(by_bucket(np.concatenate([entries[~many], crowd]), "key", bits, 0))
        if len(edges):
            sent.append(pa.RecordBatch.from_arrays([pa.array([int(edges[0, 0] % (1 << bits))], pa.int32()), pa.array([1], pa.int32()), pa.array([edges.tobytes()], pa.binary())], ["bucket", "kind", "blob"]))
        return pa.Table.from_batches(sent or [pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["bucket", "kind", "blob"])])

    return shared.applyInArrow(choose, "bucket int, kind int, blob binary")


def by_column(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by column, whether each one's column has more than FEW or arrives as such (size 0), and its head."""
    entries = entries[np.lexsort((entries["name"], entries["key"]))]
    lead = np.ones(len(entries), bool)
    lead[1:] = entries["key"][1:] != entries["key"][:-1]
    start = np.flatnonzero(lead)
    run = np.cumsum(lead) - 1
    count = np.diff(np.append(start, len(entries)))
    many = (count > FEW) | (np.add.reduceat(entries["size"] == 0, start) > 0 if len(start) else np.zeros(0, bool))
    return entries, many[run], start[run]


def star(entries: np.ndarray, many: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Distinct edges from the rows of crowded columns to the column's first row."""
    names = entries["name"]
    edges = np.stack([names[many], names[head[many]]], 1)
    return np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)


def near_pairs(entries: np.ndarray, percent: int) -> np.ndarray:
    """Distinct pairs of rows of the same column whose sizes and places leave room for enough overlap."""
    found = [np.zeros((0, 2), np.uint64)]
    for step in range(1, FEW):
        x, y = entries[:-step], entries[step:]
        same = (x["key"] == y["key"]) & (x["name"] != y["name"])
        x, y = x[same], y[same]
        n, m = x["size"].astype(np.int64), y["size"].astype(np.int64)
        need = -(-(n + m) * percent // (100 + percent))
        room = np.minimum(n - x["place"], m - y["place"]) >= need
        pair = np.sort(np.stack([x["name"][room], y["name"][room]], 1).view(np.int64), axis=1)
        found.append(pair.view(np.uint64))
    return np.unique(np.concatenate(found), axis=0)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """Classes of documents whose n-gram sets link at a Jaccard similarity of ``percent`` / 100 or more.

    Texts are lower-cased in A-Z and split at white space (space, U+0009 to U+000D); a text of fewer words than
    ``n`` is one n-gram. Returns a row for each input row: the id, n_shingles (set size), component_id (least id
    reachable by links, the own one included), n_links (other rows linked directly, equal sets included).

    Null and empty texts have no n-grams and link with nothing, so each is its own component. A row without an id
    counts its n-grams, links with nothing and has a null component_id. Repeated rows are rows of equal sets.
    Very long texts are processed whole. Other columns are neither read nor returned, so names cannot clash.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bound = U(low_bound(percent))

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                hashes, at, digest = shingle_sets(c.data, c.offsets, n)
                low = K.sums_by_row((hashes < bound).astype(np.int64), at)
                yield pa.RecordBatch.from_arrays([batch.column(0)[c.rows], pa.array(np.diff(at)), pa.array(low), pa.array(digest.view(np.int64))], ["id", "n", "low", "digest"])

    rows = stash(docs.mapInArrow(size, "id long, n long, low long, digest long"), "sets")
    linked = rows.where("id is not null and n > 0")
    sets = stash(linked.groupBy("digest", "n").agg(F.min("id").alias("id"), F.max("low").alias("low"), F.count(F.lit(1)).alias("copies")), "classes")
    bits = _bits(sets.agg(F.sum("low")).first()[0])
    early = stash(first_low(count_low(send_low(docs, n, percent, bits), bits), sets.select("digest", "n", "low"), percent, bits), "early")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(blob, PLAIN)["name"].view(np.int64).copy())], ["digest"])

    left = stash(early.where("kind = 1").select("blob").mapInArrow(names, "digest long").join(sets, "digest").select("id", "n"), "left")
    total = left.agg(F.sum("n")).first()[0] or 0
    columns = stash(all_columns(docs, left.select("id"), n), "columns")
    later = first_of_all(columns, percent, total, _bits(total))

    def meet(table: pa.Table) -> pa.Table:
        entries, many, head = by_column(joined(table, 0, ENTRY))
        edges = np.unique(np.concatenate([joined(table, 1, np.dtype("<u8")).reshape(-1, 2), star(entries, many, head)]), axis=0)
        pairs = near_pairs(entries[~many], percent)
        both = np.concatenate([edges, pairs]).view(np.int64)
        return pa.table({"a": both[:, 0].copy(), "b": both[:, 1].copy(), "crowded": np.arange(len(both)) < len(edges)})

    # places are only comparable under one order of the columns, so the two steps meet by themselves
    met = [d.groupBy("bucket").applyInArrow(meet, "a long, b long, crowded boolean") for d in (early.where("kind = 0"), later)]
    met = stash(met[0].unionByName(met[1]), "met")
    drop(early)
    drop(columns)
    family = connected_components(met.where("crowded").select("a", "b")).select(F.col("vertex").alias("digest"), F.col("component").alias("family"))
    home = lambda c: family.select(F.col("digest").alias(c), F.col("family").alias(f"f_{c}"))
    pairs = met.where("not crowded").select("a", "b").distinct().join(home("a"), "a", "left").join(home("b"), "b", "left")
    pairs = stash(pairs.where("f_a is null or f_b is null or f_a <> f_b").select("a", "b"), "pairs")
    links = _links(docs, sets, family, pairs, n, percent)
    linked = connected_components(links.where("a <> b").select("a", "b"))
    degree = links.groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    named = sets.join(linked.withColumnRenamed("vertex", "digest"), "digest", "left").join(degree, "digest", "left")
    named = stash(named.select("digest", "n", "id", "copies", F.coalesce("component", "digest").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "named")
    least = stash(named.groupBy("component").agg(F.min("id").alias("component_id")), "least")
    named = stash(named.join(least, "component").select("digest", "n", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), "result")
    out = rows.join(named, ["digest", "n"], "left").where("id is not null and n > 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = rows.where("id is null or n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def _links(docs: DataFrame, sets: DataFrame, family: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows (a, b, links): b is a set in whose component a is (a itself where it has no link), links counts rows."""
    members = stash(sets.join(family, "digest").select("id", "digest", "n", "copies", "family"), "members")
    total = members.groupBy("family").agg((F.sum("n") * 8).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    needed = F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.ceil(F.col("rows") / BLOCK_ROWS))
    splits = F.greatest(needed, F.least(F.ceil(F.col("rows") / LEAST_ROWS), F.lit(SPLITS))).cast("int")
    total = stash(total.select("family", splits.alias("splits"), "bytes"), "families")
    parts = total.select("family", "splits")
    members = members.join(parts, "family").withColumn("block", F.expr("cast(pmod(xxhash64(digest), splits) as int)"))
    other = F.explode(F.sequence(F.lit(0), F.col("splits") - 1))
    whole = members.withColumn("other", other).select("id", "digest", "copies", "family", (F.col("splits") == 1).alias("small"), "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # a pair is a row of the star of its first set: that set is block 0, its partners are block 1
    stars = pairs.select(F.col("a").alias("family"), F.col("b").alias("digest"), F.lit(1).alias("block"))
    stars = stars.unionByName(pairs.select(F.col("a").alias("family"), F.col("a").alias("digest"), F.lit(0).alias("block")).distinct())
    stars = stars.join(sets, "digest").select("id", "digest", "copies", "family", F.lit(True).alias("small"), "block", F.lit(0).alias("i"), F.lit(1).alias("j"))
    wanted = stash(whole.unionByName(stars), "wanted")
    in_pairs = pairs.select(F.col("b").alias("digest")).join(sets, "digest").agg(F.sum("n")).first()[0] or 0
    few = max(1, ((total.where("splits = 1").agg(F.sum("bytes")).first()[0] or 0) + 8 * in_pairs) >> 20)

    docs, pick = chosen(docs, wanted.select("id").distinct())

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(pick, batches):
            for c in K.chunks(batch.column(1)):
                hashes, at, digest = shingle_sets(c.data, c.offsets, n)
                blobs = pa.array([hashes[at[i] : at[i + 1]].tobytes() for i in range(len(digest))], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[c.rows], pa.array(digest.view(np.int64)), blobs], ["id", "digest", "grams"])

    rows = docs.mapInArrow(sets_of, "id long, digest long, grams binary").join(wanted, ["id", "digest"])
    rows = rows.withColumn("place", F.when(F.col("small"), F.pmod(F.xxhash64("family"), F.lit(few))).otherwise(F.col("family")))

    def product(table: pa.Table) -> pa.Table:
        order = np.argsort(table["family"].to_numpy(), kind="stable")
        family = table["family"].to_numpy()[order]
        digest, copies, block = (table[c].to_numpy()[order] for c in ("digest", "copies", "block"))
        grams = table["grams"].to_pylist()
        i, j = (table[c][0].as_py() for c in ("i", "j"))
        out = [np.zeros((0, 3), np.int64)]
        cut = np.append(np.flatnonzero(np.concatenate([[True], family[1:] != family[:-1]])), len(family))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own, keep = np.unique(digest[a:b], return_index=True)  # repeated rows of one id
            out.append(_block_links(own, copies[a:b][keep], block[a:b][keep], [np.frombuffer(grams[order[a + k]], np.uint64) for k in keep], i, j, percent))
        found = np.concatenate(out)
        return pa.table({"a": found[:, 0].copy(), "b": found[:, 1].copy(), "links": found[:, 2].copy()})

    rows = rows.select("small", "place", "i", "j", "family", "digest", "copies", "block", "grams")
    found = stash(rows.groupBy("small", "place", "i", "j").applyInArrow(product, "a long, b long, links long"), "links")
    drop(wanted)
    return found


def _filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, of 2**FILTER_BITS bits whatever the number of ids: a set bit may be another id's."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = K.mix(batch.column(0).to_numpy().view(np.uint64)) >> U(64 - FILTER_BITS)
            word, place = np.unique(bit >> U(6), return_inverse=True)
            mask = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(mask, place, U(1) << (bit & U(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(mask.view(np.int64))], ["word", "mask"])

    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    got = ids.mapInArrow(words, "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out[got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return out


def _marked(bitmap: np.ndarray, ids: pa.Array) -> np.ndarray:
    bit = K.mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> U(64 - FILTER_BITS)
    return (bitmap[bit >> U(6)] >> (bit & U(63))) & U(1) == 1


def chosen(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """A table of the rows of the distinct ``ids`` and perhaps others, and what picks the former from a batch.

    Up to FILTER_IDS ids the rows are picked by a bitmap of fixed size (a false hit in about 16 at most); with more, by a
    join, which moves the texts.
    """
    docs = docs.where("id is not null and text is not null")
    if ids.count() > FILTER_IDS:
        return docs.join(ids, "id", "left_semi").select("id", "text"), lambda batch: batch
    marked = docs.sparkSession.sparkContext.broadcast(_filter(ids))
    return docs, lambda batch: batch.filter(pa.array(_marked(marked.value, batch.column(0))))


def _bits(keys: int | None) -> int:
    """So many bits give buckets of about KEYS_A_BUCKET keys, 32 buckets at least."""
    return max(5, int(np.ceil(np.log2(max(1, (keys or 0) / KEYS_A_BUCKET)))))


def _block_links(names: np.ndarray, copies: np.ndarray, block: np.ndarray, sets: list[np.ndarray], i: int, j: int, percent: int) -> np.ndarray:
    """Links between the sets of block i and those of block j, as a forest with each set's number of linked rows.

    Rows are sorted by size and taken in tiles, so pairs of tiles whose sizes differ too much are passed over and memory
    is bounded by a tile.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((sizes, block))
    names, copies, block, sizes, sets = names[order], copies[order], block[order], sizes[order], [sets[k] for k in order]
    cut = int(np.searchsorted(block, i, "right")) if i != j else len(names)
    if len(names) < 2 or not cut or (i != j and cut == len(names)):
        return np.zeros((0, 3), np.int64)
    column = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    row = np.repeat(np.arange(len(sets)), sizes)
    twice = np.bincount(column) > 1  # columns of one row add to no overlap
    row, column = row[twice[column]], (np.cumsum(twice) - 1)[column[twice[column]]]
    first = np.searchsorted(row, np.arange(len(sets) + 1))
    links, forest = np.zeros(len(names)), [np.zeros((0, 2), np.int64)]
    for a in range(0, cut, TILE):
        left = slice(a, min(a + TILE, cut))
        for b in range(a if i == j else cut, len(names), TILE):
            right = slice(b, min(b + TILE, len(names)))
            x, y = _tile_links(left, right, sizes, row, column, first, percent)
            links += np.bincount(x, copies[y], len(names)) + np.bincount(y, copies[x], len(names))
            forest.append(_forest(x, y))
    edges = np.concatenate(forest)
    label = np.arange(len(names))
    tree = _forest(edges[:, 0], edges[:, 1])
    label[tree[:, 0]] = tree[:, 1]
    used = links > 0
    return np.stack([names[used], names[label[used]], links[used].astype(np.int64)], 1)


def _tile_links(left: slice, right: slice, sizes: np.ndarray, row: np.ndarray, column: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows (x, y) of two tiles, x < y."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    need = -(-(sizes[left][:, None] + sizes[right][None, :]) * percent // (100 + percent))
    alive = np.minimum(sizes[left][:, None], sizes[right][None, :]) >= need
    if left == right:
        alive &= np.arange(left.start, left.stop)[:, None] < np.arange(right.start, right.stop)[None, :]
    if not alive.any():
        return nothing
    parts = [(row[first[t.start] : first[t.stop]] - t.start, column[first[t.start] : first[t.stop]]) for t in (left, right)]
    both = np.intersect1d(np.unique(parts[0][1]), np.unique(parts[1][1]), assume_unique=True)
    if not len(both):
        return nothing
    kept = []
    for t, (r, c) in zip((left, right), parts, strict=True):
        at = np.minimum(np.searchsorted(both, c), len(both) - 1)
        in_both = both[at] == c
        r, at = r[in_both], at[in_both]
        order = np.argsort(at, kind="stable")
        kept.append((r[order], at[order], np.bincount(r, minlength=t.stop - t.start)))
    overlap = np.zeros(alive.shape, np.float32)
    rest = [k[2] for k in kept]
    for low in range(0, len(both), COLUMNS):
        alive &= overlap + np.minimum(rest[0][:, None], rest[1][None, :]) >= need
        if not alive.any():
            return nothing
        dense = []
        for side, (r, at, count) in enumerate(kept):
            a, b = np.searchsorted(at, [low, low + COLUMNS])
            incidence = np.zeros((len(count), min(COLUMNS, len(both) - low)), np.float32)
            incidence[r[a:b], at[a:b] - low] = 1
            rest[side] = rest[side] - np.bincount(r[a:b], minlength=len(count))
            dense.append(incidence)
        overlap += dense[0] @ dense[1].T
    x, y = np.nonzero(alive & (overlap >= need))
    return x + left.start, y + right.start


def _forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Edges from each vertex of the given ones to the least of its component."""
    vertex, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    label = np.arange(len(vertex))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]
        if (low == label).all():
            return np.stack([vertex, vertex[label]], 1)
        label = low
