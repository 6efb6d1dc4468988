"""Packing of tokenised documents into fixed-length sequences along a Hilbert curve of hashed document vectors."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm import textkernel as K
from weftline.llm.shared import drop, stash

U = np.uint64
DIMENSIONS, BITS = 4, 8
BIN_BITS = 16  # sums along the curve are made in 2**BIN_BITS bins, whatever the input
MOST_RANGES = 1 << 17
#: Fixed value: how byte-level BPE files of this kind split texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space outside ASCII, as UTF-8: texts with any of these are tokenised as a whole.
WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points with integer coordinates below 2**bits (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_position(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hilbert positions of a chunk's rows, and hashes of their words: each word's hash gives a sign in each dimension; signs are averaged."""
    w = K.words(K.LOWER[data], offsets, K.SPACE)
    count = np.maximum(np.diff(w.first), 1)
    cells = np.empty((len(count), DIMENSIONS), np.int64)
    for d in range(DIMENSIONS):
        ones = K.sums_by_row(((w.hashes >> U(11 * d)) & U(1)).astype(np.int64), w.first)
        mean = (2 * ones - np.diff(w.first)) / count
        cells[:, d] = np.clip((np.tanh(3 * mean) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(cells, BITS), K.sums_by_row(w.hashes, w.first)


def range_cuts(docs: DataFrame, text_col: str, range_bytes: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """How many ranges, all bytes, and the positions on the curve where ranges begin, with the bytes before each and at it.

    Bytes of text (and some for each row) are counted for each position, which takes a few bytes a document, and summed
    up along the curve: inside each of 2**16 bins by a window over at most 2**16 positions, over the bins on the driver.
    Only the positions that begin a range, that outweigh a range or follow such a one, and the first of each bin come
    to the driver: at most 2**16 and three for each range.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(0)):
                at, inverse = np.unique(curve_position(c.data, c.offsets)[0], return_inverse=True)
                own = np.bincount(inverse, np.diff(c.offsets) + 64, len(at)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own)], ["at", "own"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(measure, "at long, own long").groupBy("at").agg(F.sum("own").alias("own"))
    places = stash(counted.select((F.col("at") / 2 ** (DIMENSIONS * BITS - BIN_BITS)).cast("int").alias("bin"), "at", "own"), "places")
    bins = places.groupBy("bin").agg(F.sum("own").alias("own")).orderBy("bin").toArrow()
    own = bins["own"].to_numpy()
    total = max(1, int(own.sum()))
    ranges = min(MOST_RANGES, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes)))
    starts = docs.sparkSession.createDataFrame(pa.table({"bin": bins["bin"], "start": pa.array(np.cumsum(own) - own, pa.int64())}))
    order = W.partitionBy("bin").orderBy("at")
    run = places.select("*", (F.sum("own").over(order) - F.col("own")).alias("within"), F.lag("own").over(order).alias("last")).join(F.broadcast(starts), "bin")
    begins = lambda before: F.floor(before * ranges / total)
    before = (F.col("start") + F.col("within")).cast("double")
    cut = F.col("last").isNull() | (begins(before) != begins(before - F.col("last"))) | (F.greatest("own", "last").cast("double") * ranges > total)
    got = run.where(cut).select("at", before.alias("before"), "own").orderBy("at").toArrow()
    drop(places)
    return ranges, total, got["at"].to_numpy(), got["before"].to_numpy(), got["own"].to_numpy().astype(float)


_PUNCTUATION, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def byte_tokens(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """The vocabulary of a byte-level BPE tokenizer file by the bytes of its tokens, and its added tokens by their text.

    Such files write each byte as a printable character: printable Latin-1 characters as they are, the other bytes in
    ascending order as the characters from U+0100.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    special = {t["content"]: t["id"] for t in described["added_tokens"]}
    return {bytes(byte_of[c] for c in t): i for t, i in described["model"]["vocab"].items() if t not in special}, special


class Encoder:
    """Token ids of whole texts by a byte-level BPE tokenizer file, with each distinct piece tokenised once.

    The tokenizer's pattern splits texts before a space that leads a word, inside white space only before its last
    character, and between a letter and ASCII punctuation. Texts are cut at those places, which changes no token, and
    equal pieces share their ids. Texts with white space outside ASCII are tokenised as they are, and so are those with
    an added token of the file, such as an end-of-text mark: that is one id, and what stands beside it is split by itself.
    The store of pieces is emptied when it has grown to ``most``.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        tokens, self.special = byte_tokens(path)
        self.marks = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=lambda t: (-len(t), t))) + ")") if self.special else None
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=tokens, special_tokens={})
        self.size = np.zeros(max(tokens.values()) + 1, np.int64)
        for t, i in tokens.items():
            self.size[i] = len(t)
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.known, self.place, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self._ids(t) for t in texts]
        return np.array([x for i in ids for x in i], np.uint16), np.array([len(i) for i in ids], np.int64)

    def _ids(self, text: str) -> list[int]:
        parts = self.marks.split(text) if self.marks else [text]
        return [i for k, p in enumerate(parts) for i in ([self.special[p]] if k % 2 else self.bpe.encode_ordinary(p))]

    def _add(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Tokenise new pieces: those led by a space as one text, whose tokens never run over a piece's end."""
        led = np.array([p[:1] == b" " and len(p) > 1 for p in pieces], bool)
        joined = np.array(self.bpe.encode_ordinary(b"".join(p for p, x in zip(pieces, led, strict=True) if x).decode()), np.int64)
        ends = np.searchsorted(np.cumsum(self.size[joined]), np.cumsum([len(p) for p, x in zip(pieces, led, strict=True) if x])) + 1
        alone, length = self._encode([p.decode() for p, x in zip(pieces, led, strict=True) if not x])
        order = np.concatenate([np.flatnonzero(led), np.flatnonzero(~led)])
        length = np.concatenate([np.diff(ends, prepend=0) if led.any() else np.zeros(0, np.int64), length])
        ids = np.concatenate([joined.astype(np.uint16), alone])
        place = np.empty(len(pieces), np.int64)
        place[order] = self.used + np.cumsum(length) - length
        own = np.empty(len(pieces), np.int64)
        own[order] = length
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        at = np.searchsorted(self.known, hashes)
        self.known, self.place, self.length = np.insert(self.known, at, hashes), np.insert(self.place, at, place), np.insert(self.length, at, own)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk's rows one after another, and the rows' offsets into them."""
        space = K.SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        first = offsets[:-1][np.diff(offsets) > 0]
        word = np.flatnonzero(~space & np.append(True, space[:-1]))  # white space, then a word
        word = word[word > 0]
        row_start = np.zeros(len(data) + 1, bool)
        row_start[first] = True
        word = word[~row_start[word]]
        cut[word - 1] = True  # the last of the white space leads the word, or stands alone
        cut[word[data[word - 1] != 0x20]] = True
        cut[np.flatnonzero(~space[:-1] & space[1:]) + 1] = True
        mark = np.flatnonzero(_PUNCTUATION[data[1:]]) + 1 if len(data) else np.zeros(0, np.int64)
        wide = (data[mark - 1] >= 0x80) & (data[mark - 2] == 0xC3) & (data[mark - 1] != 0x97) & (data[mark - 1] != 0xB7)
        cut[mark[_LETTER[data[mark - 1]] | (wide & (mark > 1))]] = True
        cut[first] = True
        start = np.flatnonzero(cut[:-1])
        end = np.append(start[1:], len(data))
        hashes = K.span_hashes(data, start, end)
        unique, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self._clear()
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != unique[inside]
        if new.any():
            raw, some = data.tobytes(), index[new]
            self._add(unique[new], [raw[a:b] for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)])
            at = np.searchsorted(self.known, unique)
        place, length = self.place[at][inverse], self.length[at][inverse]
        ends = np.cumsum(length)
        ids = self.ids[np.repeat(place - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.append(0, ends)[np.searchsorted(start, offsets)]
        odd = self._odd(data, offsets)
        if len(odd):
            raw = data.tobytes()
            whole, sizes = self._encode([raw[offsets[r] : offsets[r + 1]].decode() for r in odd])
            parts, done, taken = [], 0, 0
            for r, n in zip(odd, sizes, strict=True):
                parts += [ids[done : bounds[r]], whole[taken : taken + n]]
                done, taken = bounds[r + 1], taken + n
            per_row = np.diff(bounds)
            per_row[odd] = sizes
            ids, bounds = np.concatenate([*parts, ids[done:]]), np.append(0, np.cumsum(per_row))
        return ids, bounds

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows with an added token or with white space outside ASCII."""
        raw, marked = data.tobytes(), []
        for token in self.special:
            at = raw.find(token.encode())
            while at >= 0:
                marked.append(at)
                at = raw.find(token.encode(), at + 1)
        return np.union1d(self._wide(data, offsets), np.searchsorted(offsets, np.array(marked, np.int64), "right") - 1).astype(np.int64)

    @staticmethod
    def _wide(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
        if not len(lead):
            return lead
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        hit = np.zeros(len(lead), bool)
        for s in WIDE_SPACES:
            same = np.ones(len(lead), bool)
            for k, b in enumerate(s):
                same &= padded[lead + k] == b
            hit |= same
        return np.unique(np.searchsorted(offsets, lead[hit], "right") - 1)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, keep_ids: bool = True, range_bytes: int = 64 << 20) -> DataFrame:
    """Pieces of tokenised documents, laid gaplessly into sequences of at most ``length`` tokens.

    A document is its token ids (``tokenizer`` is the path of a tokenizer file that all executors have), then id 0; a
    null or empty text is the id 0 alone. Documents are sorted by ranges of the Hilbert position of their hashed word
    vectors, then by id and text, and each range is packed along the curve and cut freely. The ranges are cut from an
    exact count of the texts' bytes at all positions of the curve, so that they have about equal bytes, about
    ``range_bytes`` at most up to 2**17 ranges: long texts lie close together on the curve. All sequences of a range are full but the last
    tokens, which fill sequences of decreasing powers of two, so none needs padding.

    Returns a row per piece: the id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit integers),
    doc_tokens, sequence_id, offset, and with ``keep_ids`` the ids. Repeated rows are packed as often as they occur,
    rows without an id too; long texts are tokenised whole; other columns are not read. Only a sequence that is not
    full yet is held across documents; only documents at one and the same position that outweigh a range together are spread over ranges,
    by a hash of id and words.
    """
    ranges, total, *found = range_cuts(docs, text_col, range_bytes)
    cuts = docs.sparkSession.sparkContext.broadcast(found)
    fields = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before, own = cuts.value
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                ids = batch.column(0)[c.rows]
                curve, words = curve_position(c.data, c.offsets)
                within = K.mix(K.mix(ids.fill_null(0).to_numpy().view(np.uint64)) + words) / 2.0**64
                at = np.searchsorted(first, curve, "right") - 1
                spread = (first[at] == curve) & (own[at] * ranges > total)
                part = np.minimum((before[at] + within * own[at] * spread) * ranges / total, ranges - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids, batch.column(1)[c.rows], pa.array(curve), pa.array(part)], ["id", "text", "curve", "part"])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = Encoder(tokenizer), TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # pieces of the open sequence: id, start, ids, doc_tokens
        fill = 0
        out: list[tuple] = []

        def close(pieces: list[tuple], number: int) -> None:
            at = 0
            for doc, start, ids, total in pieces:
                out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, at, ids))
                at += len(ids)

        def rows() -> pa.RecordBatch:
            doc, *numbers, ids = zip(*out, strict=True) if out else [()] * 8
            columns = [pa.array(doc, pa.int64()), *(pa.array(n, pa.int64()) for n in numbers)]
            if keep_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["id", *fields, *(["ids"] if keep_ids else [])])

        for batch in batches:
            for c in K.chunks(batch.column(1)):
                ids, at = encoder.encode(c.data, c.offsets)
                for i, doc in enumerate(batch.column(0)[c.rows].to_pylist()):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint16(0))
                    done = 0
                    while done < len(own):
                        piece = own[done : done + length - fill]
                        held.append((doc, done, piece, len(own)))
                        done, fill = done + len(piece), fill + len(piece)
                        if fill == length:
                            close(held, sequence)
                            held, fill, sequence = [], 0, sequence + 1
                yield rows()
        while fill:
            size = 1 << (fill.bit_length() - 1)
            full, rest, room = [], [], size
            for doc, start, piece, total in held:
                if room:
                    full.append((doc, start, piece[:room], total))
                if len(piece) > room:
                    rest.append((doc, start + room, piece[room:], total))
                room = max(0, room - len(piece))
            close(full, sequence)
            held, fill, sequence = rest, fill - size, sequence + 1
        yield rows()

    placed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(place, "id long, text string, curve long, part int")
    ranged = placed.repartitionById(ranges, F.col("part")).sortWithinPartitions("curve", "id", "text").select("id", "text")
    schema = "id long, " + ", ".join(f"{f} long" for f in fields) + (", ids array<int>" if keep_ids else "")
    return ranged.mapInArrow(lay, schema).withColumnRenamed("id", id_col)
