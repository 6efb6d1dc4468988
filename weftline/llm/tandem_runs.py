"""Periodic runs of words by the linear tandem-repeat method: Lempel-Ziv blocks, a suffix tree, suffix-link walks.

Blocks of the text give squares that cover the leftmost occurrence of every square; walks along suffix links from
their places in the suffix tree find the other rotations, which completes the vocabulary of squares; the leaves below
each place are its occurrences, and neighbouring occurrences of one period merge into a run.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import textkernel as K
from weftline.llm.shared import row_type, with_row

TOGETHER = 1 << 18  # words of several stretches that share a suffix tree; a longer stretch has its own
PAIRS = 1 << 20  # pairs of places compared at once
WINDOW = 8

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
RUN_TYPE = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])


class Names:
    """Names of all substrings of 2**k symbols (equal names for equal substrings), in their sorted order.

    The text must end in a symbol of its own; a substring that passes the end of the text stops there.
    """

    def __init__(self, text: np.ndarray):
        n = len(text)
        at = np.arange(n)
        level = np.unique(text, return_inverse=True)[1]
        self.levels: list[np.ndarray] = []
        while True:
            padded = np.full(n + 1, -1, np.int32)
            padded[:n] = level
            if n == 0 or int(level.max()) + 1 == n:
                break
            self.levels.append(padded)
            key = level.astype(np.int64) * (n + 2) + padded[np.minimum(at + (1 << (len(self.levels) - 1)), n)] + 1
            level = np.unique(key, return_inverse=True)[1]
        self.rank = padded[:n].astype(np.int64)
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = at

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common beginnings of the suffixes at a and b, a <> b."""
        a, b, start = a.copy(), b.copy(), a
        for k in range(len(self.levels) - 1, -1, -1):
            same = self.levels[k][a] == self.levels[k][b]
            a += same.astype(np.int64) << k
            b += same.astype(np.int64) << k
        return a - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common ends of the prefixes that stop before a and before b, a < b."""
        a, b, start = a.copy(), b.copy(), a
        for k in range(len(self.levels) - 1, -1, -1):
            step = 1 << k
            same = (a >= step) & (self.levels[k][np.maximum(a - step, 0)] == self.levels[k][np.maximum(b - step, 0)])
            a -= same.astype(np.int64) << k
            b -= same.astype(np.int64) << k
        return start - a


def longest_earlier(rank: np.ndarray, lcp: np.ndarray) -> list[int]:
    """For each place the length of the longest substring from there that also starts at an earlier place."""
    n = len(rank)
    before, after, shared = list(range(-1, n)), list(range(1, n + 2)), [*lcp.tolist(), 0]
    out = [0] * n
    ranks = rank.tolist()
    for i in range(n - 1, -1, -1):  # later places are gone from the list of sorted suffixes
        r = ranks[i]
        p, q = before[r], after[r]
        a, b = shared[r], shared[q]
        if a > b:
            out[i], shared[q] = a, b
        else:
            out[i], shared[q] = b, a
        before[q] = p
        if p >= 0:
            after[p] = q
    return out


def blocks(earlier: list[int]) -> np.ndarray:
    """Where the Lempel-Ziv blocks start: each is the longest substring that starts earlier too, or one new symbol."""
    starts, i, n = [], 0, len(earlier)
    while i < n:
        starts.append(i)
        i += earlier[i] or 1
    return np.array(starts, np.int64)


def _spans(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (first[i], k) for k from 1 to count[i], at most about PAIRS at a time."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, PAIRS):
        j = np.arange(at, min(total, at + PAIRS))
        i = np.searchsorted(ends, j, "right")
        yield first[i], j - (ends[i] - count[i]) + 1


def covering_squares(names: Names, starts: np.ndarray) -> np.ndarray:
    """Rows (start, half length) of squares such that each square's leftmost occurrence lies in a stretch of starts that one begins.

    A leftmost occurrence has its middle in some block and ends in that block or the next one. So its first half holds the
    block's first symbol, or its second half that of the next block; common extensions to both sides of these two
    places at each distance find it.
    """
    n = len(names.rank)
    ends = np.append(starts[1:], n)
    size = ends - starts
    both = np.minimum(size + np.append(size[1:], 0), n - 1 - starts)
    found = []
    level = np.floor(np.log2(np.arange(1, n + 2))).astype(np.int64)
    cases = [(starts, both, 0), (starts[1:], size[:-1], 1)]
    for first, count, left in cases:
        for at, k in _spans(first, count):
            a = at - k if left else at
            keep = (a > 0) if left else (at > 0)
            # one of the two extensions has at least half of k: compare a power of two of symbols first
            half = np.minimum(level[(k + 1) // 2 - 1], len(names.levels) - 1)
            near = np.zeros(len(k), bool)
            for t in range(len(names.levels)):
                own = np.flatnonzero(half == t)
                x, y, step = a[own], a[own] + k[own], 1 << t
                back = (x >= step) & (names.levels[t][np.maximum(x - step, 0)] == names.levels[t][np.maximum(y - step, 0)])
                near[own] = back | (names.levels[t][x] == names.levels[t][y])
            keep = near & (keep | (names.levels[0][a] == names.levels[0][a + k]) if len(names.levels) else keep)
            a, k = a[keep], k[keep]
            back, ahead = names.backward(a, a + k), names.forward(a, a + k)
            square = back + ahead >= k
            found.append(np.stack([a[square] - back[square], k[square]], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _primitive(names: Names, squares: np.ndarray) -> np.ndarray:
    """The squares whose half is no repetition itself."""
    if not len(squares):
        return squares
    at, half = squares[:, 0], squares[:, 1]
    most = int(half.max())
    least = np.zeros(most + 1, np.int64)  # least prime factor
    for p in range(2, int(most**0.5) + 1):
        if not least[p]:
            multiples = least[p * p :: p]
            multiples[multiples == 0] = p
    least[least == 0] = np.arange(most + 1)[least == 0]
    rest, keep = half.copy(), np.ones(len(half), bool)
    while (live := np.flatnonzero(keep & (rest > 1))).size:
        p = least[rest[live]]
        step = half[live] // p
        keep[live] = names.forward(at[live], at[live] + step) < 2 * half[live] - step
        rest[live] //= p
    return squares[keep]


class Tree:
    """The suffix tree as intervals of sorted suffixes: of each inner node its depth, first and last leaf and parent."""

    def __init__(self, lcp: np.ndarray):
        n = len(lcp)
        depth, left, right, parent, leaf = [0], [0], [n - 1], [0], [0] * n
        stack = [0]
        values = [*lcp.tolist(), 0]
        for r in range(1, n + 1):
            value = values[r]
            top = stack[-1]
            if value <= depth[top]:
                leaf[r - 1] = top
            begin, last = r - 1, -1
            while depth[stack[-1]] > value:
                v = stack.pop()
                right[v] = r - 1
                begin = left[v]
                if depth[stack[-1]] >= value:
                    parent[v], last = stack[-1], -1
                else:
                    last = v
            if depth[stack[-1]] < value:
                u = len(depth)
                depth.append(value)
                left.append(begin)
                right.append(n - 1)
                parent.append(stack[-1])
                if last >= 0:
                    parent[last] = u
                if begin == r - 1:
                    leaf[r - 1] = u
                stack.append(u)
        self.depth, self.left, self.right, self.leaf = (np.array(x, np.int64) for x in (depth, left, right, leaf))
        self.up = [np.array(parent, np.int64)]
        while (self.up[-1] != 0).any():
            self.up.append(self.up[-1][self.up[-1]])

    def locate(self, leaf: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The highest nodes above the leaves that are at least so deep: a node's number, or -1 - leaf."""
        v = self.leaf[leaf]
        inner = self.depth[v] >= depth
        for up in reversed(self.up):
            above = up[v]
            v = np.where(self.depth[above] >= depth, above, v)
        return np.where(inner, v, -1 - leaf)


def vocabulary(text: np.ndarray, names: Names, tree: Tree, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All squares of primitive halves, as (first leaf, last leaf, half length), by walks along suffix links.

    From the place of a square that starts with symbol a, the link leads to the place of the rest; if a can follow there,
    that is the place of the next rotation, which is a square too. A walk ends where none follows or one is known.
    """
    rank, order, n = names.rank.tolist(), names.order.tolist(), len(text)
    depths, left, right, leaf, symbols = tree.depth.tolist(), tree.left.tolist(), tree.right.tolist(), tree.leaf.tolist(), text.tolist()
    ups = [u.tolist() for u in reversed(tree.up)]

    def place(r: int, depth: int) -> int:
        v = leaf[r]
        if depths[v] < depth:
            return -1 - r
        for up in ups:
            if depths[up[v]] >= depth:
                v = up[v]
        return v

    known: set[tuple[int, int]] = set()
    for i, half in squares.tolist():
        v = place(rank[i], 2 * half)
        while (v, half) not in known:
            known.add((v, half))
            a, size = symbols[i], 2 * half - 1
            v = place(rank[i + 1], size)
            if v < 0 or depths[v] > size:  # within an edge: one symbol follows
                i = i + 1
                if i + size >= n or symbols[i + size] != a:
                    break
                if v >= 0:
                    v = place(rank[i], 2 * half)
            else:  # the first suffix below that goes on with a
                low, high, wanted = left[v], right[v] + 1, names.levels[0][i]
                while low < high:
                    middle = (low + high) // 2
                    if names.levels[0][order[middle] + size] < wanted:
                        low = middle + 1
                    else:
                        high = middle
                if low > right[v] or symbols[order[low] + size] != a:
                    break
                i = order[low]
                v = place(low, 2 * half)
    if not known:
        return (np.zeros(0, np.int64),) * 3
    node, half = np.array(sorted(known), np.int64).T
    inner = node >= 0
    at = np.maximum(node, 0)
    return np.where(inner, tree.left[at], -1 - node), np.where(inner, tree.right[at], -1 - node), half


def runs_of(text: np.ndarray, least: int = 24, exponent: int = 3) -> np.ndarray:
    """Rows (start, length, period) of the maximal runs of ``text`` with length >= max(least, exponent * period).

    ``text`` must end in a symbol of its own; symbols that occur once divide it. exponent is at least 2.
    """
    names = Names(text)
    if not names.levels:
        return np.zeros((0, 3), np.int64)
    lcp = np.zeros(len(text), np.int64)
    lcp[1:] = names.forward(names.order[:-1], names.order[1:])
    squares = _primitive(names, covering_squares(names, blocks(longest_earlier(names.rank, lcp))))
    if not len(squares):
        return np.zeros((0, 3), np.int64)
    first, last, half = vocabulary(text, names, Tree(lcp), squares)
    count = last - first + 1
    begin = np.cumsum(count) - count
    at = names.order[np.arange(int(count.sum())) - np.repeat(begin - first, count)]
    period = np.repeat(half, count)
    sort = np.lexsort((at, period))
    at, period = at[sort], period[sort]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    start, period = at[begin], period[begin]
    length = at[end] - start + 2 * period
    keep = length >= np.maximum(least, exponent * period)
    return np.stack([start, length, period], 1)[keep]


def _repeated(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches within the rows all of whose words lie in windows that occur twice in the row."""
    hashes, at = K.windows(K.mix(codes.astype(np.uint64) + K.U(1)), first, WINDOW)
    if not len(at):
        return at, at
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes = hashes ^ K.mix(row[at].astype(np.uint64) + K.U(77))
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = at[twice]
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] > at[:-1] + WINDOW) | (row[at[1:]] != row[at[:-1]])
    begin = np.flatnonzero(new)
    return at[begin], at[np.append(begin[1:], len(at)) - 1] + WINDOW


def chunk_runs(codes: np.ndarray, first: np.ndarray, least: int = 24, exponent: int = 3) -> np.ndarray:
    """Rows (row, start, length, period) of the runs in each of a chunk's rows, by row, start and period.

    Every window of eight words in a run of at least 24 words and three periods recurs at the distance of the period,
    inside the run; so runs lie in stretches of such windows and the other words need no tree.
    """
    if least < 3 * WINDOW or exponent < 3:  # the windows prove nothing: whole rows are searched
        start, end = first[:-1], first[1:]
    else:
        start, end = _repeated(codes, first)
        if len(start):  # once more, now with recurrence inside the stretch
            size = end - start
            inner = np.append(0, np.cumsum(size))
            own = np.repeat(start - inner[:-1], size) + np.arange(inner[-1])
            a, b = _repeated(codes[own], inner)
            start, end = (own[a], own[b - 1] + 1) if len(a) else (a, a)
    keep = end - start >= max(least, 2)
    start, end = start[keep], end[keep]
    out = []
    at = 0
    while at < len(start):
        stop, size = at, 0
        while stop < len(start) and (stop == at or size + end[stop] - start[stop] < TOGETHER):
            size += end[stop] - start[stop] + 1
            stop += 1
        begin, length = start[at:stop], (end - start)[at:stop]
        place = np.append(0, np.cumsum(length + 1))
        text = np.empty(place[-1], np.int64)
        own = np.repeat(begin - place[:-1], length + 1) + np.arange(place[-1])
        stops = place[1:] - 1
        own[stops] = 0
        text[:] = codes[own] if len(codes) else 0
        text[stops] = (int(codes.max()) if len(codes) else 0) + 1 + np.arange(len(stops))  # no run passes the end of a stretch
        found = runs_of(text, least, exponent)
        piece = np.searchsorted(place, found[:, 0], "right") - 1
        found[:, 0] += begin[piece] - place[piece]
        out.append(found)
        at = stop
    found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    row = np.searchsorted(first, found[:, 0], "right") - 1
    found = np.column_stack([row, found[:, 0] - first[row], found[:, 1:]])
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def tandem_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, exponent: int = 3, cycle: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """Per document: the id, n_words, ``runs`` (start, length, period in words, by start and period) and ``collapsed``.

    Words are runs without white space (space, U+0009 to U+000D), compared exactly. A run is a stretch with smallest
    period q and a length of at least max(least, exponent * q) that no neighbouring word extends. ``collapsed`` are the
    words, joined by one space, without those that some run contains after its first q words. ``cycle`` may rewrite a text
    first: for an id and a number of words it names (a, p), and each word i >= a becomes word a + (i - a) % p.

    Each row is judged by itself: repeated rows give repeated results, null and empty texts no runs and an empty
    ``collapsed``, other columns are not read. Memory follows the longest text.
    """
    carried = with_row(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).field(0)
            for c in K.chunks(batch.column(1)):
                yield from _chunk(batch.column(0)[c.rows], ids[c.rows].to_pylist(), c.data, c.offsets, least, exponent, cycle)

    out = carried.mapInArrow(find, f"row {row_type(carried)}, n_words long, runs {RUNS}, collapsed string")
    return out.select(F.col("row.id").alias(id_col), "n_words", "runs", "collapsed")


def _chunk(rows: pa.Array, ids: list, data: np.ndarray, offsets: np.ndarray, least: int, exponent: int, cycle: Callable | None) -> Iterator[pa.RecordBatch]:
    w = K.words(data, offsets, K.SPACE)
    inside = ~K.SPACE[data]
    at = np.append(0, np.cumsum(w.end - w.start))
    kind = pa.large_binary() if at[-1] >= 2**31 else pa.binary()
    spelled = pa.Array.from_buffers(kind, len(w.start), [None, pa.py_buffer(at.astype(np.int64 if at[-1] >= 2**31 else np.int32)), pa.py_buffer(data[inside])])
    codes = spelled.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = w.first.astype(np.int64)
    source = np.arange(len(codes))
    changed = np.zeros(len(ids), bool)
    for i, key in enumerate(ids if cycle else ()):
        size = int(first[i + 1] - first[i])
        if size and (way := cycle(key, size)):
            a, p = way
            source[first[i] + a : first[i + 1]] = first[i] + a + np.arange(size - a) % p
            changed[i] = True
    codes = codes[source]
    found = chunk_runs(codes, first, least, exponent)
    if len(found):
        cover = np.zeros(len(codes) + 1, np.int64)
        np.add.at(cover, first[found[:, 0]] + found[:, 1] + found[:, 3], 1)
        np.add.at(cover, first[found[:, 0]] + found[:, 1] + found[:, 2], -1)
        kept = np.cumsum(cover)[:-1] == 0
        changed[found[:, 0]] = True
    else:
        kept = np.ones(len(codes), bool)
    # words with one space between them: each word's bytes and the separator after it, but for a row's last word
    mask = inside.copy()
    after = w.end[(w.end < len(data)) & (np.arange(len(w.end)) + 1 < np.append(first, 0)[w.row + 1])]
    mask[after] = True
    sums = np.append(0, np.cumsum(mask))[offsets]
    clean = data[mask].copy()
    clean[K.SPACE[clean]] = 0x20
    joined = clean.tobytes()
    raw, starts, ends = data.tobytes() if changed.any() else b"", w.start, w.end
    texts = []
    for i in range(len(ids)):
        if changed[i]:
            own = source[first[i] : first[i + 1]][kept[first[i] : first[i + 1]]]
            texts.append(b" ".join([raw[s:e] for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]))
        else:
            texts.append(joined[sums[i] : sums[i + 1]])
    bounds = np.searchsorted(found[:, 0], np.arange(len(ids) + 1)).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(found[:, j]) for j in (1, 2, 3)], fields=list(RUN_TYPE)))
    yield pa.RecordBatch.from_arrays([rows, pa.array(np.diff(first)), runs, pa.array(texts, pa.binary()).cast(pa.string())], ["row", "n_words", "runs", "collapsed"])


def planted_cycle(key: int | None, n: int) -> tuple[int, int] | None:
    """The rewriting of the registered query: one id in ten, by crc32 of its decimal form, becomes periodic from some word on."""
    if key is None:
        return None
    h = zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def longest_run(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the smallest start, then period. Null if none."""
    def better(best: Column, r: Column) -> Column:
        a, b = r["length"] * best["period"], best["length"] * r["period"]
        tie = (r["start"] < best["start"]) | ((r["start"] == best["start"]) & (r["period"] < best["period"]))
        return F.when(best.isNull() | (a > b) | ((a == b) & tie), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, n_runs, start, length, period and exponent_milli of the strongest run, digests of all runs and of the collapsed text.

    Texts are first rewritten by ``planted_cycle``; a row without an id is not.
    """
    found = tandem_runs(docs, id_col, text_col, cycle=planted_cycle).withColumn("best", longest_run(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
