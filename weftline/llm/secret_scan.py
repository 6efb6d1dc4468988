"""Secrets in texts: fixed patterns, and random strings told from ordinary identifiers by Markov models."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import textkernel as K
from weftline.llm.shared import drop, row_type, stash, unpacked, with_row

#: Fixed patterns of the base kinds, in their listed order, with the group and length that a match must have.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = [k for k, *_ in BASE] + ["random"]

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = np.full(128, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def _lut(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_HEX, _SIGNS, _TOKEN, _DIGIT = _lut("0123456789abcdef"), _lut(":="), _lut(ALPHABET), _lut("0123456789")
_LETTER, _WORD = _lut(ALPHABET[:52]), _lut(ALPHABET)


def random_strings(count: int, seed: int = 11) -> list[str]:
    """Labelled samples of random strings: hexadecimal, base 64, and mixed letters and digits."""
    rng = np.random.default_rng(seed)
    kinds = ["0123456789abcdef", ALPHABET[:62] + "+/", ALPHABET[:62], ALPHABET[26:62], ALPHABET[:26] + "0123456789"]
    return ["".join(np.array(list(kinds[i % len(kinds)]))[rng.integers(0, len(kinds[i % len(kinds)]), 20 + i % 29)]) for i in range(count)]


def identifiers(words: list[str], count: int, seed: int = 12) -> list[str]:
    """Labelled samples of ordinary identifiers and compounds, made of words: joined plainly, by case or by signs, some with a number."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(count if words else 0):
        own = [words[k].lower() for k in rng.integers(0, len(words), 2 + i % 4)]
        text = ["_".join(own), "-".join(own), "/".join(own), "".join(w.capitalize() for w in own), "".join(own), "_".join(own).upper()][i % 6]
        if i % 5 == 0:
            y, mo, da, h, mi = (int(x) for x in rng.integers([1990, 1, 1, 0, 0], [2040, 13, 29, 24, 60]))
            text = [f"{text}_{y}-{mo:02}-{da:02}", f"{y}-{mo:02}-{da:02}T{h:02}-{mi:02}-00_{text}", f"{y}/{mo:02}/{da:02}/{text}", f"{y}{mo:02}{da:02}_{h:02}{mi:02}_{text}"][i // 5 % 4]
        out.append(text + (str(rng.integers(0, 3000)) if i % 3 == 0 else ""))
    return out


class Markov:
    """Two character models of order one, and the log-likelihood ratio a character between them."""

    def __init__(self, random: list[str], ordinary: list[str], smoothing: float = 0.5):
        size = len(ALPHABET) + 2

        def fit(samples: list[str]) -> np.ndarray:
            counts = np.full((size, size), smoothing)
            for s in samples:
                c = self._codes(s)
                np.add.at(counts, (c[:-1], c[1:]), 1)
            return np.log(counts / counts.sum(1, keepdims=True))

        self.ratio = fit(random) - fit(ordinary)

    @staticmethod
    def _codes(s: str) -> np.ndarray:
        own = np.frombuffer(s.encode("ascii", "replace"), np.uint8)
        return np.concatenate([[len(ALPHABET) + 1], _CODE[own], [len(ALPHABET) + 1]])

    def score(self, s: str) -> float:
        c = self._codes(s)
        return float(self.ratio[c[:-1], c[1:]].sum()) / (len(s) + 1)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts: runs of 2 to 20 ASCII letters outside base matches, beside no sign or digit of a token, in lower case."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(0)):
                data = c.data.copy()
                for i in _candidates(c.data, c.offsets).tolist():
                    if i >= len(c.offsets) - 1:
                        continue
                    own = data[c.offsets[i] : c.offsets[i + 1]]
                    text = own.tobytes().decode()
                    for _, pattern, _, _ in BASE:
                        text = pattern.sub(lambda m: " " * len(m[0].encode()), text)
                    own[:] = np.frombuffer(text.encode(), np.uint8)
                w = K.words(data, c.offsets, ~_WORD)
                letters = np.zeros(len(data) + 1, np.int64)
                np.cumsum(_LETTER[data], out=letters[1:])
                size = w.end - w.start
                keep = (size >= 2) & (size <= 20) & (letters[w.end] - letters[w.start] == size)
                start, end, low = w.start[keep], w.end[keep], K.LOWER[data]
                _, first, n = np.unique(K.span_hashes(low, start, end), return_index=True, return_counts=True)
                raw = low.tobytes()
                found = [raw[x:y].decode() for x, y in zip(start[first].tolist(), end[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n.astype(np.int64))], ["word", "n"])

    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", draws: int = 100000, samples: int = 20000) -> Markov:
    """Fit the models: random strings are generated; ordinary identifiers are made of the words of all texts.

    Every word of every text is counted. About ``draws`` words stand for the counts: a word with the share p of all
    gets draws * p places, rounded up or down by its own hash with the fraction as the chance, so that rare words have
    their share too and the driver gets no more than about ``draws`` rows. Only shares count, so copies of a whole
    table give the same models. A table without any word has no ordinary ones; a few common ones stand in.
    """
    counts = stash(word_counts(docs, text_col), "words")
    total = counts.agg(F.sum("n")).first()[0] or 1
    chance = F.shiftrightunsigned(F.xxhash64("word"), 11) / F.lit(float(2**53))
    places = F.floor(F.col("n") * (draws / total) + chance)
    picked = counts.select("word", places.alias("n")).where("n > 0").collect()
    drop(counts)
    words = [word for word, n in sorted((r.word, r.n) for r in picked) for _ in range(n)]
    return Markov(random_strings(samples), identifiers(words or ["get", "set", "name", "value", "list", "item", "user", "index"], samples))


def spans_of(text: str, model: Markov, threshold: float) -> list[tuple[int, int, int]]:
    """(start, end, kind) of a text's spans in order of start, then kind; positions are code points."""
    out = []
    for kind, (_, pattern, group, least) in enumerate(BASE):
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    for m in TOKEN.finditer(text):
        if any(a < m.end() and m.start() < b for a, b, _ in out):
            continue
        digits = sum(c.isdigit() for c in m[0])
        if 0 < digits < len(m[0]) and model.score(m[0]) > threshold:
            out.append((m.start(), m.end(), len(BASE)))
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def _long_runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(mask) + 1, bool)
    inside[:-1] = mask
    change = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
    start, end = change[::2], change[1::2]
    keep = end - start >= least  # a run over a row's end is only a candidate more
    return start[keep], end[keep]


def _candidates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that can have a span: an assignment sign, an access prefix, or a long run of the kinds' characters."""
    at = [np.flatnonzero(_SIGNS[data]), _long_runs(_HEX[data], offsets, 24)[0]]
    start, end = _long_runs(_TOKEN[data], offsets, 20)
    digits = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_DIGIT[data], out=digits[1:])
    over = np.searchsorted(offsets, start, "right") != np.searchsorted(offsets, end - 1, "right")
    at += [start[digits[end] > digits[start]], end[over] - 1]
    hex_start, hex_end = _long_runs(_HEX[data], offsets, 24)
    at.append(hex_end - 1)
    raw, found, k = data.tobytes(), [], -1
    while (k := raw.find(b"AKIA", k + 1)) >= 0:
        found.append(k)
    at.append(np.array(found, np.int64))
    rows = np.searchsorted(offsets, np.concatenate(at), "right") - 1
    # a run over several rows' ends: all rows between
    for a, b in zip(start[over], end[over], strict=True):
        rows = np.append(rows, np.arange(np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b - 1, "right")))
    return np.unique(rows)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    at, out = 0, []
    for start, end, kind in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = end
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, text_col: str = "text", threshold: float = 0.6, model: Markov | None = None, cut: bool = False) -> DataFrame:
    """The other columns in a struct ``row``, and ``secrets``: an array of (kind, start, end) by start, then kind.

    Base kinds are fixed patterns. The method adds ``random``: tokens of 20 or more characters that have a digit and
    another character, overlap no base span, and are likelier as random strings than as ordinary identifiers by more
    than ``threshold`` a character. Null and empty texts have none. With ``cut`` the ``text`` is returned too, with
    each secret replaced by its kind. Texts are scanned whole, each row by itself, so repeated rows and clashing
    column names need no care; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, text_col))
    carried = with_row(docs, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                texts = batch.column(1)[c.rows]
                found: list[list] = [[]] * len(texts)
                hit, new = np.zeros(len(texts), bool), []
                for i in _candidates(c.data, c.offsets).tolist():
                    if i < len(found) and (spans := spans_of(text := texts[i].as_py() or "", shared.value, threshold)):
                        found[i] = [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans]
                        hit[i] = True
                        new.append(redacted(text, spans) if cut else None)
                secrets = pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
                if cut and new:
                    texts = pa.compute.replace_with_mask(texts, pa.array(hit), pa.array(new, texts.type))
                yield pa.RecordBatch.from_arrays([batch.column(0)[c.rows], secrets, *([texts] if cut else [])], ["row", "secrets", *(["text"] if cut else [])])

    return carried.mapInArrow(scan, f"row {row_type(carried)}, secrets array<struct<kind:string,start:long,end:long>>" + (", text string" if cut else ""))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: the id, n_assign, n_access, n_hex, base_sha256 and all spans as comma-joined kind:start:end."""
    found = find_secrets(docs.select(id_col, text_col), text_col, **options)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.filter("secrets", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select(F.col(f"row.`{id_col}`").alias(id_col), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents with each secret replaced by its kind in angle brackets; all rows and columns stay."""
    return find_secrets(docs, text_col, cut=True, **options).select(unpacked(docs, text_col))
