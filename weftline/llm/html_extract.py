"""Main text of HTML pages: a bidirectional LSTM labels each block from its tag path and words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.html_blocks import PATH, Block, PathSums, blocks, labelled_pages, sign
from weftline.llm.shared import row_type, with_row

WORD, DENSE, HIDDEN = 32, 8, 24
INPUT = PATH + WORD + DENSE
F32 = np.float32


STRETCH = 4096  # blocks of a long page in memory as features at once


def features(page: list[Block], first: int = 0, stop: int | None = None, sums: PathSums | None = None) -> np.ndarray:
    """One row per block of a stretch: path signs, averaged signs of all its words, and sizes, link share and place in the page."""
    own = page[first:stop]
    x = np.zeros((len(own), INPUT), F32)
    if not own:
        return x
    sums = sums or PathSums()
    words = [b.text.lower().split(" ") for b in own]
    count = np.array([len(w) for w in words])
    cells = np.array([sign(w, WORD) for some in words for w in some])
    at = np.repeat(np.arange(len(own)), count) * WORD + cells[:, 0]
    x[:, PATH : PATH + WORD] = np.bincount(at, cells[:, 1], len(own) * WORD).reshape(-1, WORD) / count[:, None]
    for i, b in enumerate(own):
        sums.move(b.inner)
        x[i, :PATH] = sums.now
        for depth, tag in enumerate(reversed(b.tags)):
            if tag not in ("html", "body"):
                cell, s = sign(f"{depth}:{tag}", PATH)
                x[i, cell] += 0.5 * s
        k = first + i
        x[i, PATH + WORD :] = (np.log1p(count[i]) / 5, b.linked, count[i] <= 3, b.text[-1] in ".!?", b.text[:1] in "©", k / max(1, len(page) - 1), 1 / (1 + k), 1 / (len(page) - k))
    return x


class Labeller:
    """One LSTM layer in each direction and a logistic output on both states, in numpy."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"wx{d}"] = (rng.standard_normal((INPUT, 4 * HIDDEN)) / 12).astype(F32)
            self.p[f"wh{d}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / 6).astype(F32)
            self.p[f"b{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(F32)
        self.p["wo"], self.p["bo"] = (rng.standard_normal(2 * HIDDEN) / 7).astype(F32), np.zeros(1, F32)

    def _run(self, x: np.ndarray, live: np.ndarray, d: str, keep: list | None = None, state: list | None = None) -> np.ndarray:
        """States of one direction over x[time, page, input]; a page's state stays where it is not live.

        ``state`` holds the two states before the first step, where there are any, and takes those after the last.
        """
        a = x.reshape(-1, INPUT) @ self.p[f"wx{d}"] + self.p[f"b{d}"]
        a = a.reshape(*x.shape[:2], 4 * HIDDEN)
        h, c = state if state else [np.zeros((x.shape[1], HIDDEN), F32)] * 2
        out = np.zeros((*x.shape[:2], HIDDEN), F32)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            z = a[t] + h @ self.p[f"wh{d}"]
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = live[t][:, None]
            new = np.where(m, f * c + i * g, c)
            tc = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            c, h = new, np.where(m, o * tc, h)
            out[t] = h
        if state is not None:
            state[:] = h, c
        return out

    def scores(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Of each page's blocks. Features are made for a few pages at a time, and of long pages for a stretch at a time."""
        out: list[np.ndarray] = [np.zeros(0, F32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            if len(pages[order[-1]]) > STRETCH:
                k = order.pop()
                out[k] = self._long(pages[k])
                continue
            n = max(1, min(len(order), 64, 40_000 // len(pages[order[-1]])))
            some, order = order[-n:], order[:-n]
            for k, p in zip(some, self.probabilities([features(pages[k]) for k in some]), strict=True):
                out[k] = p
        return out

    def _long(self, page: list[Block]) -> np.ndarray:
        """One page in stretches: the states of either direction go from each stretch to the next, so all blocks see all others."""
        starts = range(0, len(page), STRETCH)
        ahead, sums, state = np.empty((len(page), HIDDEN), F32), PathSums(), []
        for a in starts:
            x = features(page, a, a + STRETCH, sums)[:, None]
            ahead[a : a + STRETCH] = self._run(x, np.ones(x.shape[:2], bool), "f", state=state)[:, 0]
        out, state = np.empty(len(page), F32), []
        for a in reversed(starts):
            x = features(page, a, a + STRETCH, sums)[:, None]
            h = np.concatenate([ahead[a : a + STRETCH], self._run(x, np.ones(x.shape[:2], bool), "b", state=state)[:, 0]], 1)
            out[a : a + STRETCH] = 1 / (1 + np.exp(-(h @ self.p["wo"] + self.p["bo"])))
        return out

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Of each page's blocks; pages of similar length run together, few at a time where they are long."""
        out: list[np.ndarray] = [np.zeros(0, F32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            n = max(1, min(len(order), 64, 40_000 // len(pages[order[-1]])))
            some, order = order[-n:], order[:-n]
            x, live = _pad([pages[k] for k in some])
            h = np.concatenate([self._run(x, live, "f"), self._run(x, live, "b")], 2)
            p = 1 / (1 + np.exp(-(h @ self.p["wo"] + self.p["bo"])))
            for j, k in enumerate(some):
                out[k] = p[: len(pages[k]), j]
        return out

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradients by backpropagation through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._run(x, live, d, kept[d]) for d in "fb"], 2)
        p = 1 / (1 + np.exp(-(h @ self.p["wo"] + self.p["bo"])))
        n = max(1, live.sum())
        loss = float(-(np.log(np.where(y, p, 1 - p) + 1e-9) * live).sum() / n)
        dz = ((p - y) * live / n).astype(F32)
        g = {"wo": np.einsum("tp,tph->h", dz, h), "bo": np.array([dz.sum()], F32)}
        for k, d in enumerate("fb"):
            dout = dz[:, :, None] * self.p["wo"][k * HIDDEN : (k + 1) * HIDDEN]
            da = np.zeros((*x.shape[:2], 4 * HIDDEN), F32)
            dh = dc = np.zeros((x.shape[1], HIDDEN), F32)
            gh = np.zeros_like(self.p[f"wh{d}"])
            for t, before, c0, i, f, o, gate, tc, m in reversed(kept[d]):
                dh = dh + dout[t]
                dnew = dc + np.where(m, dh * o * (1 - tc * tc), 0)
                dzt = np.concatenate([dnew * gate * i * (1 - i), dnew * c0 * f * (1 - f), dh * tc * o * (1 - o), dnew * i * (1 - gate * gate)], 1) * m
                da[t] = dzt
                gh += before.T @ dzt
                dc = np.where(m, dnew * f, dc)
                dh = np.where(m, 0, dh) + dzt @ self.p[f"wh{d}"].T
            flat = da.reshape(-1, 4 * HIDDEN)
            g |= {f"wx{d}": x.reshape(-1, INPUT).T @ flat, f"b{d}": flat.sum(0), f"wh{d}": gh}
        return loss, g


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(p) for p in pages)
    x, live = np.zeros((longest, len(pages), INPUT), F32), np.zeros((longest, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j], live[: len(p), j] = p, True
    return x, live


def train(pages: int = 1600, epochs: int = 9, batch: int = 24, rate: float = 0.006, seed: int = 1) -> Labeller:
    """Fit a labeller to generated pages with Adam; the same arguments give the same weights."""
    data = [(features(blocks(h)), np.array(y, bool)) for h, y in labelled_pages(pages, seed)]
    data = sorted((d for d in data if len(d[1])), key=lambda d: len(d[1]))
    model, rng = Labeller(), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, starts = 0, np.arange(0, len(data), batch)
    for epoch in range(epochs):
        for at in rng.permutation(starts):
            own = data[at : at + batch]
            x, live = _pad([f for f, _ in own])
            y = np.zeros(live.shape, bool)
            for j, (_, labels) in enumerate(own):
                y[: len(labels), j] = labels
            _, g = model.gradients(x, live, y)
            norm = float(np.sqrt(sum((v * v).sum() for v in g.values())))
            step += 1
            for k, v in g.items():
                v = v * min(1.0, 2.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                own_rate = rate * (1 - epoch / (epochs + 1))
                model.p[k] -= (own_rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(F32)
    return model


@cache
def default_labeller() -> Labeller:
    return train()


def main_text(pages: list[str], model: Labeller) -> list[str]:
    parsed = [blocks(p) for p in pages]
    return [" ".join(b.text for b, s in zip(p, q, strict=True) if s >= 0.5) for p, q in zip(parsed, model.scores(parsed), strict=True)]


def extract(pages: DataFrame, html_col: str = "html", model: Labeller | None = None, together: int = 200, together_bytes: int = 8 << 20) -> DataFrame:
    """The other columns in a struct ``row`` and ``text``: the blocks of each page that the model labels as article.

    Blocks are the texts between block elements with character references decoded and white space collapsed; they are
    joined by one space in page order. Null and empty pages give an empty text. A page is labelled from all of its
    blocks and all of their words; nothing is cut short. Each row is handled by itself, at most ``together`` rows or
    about ``together_bytes`` of them at a time in memory, so repeated rows and clashing column names need no care. The model is trained from generated pages where none is given.
    """
    shared = pages.sparkSession.sparkContext.broadcast((model or default_labeller()).p)
    carried = with_row(pages, html_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller()
        own.p = shared.value
        for batch in batches:
            at = 0
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
            while at < len(batch):
                done = ends[at - 1] if at else 0
                stop = min(at + together, max(at + 1, int(np.searchsorted(ends, done + together_bytes, "right"))))
                part, at = batch.slice(at, stop - at), stop
                texts = main_text([p or "" for p in part.column(1).to_pylist()], own)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["row", "text"])

    return carried.mapInArrow(label, f"row {row_type(carried)}, text string")


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """Per page: the id, url, text and n_chars (code points)."""
    out = extract(pages.select(id_col, url_col, html_col), html_col, **options)
    return out.select(F.col(f"row.`{id_col}`").alias(id_col), F.col(f"row.`{url_col}`").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
