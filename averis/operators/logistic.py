"""Logistic regressions of sparse rows, one for each corpus and penalty, fitted where the corpus' rows are.

Corpora share no feature, so a task fits a corpus by itself, its rows dealt out once instead of once an iteration. Rows are
held in blocks: dense up to ``HELD`` bytes, beyond that in a file of places and values, so memory does not grow with the
corpus. All penalties go through the rows together. The intercept has no penalty.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from averis.operators import grams as G

#: Bytes of dense blocks that a task holds, and cells of a block.
HELD, CELLS = 200_000_000, 2_000_000


class Rows:
    """Rows of one corpus as dense blocks; ``blocks`` gives them again and again."""

    def __init__(self, width: int):
        self.width, self.most = width, max(1, CELLS // max(1, width))
        self.kept: list[tuple] = []
        self.held, self.n, self.file = 0, 0, None
        self.open: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, v: np.ndarray) -> None:
        self.open.append((i, v))
        self.n += 1
        if len(self.open) == self.most:
            self.close()

    def close(self) -> None:
        if not self.open:
            return
        n, lens = len(self.open), [len(i) for i, _ in self.open]
        flat = np.concatenate([i for i, _ in self.open]).astype(np.int32) + np.repeat(np.arange(n, dtype=np.int32) * self.width, lens)
        v = np.concatenate([w for _, w in self.open]).astype(np.float32)
        self.open = []
        if self.held + 4 * n * self.width <= HELD:
            self.held += 4 * n * self.width
            self.kept.append((n, self.dense(n, flat, v)))
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        self.kept.append((n, len(flat), self.file.tell()))
        self.file.write(flat.tobytes())
        self.file.write(v.tobytes())

    def dense(self, n: int, flat: np.ndarray, v: np.ndarray) -> np.ndarray:
        x = np.zeros(n * self.width, np.float32)
        x[flat] = v
        return x.reshape(n, self.width)

    def blocks(self) -> Iterator[tuple[slice, np.ndarray]]:
        at = 0
        for b in self.kept:
            if len(b) == 2:
                x = b[1]
            else:
                self.file.seek(b[2])
                raw = self.file.read(8 * b[1])
                x = self.dense(b[0], np.frombuffer(raw, np.int32, b[1]), np.frombuffer(raw, np.float32, b[1], 4 * b[1]))
            yield slice(at, at + b[0]), x
            at += b[0]


def descent(w: np.ndarray, most: int, tol: float = 1e-6, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS for a smooth convex function: gives points, is sent value and gradient there, returns the last point. Ends when
    no part of the gradient is above ``tol``, after ``most`` steps, or where no step makes the value less."""
    f, g = yield w
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(most):
        if np.abs(g).max() <= tol:
            break
        d = -g
        alphas = []
        for s, y, sy in reversed(steps):
            alphas.append((s @ d) / sy)
            d = d - alphas[-1] * y
        if steps:
            d = d * (steps[-1][2] / (steps[-1][1] @ steps[-1][1]))
        for (s, y, sy), a in zip(steps, reversed(alphas)):
            d = d + (a - (y @ d) / sy) * s
        slope, t = g @ d, 1.0 if steps else min(1.0, 1 / np.abs(g).sum())
        for _ in range(25):
            n = w + t * d
            fn, gn = yield n
            if fn <= f + 1e-4 * t * slope:
                break
            t /= 2
        else:
            if not steps:
                break
            steps = []
            continue
        s, y = n - w, gn - g
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            steps = [*steps[1 - memory :], (s, y, s @ y)]
        w, f, g = n, fn, gn
    return w


def minima(x: Rows, y: np.ndarray, fits: list[tuple[float, np.ndarray]], most: int) -> list[np.ndarray]:
    """For each (penalty, which rows) the weights, intercept last, of least loss + penalty |w|^2 / 2. Features are centred in
    the search, which leaves weights and minimum as they are."""
    mean = sum((b.sum(0, dtype=float) for _, b in x.blocks()), np.zeros(x.width)) / max(1, x.n)
    searches = [descent(np.zeros(x.width + 1), most) for _ in fits]
    at, out = {k: next(s) for k, s in enumerate(searches)}, [np.zeros(x.width + 1) for _ in fits]
    mask = np.stack([m for _, m in fits], 1).astype(float) if fits else None
    n = np.maximum(1.0, mask.sum(0)) if fits else None
    while at:
        ks = list(at)
        w = np.stack([at[k] for k in ks], 1)
        shift, w32 = w[-1] - mean @ w[:-1], w[:-1].astype(np.float32)
        loss, g, total = np.zeros(len(ks)), np.zeros((x.width, len(ks))), np.zeros(len(ks))
        for rows, b in x.blocks():
            z, m, t = b @ w32 + shift, mask[rows][:, ks], y[rows, None]
            r = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - t) * m
            loss += ((np.logaddexp(0, z) - t * z) * m).sum(0)
            g += b.T @ r.astype(np.float32)
            total += r.sum(0)
        g -= mean[:, None] * total
        for c, k in enumerate(ks):
            p = fits[k][0]
            v = w[:-1, c]
            try:
                at[k] = searches[k].send(((loss[c] + p / 2 * (v @ v)) / n[k], np.append(g[:, c] + p * v, total[c]) / n[k]))
            except StopIteration as e:
                out[k] = e.value.copy()
                out[k][-1] -= mean @ e.value[:-1]
                del at[k]
    return out


def each(rows: DataFrame, v: G.Vocabulary, over: np.ndarray, penalties: list[float], most: int, held_penalties: list[float] | None = None) -> dict[tuple[str, int], tuple[np.ndarray, int]]:
    """By corpus and number of the penalty: weights of its places, intercept last, and how many held-out rows a fit with
    ``held_penalties`` of the other rows decides rightly. ``rows``: corpus, pair_id, label, held, i, v; the values are divided
    by ``over``, an infinite one leaves a feature out."""
    of = np.array(v.corpus)
    names = sorted({*v.corpus, *(r.corpus for r in rows.select("corpus").distinct().collect())})
    places = {c: np.flatnonzero((of == c) & np.isfinite(over)) if len(of) else np.zeros(0, int) for c in names}
    local = np.full(len(v), -1, np.int32)
    for p in places.values():
        local[p] = np.arange(len(p))
    sent = rows.sparkSession.sparkContext.broadcast((local, over, {c: len(p) for c, p in places.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, over, width = sent.value
        last, x, y, held = None, None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            x.close()
            label, h = np.array(y, float), np.array(held, bool)
            whole = [(p, np.ones(len(h), bool)) for p in penalties]
            found = minima(x, label, [*whole, *((p, ~h) for p in held_penalties or [])], most)
            right = np.zeros(len(penalties), int)
            for k, w in enumerate(found[len(penalties) :]):
                z = np.concatenate([b @ w[:-1].astype(np.float32) for _, b in x.blocks()]) + w[-1]
                right[k] = (((z > 0) == (label == 1)) & h).sum()
            for k in range(len(penalties)):
                yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([k], pa.int32()), pa.array([right[k]], pa.int64()), pa.array([found[k]], pa.list_(pa.float64()))], ["corpus", "k", "n", "w"])

        for b in batches:
            i, v = b.column("i"), b.column("v")
            for k, c in enumerate(b.column("corpus").to_pylist()):
                if c != last:
                    if x is not None:
                        yield from out()
                    last, x, y, held = c, Rows(width[c]), [], []
                p = i[k].values.to_numpy()
                at = local[p]
                keep = at >= 0
                x.add(at[keep], v[k].values.to_numpy()[keep] / over[p[keep]])
            y += b.column("label").to_pylist()
            held += b.column("held").to_pylist()
        if x is not None:
            yield from out()

    number = F.create_map(*[F.lit(a) for k, c in enumerate(names) for a in (c, k)])[F.col("corpus")] if names else F.lit(0)
    dealt = rows.select("corpus", "pair_id", "label", "held", "i", "v").repartitionById(max(1, len(names)), number.cast("int")).sortWithinPartitions("corpus", "pair_id")
    return {(r.corpus, r.k): (np.array(r.w), r.n) for r in dealt.mapInArrow(run, "corpus string, k int, n bigint, w array<double>").collect()}


def spread_out(found: dict[str, np.ndarray], v: G.Vocabulary, over: np.ndarray) -> tuple[np.ndarray, dict[str, float]]:
    """Weights of undivided values by place, and intercepts by corpus; what has no fit is 0."""
    w, of = np.zeros(len(v)), np.array(v.corpus)
    for c, f in found.items():
        p = np.flatnonzero((of == c) & np.isfinite(over)) if len(of) else np.zeros(0, int)
        w[p] = f[:-1] / over[p]
    return w, {c: float(f[-1]) for c, f in found.items()}


def probabilities(rows: DataFrame, w: np.ndarray, intercepts: dict[str, float]) -> DataFrame:
    """(pair_id, score) of ``rows``: corpus, pair_id, i, v."""
    sent = rows.sparkSession.sparkContext.broadcast((w, intercepts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, start = sent.value
        for b in batches:
            i, v = b.column("i"), b.column("v")
            of = np.repeat(np.arange(b.num_rows), i.value_lengths().to_numpy())
            z = np.bincount(of, w[i.flatten().to_numpy()] * v.flatten().to_numpy(), b.num_rows) + np.array([start.get(c, 0.0) for c in b.column("corpus").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("pair_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["pair_id", "score"])

    return rows.select("corpus", "pair_id", "i", "v").mapInArrow(run, f"pair_id {dict(rows.dtypes)['pair_id']}, score double")
