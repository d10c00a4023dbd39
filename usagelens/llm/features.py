"""Sparse features of whole texts and the factorisation machine that learns on them.

Features: hashed words (and on request hashed word beginnings), and structure statistics of the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import ALNUM_WORDS, lean, mix, slices, word_hashes

U = np.uint64
BITS = 18
WORDS = 1 << BITS
STATS = 20
DIM = WORDS + STATS


def _classes() -> np.ndarray:
    c = np.full(256, 10)
    for number, chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "|", "*%$#&@"]):
        c[list(chars.encode())] = number
    c[128:] = 11
    c[list(b"/:<>{}=[]()\\")] = 12
    c[list(b"-_")] = 13
    c[:9] = c[14:32] = 14
    c[list(b"\"'")] = 15
    return c


_CLASS = _classes()


@dataclass
class Sparse:
    """Rows as index and value arrays end to end; row i is ``start[i]`` to ``start[i + 1]``. The last STATS entries of a row are its statistics."""

    index: np.ndarray
    value: np.ndarray
    start: np.ndarray


def sparse(data: np.ndarray, offsets: np.ndarray, beginnings: int, unit: bool) -> Sparse:
    """``beginnings``: bytes of the word beginnings that are features too, 0 for none. ``unit``: log counts of length one, else presence."""
    n = len(offsets) - 1
    rows, h, starts, ends = word_hashes(data, offsets, ALNUM_WORDS)
    keys = [rows.astype(np.int64) << BITS | (h >> U(64 - BITS)).astype(np.int64)]
    if beginnings and len(h):
        # The first bytes of each word, by the same hash as a word of its own.
        long = (ends - starts) > beginnings
        head = np.zeros(int(long.sum()), U)
        low = ALNUM_WORDS[data]
        for j in range(beginnings):
            head = mix(head * U(31) + low[starts[long] + j] + U(j + 1))
        keys.append(rows[long].astype(np.int64) << BITS | (mix(head + U(77)) >> U(64 - BITS)).astype(np.int64))
    words = np.bincount(rows, minlength=n)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    row, index = key >> BITS, key & (WORDS - 1)
    distinct = np.bincount(row, minlength=n)
    if unit:
        value = np.log1p(count)
        value = value / np.sqrt(np.maximum(np.bincount(row, value * value, minlength=n), 1e-12))[row]
    else:
        value = np.ones(len(key))
    # statistics
    size = np.diff(offsets)
    share = np.bincount(np.repeat(np.arange(n) << 4, size) | _CLASS[data], minlength=n << 4).reshape(n, 16) / np.maximum(size, 1)[:, None]
    length = np.bincount(rows, ends - starts, minlength=n)
    w = np.maximum(words, 1)
    stats = np.column_stack([np.log1p(50 * share), np.log1p(words) / 4, length / w / 5, distinct / w, np.ones(n)])
    place = np.arange(STATS) + WORDS
    at = np.searchsorted(row, np.arange(n + 1))
    index = np.insert(index, np.repeat(at[1:], STATS), np.tile(place, n))
    value = np.insert(value, np.repeat(at[1:], STATS), stats.ravel())
    return Sparse(index.astype(np.int32), value.astype(np.float32), at + np.arange(n + 1) * STATS)


def sparse_of(column: pa.Array, beginnings: int, unit: bool) -> Iterator[tuple[int, int, Sparse]]:
    for a, b, data, offsets in slices(column):
        yield a, b, sparse(data, offsets, beginnings, unit)


def take(x: Sparse, rows: np.ndarray) -> Sparse:
    size = np.diff(x.start)[rows]
    start = np.append(0, np.cumsum(size))
    at = np.repeat(x.start[:-1][rows] - start[:-1], size) + np.arange(start[-1])
    return Sparse(x.index[at], x.value[at], start)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class FactorisationMachine:
    """w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2), by AdaGrad on the log loss. Rank 0 is a linear model."""

    def __init__(self, rank: int, epochs: int = 12, rate: float = 0.1, l2: float = 1e-5, extra: int = 0, seed: int = 5):
        self.rank, self.epochs, self.rate, self.l2, self.seed = rank, epochs, rate, l2, seed
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(DIM + extra, np.float32)
        self.v = rng.normal(0, 0.02, (DIM + extra, rank)).astype(np.float32)
        self.mean, self.scale = np.zeros(STATS, np.float32), np.ones(STATS, np.float32)

    def scaled(self, x: Sparse) -> Sparse:
        at = (x.start[1:, None] - STATS + np.arange(STATS)).ravel()
        value = x.value.copy()
        value[at] = (np.clip((value[at].reshape(-1, STATS) - self.mean) * self.scale, -4, 4) * 0.5).ravel()
        return Sparse(x.index, value, x.start)

    def margins(self, x: Sparse, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The margins and, for training, each row's sums of v x. ``x`` is scaled; ``extra``: further dense inputs."""
        first = x.start[:-1]
        out = self.bias + np.add.reduceat(self.w[x.index] * x.value, first)
        if extra is not None and extra.shape[1]:
            out = out + extra @ self.w[DIM:]
        sums = np.zeros((len(first), self.rank), np.float32)
        if self.rank:
            vx = self.v[x.index] * x.value[:, None]
            sums = np.add.reduceat(vx, first, axis=0)
            out = out + 0.5 * (np.square(sums).sum(1) - np.add.reduceat(np.square(vx).sum(1), first))
        return out, sums

    def fit(self, x: Sparse, y: np.ndarray, extra: np.ndarray | None = None, batch: int = 128) -> FactorisationMachine:
        n = len(y)
        if not n:
            return self
        stats = x.value[(x.start[1:, None] - STATS + np.arange(STATS)).ravel()].reshape(-1, STATS)
        self.mean, self.scale = stats.mean(0), 1 / np.maximum(stats.std(0), 1e-3)
        x = self.scaled(x)
        rng = np.random.default_rng(self.seed)
        gw, gv, gb = np.full(len(self.w), 1e-2, np.float32), np.full(self.v.shape, 1e-2, np.float32), 1e-2
        p = np.clip(y.mean(), 0.02, 0.98)
        self.bias = float(np.log(p / (1 - p)))
        for _ in range(self.epochs):
            order = rng.permutation(n)
            for a in range(0, n, batch):
                rows = order[a : a + batch]
                part, more = take(x, rows), None if extra is None else extra[rows]
                m, sums = self.margins(part, more)
                g = ((sigmoid(m) - y[rows]) / len(rows)).astype(np.float32)
                each = np.repeat(g, np.diff(part.start))
                used, back = np.unique(part.index, return_inverse=True)
                d = np.bincount(back, each * part.value, minlength=len(used)).astype(np.float32) + self.l2 * self.w[used]
                gw[used] += d * d
                if self.rank:
                    row = np.repeat(np.arange(len(rows)), np.diff(part.start))
                    full = each[:, None] * (part.value[:, None] * sums[row] - self.v[part.index] * np.square(part.value)[:, None])
                    dv = np.stack([np.bincount(back, full[:, f], minlength=len(used)) for f in range(self.rank)], 1).astype(np.float32) + self.l2 * self.v[used]
                    gv[used] += dv * dv
                    self.v[used] -= self.rate * dv / np.sqrt(gv[used])
                self.w[used] -= self.rate * d / np.sqrt(gw[used])
                if more is not None and more.shape[1]:
                    de = (g @ more).astype(np.float32)
                    gw[DIM:] += de * de
                    self.w[DIM:] -= self.rate * de / np.sqrt(gw[DIM:])
                db = float(g.sum())
                gb += db * db
                self.bias -= self.rate * db / np.sqrt(gb)
        return self

    def predict(self, x: Sparse, extra: np.ndarray | None = None) -> np.ndarray:
        return sigmoid(self.margins(self.scaled(x), extra)[0]).astype(np.float64)


def telling(x: Sparse, y: np.ndarray, least: float) -> np.ndarray:
    """Which features are seen in more positive rows than chance explains: chi-square of ``least`` or more."""
    row = np.repeat(np.arange(len(y)), np.diff(x.start))
    pos, neg = (np.bincount(x.index, (y[row] == v).astype(float), minlength=DIM) for v in (1, 0))
    share = y.mean()
    expected = (pos + neg) * share
    chi = np.square(pos - expected) / np.maximum(expected * (1 - share), 1e-9)
    out = (pos > expected) & (chi >= least)
    out[WORDS:] = True
    return out


def only(x: Sparse, keep: np.ndarray) -> Sparse:
    """The rows with the kept features; statistics stay."""
    on = keep[x.index]
    return Sparse(x.index[on], x.value[on], np.append(0, np.cumsum(np.add.reduceat(on.astype(np.int64), x.start[:-1]))) if len(x.start) > 1 else x.start)


# ---------------------------------------------------------------- training rows


def held_out(id):
    """Whether labels of this id may not be learnt from."""
    return F.crc32(id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, columns: list[str], rows: int, beginnings: int, unit: bool, id: str = "doc_id", text: str = "text") -> tuple[Sparse, np.ndarray, np.ndarray]:
    """Features, labels (a column for each of ``columns``) and folds of at most ``rows`` labelled rows that aren't held out.

    The rows are those of the lowest hashes of the id, so the choice doesn't depend on the layout. One id counts once.
    """
    known = labels.where(~held_out(F.col(id))).dropna(subset=[id, *columns]).groupBy(F.col(id).alias("_id")).agg(*[F.min(c).cast("double").alias(f"_y{i}") for i, c in enumerate(columns)])
    known = known.orderBy(F.xxhash64(F.lit(11), "_id"), "_id").limit(rows)
    kind = docs.schema[id].dataType.simpleString()
    # At most ``rows`` short rows are broadcast.
    picked = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id").select("_id", "_text", *[f"_y{i}" for i in range(len(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in sparse_of(batch.column(1), beginnings, unit):
                parts = [[v[x.start[i] : x.start[i + 1]].tobytes() for i in range(b - a)] for v in (x.index, x.value)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *[batch.column(2 + i)[a:b] for i in range(len(columns))], *[pa.array(p, pa.binary()) for p in parts]], ["_id", *[f"_y{i}" for i in range(len(columns))], "index", "value"])

    got = picked.mapInArrow(lean(run), f"_id {kind}, {', '.join(f'_y{i} double' for i in range(len(columns)))}, index binary, value binary").toArrow()
    got = got.sort_by("_id")
    index, value = (np.frombuffer(b"".join(got.column(c).to_pylist()), t) for c, t in (("index", np.int32), ("value", np.float32)))
    start = np.append(0, np.cumsum([len(v) // 4 for v in got.column("index").to_pylist()], dtype=np.int64)).astype(np.int64)
    y = np.column_stack([got.column(f"_y{i}").to_numpy() for i in range(len(columns))]) if len(got) else np.zeros((0, len(columns)))
    folds = (mix(np.arange(len(got), dtype=U)) % U(5)).astype(np.int64)
    return Sparse(index, value, start), y, folds
