"""Whitening of embeddings by a tall-skinny QR.

An entry c counts as the long x = floor(64 c) + 1000000. The fit list is each distinct x vector once. Its rows are centred by
exact sums, each partition is brought to a triangle R by QR of a batch at a time, the triangles are merged as a tree, and the last
one's right singular vectors are the components; no covariance of the vectors is formed. Memory of a task: a batch and a few
matrices of dim x dim. The driver sees one triangle, one vector of sums and one matrix of components, all bounded by the dimension.

Defined cases: rows with a null vector, or one with null or non-finite entries or with 64 c beyond 2^62, are left out. Of vectors
of several lengths those of the most frequent one in the fit list count (of equally many the longer), the others are left out.
Repeated rows and ids give repeated rows; ids may be null. A component without spread (all vectors alike, or fewer vectors than
entries) has a null ``whitened`` and takes no part in ``identity_error``, which is null where none is left, as ``explained`` is
where nothing varies. A deviation beyond a long is null. Extra columns are neither read nor returned. An empty table, or vectors
without entries, give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.common import checkpoint, lean, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: States that one task of the tree merges.
FAN_IN = 16
#: Rows of a QR step.
STEP_ROWS = 4096
MOST = 1 << 62
#: A singular value below the largest by this factor, times the dimension, is no spread.
NO_SPREAD = 1e-14


# ---------------------------------------------------------------- vectors as bytes


def packed(column: pa.Array) -> Iterator[tuple[np.ndarray, int, pa.Array]]:
    """(rows, length, bytes): x - SHIFT of the rows that count, as integers of the least width that holds the vector, that width first.

    Equal vectors have equal bytes.
    """
    column = column.cast(pa.large_list(pa.float64()))
    n = len(column)
    ends = np.asarray(column.offsets).astype(np.int64)
    flat = column.values[ends[0] : ends[-1]] if n else column.values[:0]
    values, ends = flat.to_numpy(zero_copy_only=False).astype(np.float64), ends - ends[:1]  # a null entry is NaN here
    size = np.diff(ends)
    good = np.asarray(column.is_valid()) & (size > 0)
    scaled = np.floor(values * SCALE)
    bad = ~(np.abs(scaled) < MOST)
    bad_before = np.append(0, np.cumsum(bad))
    good &= bad_before[ends[1:]] == bad_before[ends[:-1]]
    for length in np.unique(size[good]):
        rows = np.flatnonzero(good & (size == length))
        v = scaled[ends[rows][:, None] + np.arange(length)].astype(np.int64)
        lo, hi = v.min(1), v.max(1)
        width = np.select([(lo >= -(1 << b - 1)) & (hi < 1 << b - 1) for b in (8, 16, 32)], [1, 2, 4], 8)
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            raw = np.empty((len(own), 1 + int(length) * w), np.uint8)
            raw[:, 0] = w
            raw[:, 1:] = v[own].astype(f"<i{w}").view(np.uint8).reshape(len(own), -1)
            offsets = np.arange(len(own) + 1, dtype=np.int64) * raw.shape[1]
            yield rows[own], int(length), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())


def unpacked(column: pa.Array, length: int) -> np.ndarray:
    """The rows' x - SHIFT."""
    out = np.empty((len(column), length), np.int64)
    raw = column.to_pylist()
    for w in {r[0] for r in raw}:
        own = [i for i, r in enumerate(raw) if r[0] == w]
        out[own] = np.frombuffer(b"".join(raw[i][1:] for i in own), f"<i{w}").reshape(len(own), length)
    return out


def vectors(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, length, x) of the rows that count."""
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), STEP_ROWS):
                part = batch[at : at + STEP_ROWS]
                for rows, length, x in packed(part.column(1)):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), length, np.int32)), x], ["id", "length", "x"])

    return df.select(F.col(id).alias("id"), F.col(vector).alias("vector")).mapInArrow(lean(run), f"id {kind}, length int, x binary")


# ---------------------------------------------------------------- trees of states


def merged(rows: DataFrame, leaf: Callable[[Iterator[pa.RecordBatch]], bytes | None], join: Callable[[list[bytes]], bytes]) -> bytes:
    """One state of all rows: a leaf for each partition, then ``FAN_IN`` states at a time; the driver gets the last."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = leaf(batches)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "state": pa.array([state], pa.binary())})

    def inner(group: pa.Table) -> pa.Table:
        return pa.table({"part": group.column("part")[:1].cast(pa.int32()), "state": pa.array([join(group.column("state").to_pylist())], pa.binary())})

    states = checkpoint(rows.mapInArrow(lean(leaves), "part int, state binary"))
    parts = states.agg(F.max("part")).first()[0] + 1
    while parts > 1:
        states = states.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("part").applyInArrow(inner, "part int, state binary")
        parts = -(-parts // FAN_IN)
    return states.first()["state"]


def steps(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, len(batch), STEP_ROWS):
            yield unpacked(batch.column("x")[at : at + STEP_ROWS], length)


def exact_sums(fit: DataFrame, length: int) -> tuple[int, list[int]]:
    """(n, sum of each dimension's x - SHIFT) over the fit list, of any size."""

    def leaf(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        n, total = 0, [0] * length
        for v in steps(batches, length):
            n += len(v)
            high, low = (v >> 32).sum(0).tolist(), (v & 0xFFFFFFFF).sum(0).tolist()
            total = [t + (h << 32) + x for t, h, x in zip(total, high, low, strict=True)]
        return json.dumps([n, *total]).encode() if n else None

    got = merged(fit, leaf, lambda states: json.dumps([sum(c) for c in zip(*map(json.loads, states), strict=True)]).encode())
    n, *total = json.loads(got)
    return n, total


def deviations(v: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S, exact: longs where they suffice, else Python's integers."""
    if n * max(1, int(np.abs(v).max(initial=0))) + max(map(abs, total), default=0) < MOST:
        return v * n - np.array(total, np.int64)
    return v.astype(object) * n - np.array(total, object)


def centred(v: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    return (deviations(v, n, total) / n).astype(np.float64)


def triangle(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(parts), mode="r")


def tsqr(fit: DataFrame, length: int, n: int, total: list[int]) -> np.ndarray:
    """R of the centred fit list."""

    def leaf(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        r = np.zeros((0, length))
        for v in steps(batches, length):
            r = triangle([r, centred(v, n, total)])
        return r.tobytes() if len(r) else None

    join = lambda states: triangle([np.frombuffer(s).reshape(-1, length) for s in states]).tobytes()
    return np.frombuffer(merged(fit, leaf, join)).reshape(-1, length)


def identity_error(fit: DataFrame, n: int, total: list[int], to: np.ndarray) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, over the components with spread."""
    length, k = to.shape
    if not k:
        return None

    def leaf(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        out = np.zeros((k, k))
        for v in steps(batches, length):
            w = centred(v, n, total) @ to
            out += w.T @ w
        return out.tobytes()

    got = merged(fit, leaf, lambda states: sum(np.frombuffer(s) for s in states).tobytes())
    return float(np.abs(np.frombuffer(got).reshape(k, k) / n - np.eye(k)).max())


# ---------------------------------------------------------------- the operator


def squares(d: np.ndarray) -> pa.Array:
    """Sum of squares of each row as a long; null beyond it."""
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < MOST:
        return pa.array((d * d).sum(1))
    exact = (d.astype(object) ** 2).sum(1)
    return pa.array([x if x < 1 << 63 else None for x in exact.tolist()], pa.int64())


def whitened(df: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector that counts and component."""
    kind = df.schema[id].dataType.simpleString()
    name = "`" + id.replace("`", "``") + "`"
    schema = f"{name} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    own = vectors(df, id, vector)
    fit = checkpoint(own.select("length", "x").distinct())
    most = fit.groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).first()
    if most is None:
        return df.sparkSession.createDataFrame([], schema)
    length = most["length"]
    fit = fit.where(F.col("length") == length).select("x")
    n, total = exact_sums(fit, length)
    _, s, right = np.linalg.svd(tsqr(fit, length, n, total))
    s = np.append(s, np.zeros(length - len(s)))  # fewer vectors than entries
    k = min(components, length)
    spread = s[:k] > s[0] * length * NO_SPREAD
    to = right[:k].T / np.where(spread, s[:k], 1) * np.sqrt(n)
    share = s[:k] ** 2 / (s**2).sum() if s[0] > 0 else None
    error = identity_error(fit, n, total, to[:, spread])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), STEP_ROWS):
                part = batch[at : at + STEP_ROWS]
                m = len(part)
                d = deviations(unpacked(part.column("x"), length), n, total)
                w = (d / n).astype(np.float64) @ to
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [part.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), squares(d).take(each)]
                columns += [pa.array(w.ravel(), mask=np.tile(~spread, m)), pa.nulls(m * k, pa.float64()) if share is None else pa.array(np.tile(share, m))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([error] * (m * k), pa.float64())], [id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return own.where(F.col("length") == length).mapInArrow(lean(run), schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
