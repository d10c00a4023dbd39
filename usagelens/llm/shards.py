"""Sharding by a two-pass external shuffle.

Pass one scatters the records by a seeded hash of the row into buckets of about ``bucket_bytes``, one to a
task. Pass two puts a bucket's rows in the order of their hash, so that the outcome doesn't depend on arrival,
and shuffles them by Fisher-Yates with a generator seeded by the bucket. The buckets in turn are the whole
shuffled order; only the number of rows of each bucket reaches the driver, total bytes / bucket_bytes numbers.

Laws: ``rows`` deals the shuffled order out in turn, so counts differ by one at most. ``key`` picks the shard
by rendezvous hashing of the id alone: of one more shard's rows, each comes from its old shard, and no row
moves between old ones; buckets then lie inside shards.

Defined cases: a null text has size 1 and checksum 0; null ids are hashed like any value; equal rows are
interchangeable. All columns are kept; input columns named like an output column (shard, slot, grown_shard)
are replaced; any other name is kept. One very long text makes its bucket larger by itself. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from usagelens.llm.common import by_shard, fresh, lean, table

BUCKET_BYTES = 64 << 20
SHARDS = 8
OUTPUTS = ("shard", "slot", "grown_shard")


def rendezvous(id: Column, shards: int, seed: int) -> Column:
    weights = F.array(*[F.xxhash64(F.lit(seed), F.lit(s), id) for s in range(shards)])
    return (F.array_position(weights, F.array_max(weights)) - 1).cast("int")


def sharded(df: DataFrame, shards: int = SHARDS, law: str = "rows", seed: int = 7, id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows with shard (0 to shards-1), slot (gapless from 0 in each shard) and grown_shard (``key``: the shard of one more)."""
    if law not in ("rows", "key"):
        raise ValueError(f"no such law: {law}")
    df = df.drop(*OUTPUTS)
    size, hash_, bucket_ = F.coalesce(F.octet_length(text), F.lit(0)) + 1, fresh(df, "_h"), fresh(df, "_bucket")
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    inside = shards if law == "key" else 1
    each = max(1, -(-total // (bucket_bytes * inside)))  # by the data alone, so the order is the same on any cluster
    hashed = F.xxhash64(F.lit(seed), id, F.crc32(F.col(text).cast("binary")))
    bucket = F.pmod(hashed, F.lit(each)).cast("int")
    if law == "key":
        bucket = rendezvous(F.col(id), shards, seed) * each + bucket
    keyed = df.withColumns({hash_: hashed, bucket_: bucket})
    n = each * inside
    counts = np.zeros(n, np.int64)
    for b, c in keyed.groupBy(bucket_).count().collect():  # n numbers
        counts[b] = c
    starts = np.cumsum(counts) - counts
    if law == "key":
        starts -= np.repeat(starts[::each], each)

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        rows = pa.Table.from_batches(got)
        del got
        rows = rows.take(pa.compute.sort_indices(rows, sort_keys=[(bucket_, "ascending"), (hash_, "ascending"), (id, "ascending")]))
        buckets = rows.column(bucket_).to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(buckets, prepend=-1)), len(buckets))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            order, rng = np.arange(b - a), np.random.default_rng([seed, int(buckets[a])])
            picks = rng.integers(0, np.arange(b - a, 0, -1))
            for i in range(b - a - 1):  # Fisher-Yates
                j = i + picks[i]
                order[i], order[j] = order[j], order[i]
            at = starts[buckets[a]] + np.arange(b - a)
            shard, slot = (at % shards, at // shards) if law == "rows" else (np.full(b - a, buckets[a] // each), at)
            out = rows.slice(a, b - a).take(pa.array(order)).drop_columns([hash_, bucket_])
            yield from out.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot.astype(np.int64))).combine_chunks().to_batches(max_chunksize=2000)

    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    out = by_shard(keyed, n, bucket_).mapInArrow(lean(shuffle), schema)
    return out.withColumn("grown_shard", rendezvous(F.col(id), shards + 1, seed) if law == "key" else F.lit(None).cast("int"))


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder a shard, its rows in the order of their slots within each file."""
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharded(table(spark, sf_dir, "documents"), law="rows")
    return rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )
