"""Robust statistics and sequence operators over any frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.operators.lineage import checkpoint
from usagelens.operators.selection import exact_median

SCALE = 1.4826


def spread(df: DataFrame, value: str | Column) -> DataFrame:
    """One row (med, mad): exact median and median absolute deviation; nulls of no values. The frame is read a few times and should be written."""
    value = F.col(value) if isinstance(value, str) else value
    med = exact_median(df, value)
    mad = None if med is None else exact_median(df, F.abs(value.cast("double") - F.lit(med)))
    return df.sparkSession.createDataFrame([(med, mad)], "med double, mad double")


def robust_z(df: DataFrame, value: str, cap: float | None = None) -> DataFrame:
    """The rows with median, mad and z = (x - median) / (1.4826 mad); z is null where mad is 0."""
    z = F.try_divide(F.col(value) - F.col("median"), SCALE * F.col("mad"))
    return df.crossJoin(F.broadcast(spread(df, value).withColumnsRenamed({"med": "median"}))).withColumn("z", z if cap is None else F.least(z, F.lit(cap)))


def ranked(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """The rows with their place in the order, from 1: sorted by ranges, each numbered apart; the driver holds a count for each range."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = checkpoint(df.repartitionByRange(n, *order).sortWithinPartitions(*order)).withColumn("_range", F.spark_partition_id())
    counts = dict(rows.groupBy("_range").count().collect())
    ahead, at = [], 0
    for p in sorted(counts):
        ahead.append((p, at))
        at += counts[p]
    ahead = spark.createDataFrame(ahead or [(0, 0)], "_range int, _ahead long")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn(name, own).join(F.broadcast(ahead), "_range").withColumn(name, F.col(name) + F.col("_ahead")).drop("_range", "_ahead")


def freshest(df: DataFrame, key: str, updated: str, *tie: str) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(key).orderBy(F.col(updated).desc(), *tie)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
