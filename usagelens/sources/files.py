"""History as dated partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def history(spark: SparkSession, glob: str, before: str) -> DataFrame:
    """Dated JSON documents strictly earlier than a date, with their run_date."""
    rows = spark.read.option("multiLine", True).json(glob).withColumn("run_date", F.to_date(F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})", 1)))
    return rows.where(F.col("run_date") < F.lit(before).cast("date"))


def append_history(rows: DataFrame, path: str, run_date: str | None = None) -> None:
    """Keep a summary forever, one partition a date; a rerun of a date replaces that date only, and with ``run_date`` also where it has no rows."""
    if run_date is not None and rows.isEmpty():
        spark = rows.sparkSession
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run_date={run_date}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        return
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)
