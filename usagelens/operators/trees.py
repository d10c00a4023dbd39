"""Roots of parent links by pointer doubling: as many joins as the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.operators.lineage import checkpoint


def roots(links: DataFrame, id: str = "id", parent: str = "parent_id") -> DataFrame:
    """(id, root_id, state) of each id: ``root`` its own one, ``child`` below a root, ``orphan`` below a parent that isn't there, ``cycle`` in a cycle or below one.

    Orphans and cycles have no root. A null id is left out; of an id with several parents the least counts.
    """
    own = links.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(parent).alias("to"))
    there = own.select(F.col("id").alias("to"), F.lit(True).alias("there"))
    start = own.join(there, "to", "left")
    # ``to`` is the highest ancestor known so far; ``end`` says that nothing lies above it.
    end = F.when(F.col("to").isNull(), "root").when(F.col("there").isNull(), "orphan")
    now = checkpoint(start.select("id", F.when(F.col("to").isNull(), F.col("id")).otherwise(F.col("to")).alias("to"), end.alias("end")))
    left = now.where("end is null").count()
    rounds = left.bit_length() + 1
    while left and rounds:
        above = now.select(F.col("id").alias("to"), F.col("to").alias("higher"), F.col("end").alias("above"))
        met = now.where("end is null").join(above, "to").select("id", F.when(F.col("above") == "orphan", F.col("to")).otherwise(F.col("higher")).alias("to"), F.col("above").alias("end"))
        now = checkpoint(now.where("end is not null").unionAll(met))
        left, rounds = now.where("end is null").count(), rounds - 1
    state = F.when(F.col("end").isNull(), "cycle").when(F.col("end") == "orphan", "orphan").when(F.col("id") == F.col("to"), "root").otherwise("child")
    return now.select("id", F.when(F.col("end") == "root", F.col("to")).alias("root_id"), state.alias("state"))
