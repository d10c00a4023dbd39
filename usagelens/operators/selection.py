"""Exact order statistics of a column by narrowing histograms: no task and no driver holds the values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a pass; as many rows come to the driver at most.
BINS = 4096
#: So few values of a bin are fetched as they are.
FEW = 4096


def ranked_values(df: DataFrame, value: str | Column, ranks: list[int] | None = None) -> list[float]:
    """The values at the places ``ranks`` from 0 in ascending order; without ranks, the one or two in the middle. Nulls don't count.

    A pass counts the values in bins of equal width between the least and the greatest; the next one looks at the bin of the place alone.
    The bin of a value never falls as the value grows, so the places are exact. The frame is read once a pass and should be written.
    """
    value = F.col(value) if isinstance(value, str) else value
    x = df.select(value.cast("double").alias("x")).where("x is not null")
    lo, hi, n = x.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if ranks is None:
        ranks = sorted({(n - 1) // 2, n // 2}) if n else []
    found: dict[int, float] = {}

    def narrow(lo: float, hi: float, n: int, before: int, places: list[int]) -> None:
        if lo == hi:
            found.update(dict.fromkeys(places, lo))
            return
        inside = x.where(F.col("x").between(lo, hi))
        if n <= FEW:
            own = sorted(r.x for r in inside.collect())
            found.update({p: own[p - before] for p in places})
            return
        # Halves, so that the width of any range is finite.
        width = (hi / 2 - lo / 2) or (hi - lo) / 2
        bin = F.least(F.floor((F.col("x") / 2 - F.lit(lo / 2)) / F.lit(width) * BINS), F.lit(BINS - 1)).alias("bin")
        for r in sorted(inside.groupBy(bin).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")).collect()):
            own = [p for p in places if before <= p < before + r.n]
            if own:
                narrow(r.lo, r.hi, r.n, before, own)
            before += r.n

    if ranks:
        narrow(lo, hi, n, 0, [p for p in ranks if 0 <= p < n])
    return [found[p] for p in ranks if p in found]


def exact_median(df: DataFrame, value: str | Column) -> float | None:
    """The median, the mean of the middle two of an even number; null of no values."""
    middle = ranked_values(df, value)
    return middle[0] * 0.5 + middle[-1] * 0.5 if middle else None
