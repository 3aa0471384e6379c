"""Weighted quantiles from mergeable histograms of integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A bin keeps the ten leading bits of a value, so it is off by less than 1 in 512.
PRECISION_BITS = 10


def bin_of(value: Column) -> Column:
    """Lower edge of the value's bin."""
    shift = F.greatest(F.length(F.bin(value)) - PRECISION_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def float_bin(value: Column) -> Column:
    """The bin of any number: its ten leading bits, rounded towards 0; null and not-a-number have none."""
    size = F.abs(value)
    step = F.pow(F.lit(2.0), F.floor(F.log2(size)) - (PRECISION_BITS - 1))
    edge = F.floor(size / step) * step
    return F.when(value == 0, F.lit(0.0)).when(~F.isnan(value), F.signum(value) * edge)


def whole_weight(weight: Column) -> Column:
    """Weights count in whole numbers, halves to even."""
    return F.bround(weight).cast("long")


def quantiles(bins: DataFrame, keys: list[str], levels: dict[str, float], value: str = "bin", weight: str = "w", sums: dict[str, str] | None = None) -> DataFrame:
    """Per group the smallest bin whose cumulative weight reaches each level's share of all, and sums of further columns (``{name: column}``) in the same pass."""
    sums = sums or {}
    merged = bins.groupBy(*keys, value).agg(F.sum(weight).alias("__w"), *(F.sum(c).alias(n) for n, c in sums.items()))
    w = Window.partitionBy(*keys)
    ranked = merged.withColumn("__all", F.sum("__w").over(w)).withColumn("__upto", F.sum("__w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    found = [F.min(F.when(F.col("__upto") >= q * F.col("__all"), F.col(value))).alias(name) for name, q in levels.items()]
    return ranked.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in sums), *found)


def at_index(rows: DataFrame, keys: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """Per group the values at the places int(share * (n - 1)) of the sorted ones. Equal values are counted before they are shuffled, and no group is held as a whole."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys)
    counted = counted.withColumns({"__all": F.sum("__n").over(w), "__upto": F.sum("__n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))})
    return counted.groupBy(*keys).agg(*(F.min(F.when(F.col("__upto") > F.floor(share * (F.col("__all") - 1)), F.col(value))).alias(name) for name, share in levels.items()))
