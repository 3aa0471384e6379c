"""Attribute cardinality: estimates per key and what happens to values above a key's budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bucket_of
from ..schema import DEFAULTS

#: Relative error of the distinct counts, that of 2**14 registers.
ERROR = 0.0081


@dataclass(frozen=True)
class Budget:
    most: int = DEFAULTS["cardinality_budget"]
    action: str = "bucket"
    buckets: int = DEFAULTS["cardinality_buckets"]


#: The budgets that the platform ships.
SHIPPED = {"http.route": Budget(500, "bucket", 128), "user.id": Budget(100_000, "drop"), "session.id": Budget(100_000, "drop"), "customer.email": Budget(1_000, "drop"), "service.name": Budget(50, "keep_and_alert")}


def estimates(spans: DataFrame, column: str = "span_attributes", exact: bool = False) -> DataFrame:
    """key, distinct_values: mergeable sketches, or exact counts."""
    entries = spans.select(F.explode(column).alias("key", "value"))
    count = F.count_distinct("value") if exact else F.approx_count_distinct("value", ERROR)
    return entries.groupBy("key").agg(count.alias("distinct_values"))


def sketches(spans: DataFrame, column: str = "span_attributes") -> DataFrame:
    """key, sketch: HyperLogLog states that merge over days."""
    return spans.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.hll_sketch_agg("value", 14).alias("sketch"))


def merged_estimates(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("key").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))


def guarded(spans: DataFrame, budgets: dict[str, Budget] = SHIPPED, default: Budget | None = None, column: str = "span_attributes", exact: bool = False, most_keys: int = DEFAULTS["tracked_keys"]) -> DataFrame:
    """Spans whose attributes above budget are dropped or put into buckets, and ``alerts``: the keys that are over and kept.

    The keys over budget come from a first pass. At most ``most_keys`` of them are guarded, those with the most values, as the
    platform tracks no more; so what is joined is one row of bounded size.
    """
    default = default or Budget()
    table = F.create_map(*(x for k, b in budgets.items() for x in (F.lit(k), F.struct(F.lit(b.most).alias("most"), F.lit(b.action).alias("action"), F.lit(b.buckets).alias("buckets"))))) if budgets else None
    own = F.struct(F.lit(default.most).alias("most"), F.lit(default.action).alias("action"), F.lit(default.buckets).alias("buckets"))
    rule = F.coalesce(table[F.col("key")], own) if table is not None else own
    over = estimates(spans, column, exact).withColumn("rule", rule).where(F.col("distinct_values") > F.col("rule.most"))
    over = over.orderBy(F.desc("distinct_values"), "key").limit(most_keys)
    over = over.agg(F.map_from_entries(F.collect_list(F.struct("key", "rule"))).alias("__over"))
    joined = spans.join(F.broadcast(over))
    action = lambda k: F.col("__over")[k]["action"]
    kept = F.map_filter(column, lambda k, v: F.coalesce(action(k) != "drop", F.lit(True)))
    kept = F.transform_values(kept, lambda k, v: F.when(action(k) == "bucket", _bucketed(v, F.col("__over")[k]["buckets"])).otherwise(v))
    alerts = F.array_sort(F.map_keys(F.map_filter(column, lambda k, v: F.coalesce(action(k) == "keep_and_alert", F.lit(False)))))
    return joined.withColumns({column: kept, "alerts": alerts}).drop("__over")


def _bucketed(value: Column, buckets: Column) -> Column:
    return F.concat(F.lit("bucket_"), F.pmod(F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long"), buckets).cast("string"))


__all__ = ["Budget", "SHIPPED", "bucket_of", "estimates", "guarded", "merged_estimates", "sketches"]
