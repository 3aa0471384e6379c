"""Seasonal anomaly scores and firing state as window functions, and alert transitions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULTS
from ..work import gathered

#: A normal distribution's deviation is this many median deviations; the floor of the scale.
MAD_SCALE, MAD_FLOOR = 1.4826, 1e-9


def median(values: Column) -> Column:
    """Median of an array: the middle value, or the mean of the two middle ones."""
    s, n = F.array_sort(values), F.size(values)
    half = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2)


def scores(ticks: DataFrame, window: int = DEFAULTS["window"], samples: int = DEFAULTS["min_samples"]) -> DataFrame:
    """Ticks (series, ts_ns, tick_id, value) with baseline, z and ready.

    The baseline is the median of the last ``window`` values of the series in the same hour and weekday (UTC) before the tick;
    with fewer than ``samples`` of them it is not ready.
    """
    hours = F.floor(F.col("ts_ns") / 3_600_000_000_000)
    seasonal = Window.partitionBy("series", F.pmod(hours, F.lit(168))).orderBy("ts_ns", "tick_id").rowsBetween(-window, -1)
    past = ticks.withColumn("__past", F.collect_list("value").over(seasonal))
    scored = past.withColumn("ready", F.size("__past") >= samples).withColumn("baseline", F.when(F.col("ready"), median(F.col("__past"))))
    spread = F.greatest(median(F.transform("__past", lambda v: F.abs(v - F.col("baseline")))) * MAD_SCALE, F.lit(MAD_FLOOR))
    return scored.withColumn("z", F.when(F.col("ready"), (F.col("value") - F.col("baseline")) / spread)).drop("__past")


def firing(scored: DataFrame, trigger: float = DEFAULTS["trigger"], clear: float = DEFAULTS["clear"], runs: int = DEFAULTS["consecutive"]) -> DataFrame:
    """Whether each tick's series is firing, and whether that changed.

    A series fires after ``runs`` ready ticks in a row at ``trigger`` or more, and stops after as many at ``clear`` or less;
    ticks between break a run and change nothing; ticks that are not ready are passed over.
    """
    ready = F.col("ready")
    order = Window.partitionBy("series").orderBy("ts_ns", "tick_id")
    seen = F.sum(ready.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = scored.withColumn("__seen", seen)
    own = Window.partitionBy("series", "ready").orderBy("ts_ns", "tick_id").rowsBetween(1 - runs, 0)
    whole = F.count(F.lit(1)).over(own) == runs
    event = F.when(ready & whole & F.min(F.col("z") >= trigger).over(own), True).when(ready & whole & F.min(F.col("z") <= clear).over(own), False)
    out = out.withColumn("__event", event)
    carried = F.last("__event", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("firing", F.coalesce(carried, F.lit(False)))
    return out.withColumn("state_changed", F.col("firing") != F.coalesce(F.lag("firing").over(order), F.lit(False))).drop("__seen", "__event")


COMPARE = {">": lambda v, t: v > t, ">=": lambda v, t: v >= t, "<": lambda v, t: v < t, "<=": lambda v, t: v <= t}


def transitions(values: DataFrame, op: str, threshold: float) -> DataFrame:
    """Ticks (rule, ts_ns, value) at which the comparison's outcome differs from the one before (at first: not firing)."""
    order = Window.partitionBy("rule").orderBy("ts_ns")
    now = values.withColumn("firing", COMPARE[op](F.col("value"), F.lit(threshold)))
    now = now.withColumn("__before", F.coalesce(F.lag("firing").over(order), F.lit(False)))
    return now.where("firing <> __before").drop("__before")


def notifications(changes: DataFrame, cooldown_s: int = DEFAULTS["cooldown_s"]) -> DataFrame:
    """Transitions that are sent: those at least ``cooldown_s`` after the last one sent for the rule. One after the other within a rule."""
    wait = cooldown_s * 1_000_000_000

    def run(batches):
        rule, sent = None, None
        for b in batches:
            keep = []
            for r, ts in zip(b.column("rule").to_pylist(), b.column("ts_ns").to_pylist(), strict=True):
                if r != rule:
                    rule, sent = r, None
                keep.append(sent is None or ts - sent >= wait)
                if keep[-1]:
                    sent = ts
            yield b.filter(pa.array(keep))

    return gathered(changes, "rule", "ts_ns").mapInArrow(run, changes.schema)


def latest(states: DataFrame, keys: list[str], order: str = "bucket") -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return states.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
