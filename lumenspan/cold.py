"""The cold tier from a command line: ``python -m lumenspan.cold --hot URI --cold URI [--table T] [--older-than 720h] [--export [--drop]] [--restore DAY]``.

Without --export it only lists the days that would be exported.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .operators.storage import ColdTier, readable
from .plans.language import duration_ns


def tiered(tier: ColdTier, table: str, older_than: str, export: bool = False, drop: bool = False, now_ns: int | None = None) -> list[str]:
    """Export, and drop, each day of a table all of whose rows are older; a line for each. Without ``export`` nothing is written."""
    age = duration_ns(older_than)
    if age is None:
        raise ValueError(f"invalid duration {older_than!r}")
    if drop and not export:
        raise ValueError("a day is dropped only after it was exported")
    said = []
    for day in tier.candidates(table, max(0, (now_ns or time.time_ns()) - age)).toLocalIterator():
        if not export:
            said.append(f"would export {table} {day.dt}: {day.n_rows} rows, {readable(tier.size(table, day.dt))}")
            continue
        m = tier.export(table, day.dt)
        said.append(f"exported {table} {day.dt}: {m.rows} rows verified")
        if drop:
            tier.drop(table, day.dt)
            said.append(f"dropped {table} {day.dt}")
    return said or [f"{table} has no day older than {older_than}"]


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lumenspan.cold")
    p.add_argument("--hot", required=True)
    p.add_argument("--cold", required=True)
    p.add_argument("--table", default="spans", choices=("spans", "logs", "metrics"))
    p.add_argument("--older-than", default="720h")
    p.add_argument("--export", action="store_true")
    p.add_argument("--drop", action="store_true")
    p.add_argument("--restore")
    a = p.parse_args(arguments)
    tier = ColdTier(SparkSession.builder.getOrCreate(), a.hot, a.cold)
    if a.restore:
        print(f"restored {a.table} {a.restore}: {tier.restore(a.table, a.restore)} rows")
        return
    print("\n".join(tiered(tier, a.table, a.older_than, a.export, a.drop)))


if __name__ == "__main__":
    main()
