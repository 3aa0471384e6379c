"""Flushes of several tables in order, and what a running stream says about its health."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from ..operators.alerts import retried

#: The order in which a flush writes its tables; edges last, so that a reader never sees an edge without its spans.
ORDER = ("spans", "logs", "metrics", "log_templates", "service_edges_raw")


def flush(path: str, derive: dict[str, Callable[[DataFrame], DataFrame]], attempts: int = 5) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes several tables made from one micro-batch, one after the other in ORDER.

    Each table's part has a folder of its own by the number of the batch, so a batch that is run again overwrites what it wrote. A
    write that fails is tried again with growing delays; a query that can't be analysed never will succeed and isn't.
    """
    if unknown := set(derive) - set(ORDER):
        raise ValueError(f"tables without a place in a flush: {sorted(unknown)}")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for table in ORDER:
                if table in derive:
                    retried(lambda t=table: derive[t](batch).write.mode("overwrite").parquet(f"{path}/{t}/batch_id={batch_id}"), attempts, permanent=(AnalysisException,))
        finally:
            batch.unpersist()

    return sink


def health(progress: dict | None) -> dict[str, float]:
    """Figures of a streaming query's last progress: rows a second in and out, rows and bytes of state, rows dropped as late, and how far the source is ahead."""
    if not progress:
        return {"input_rows_per_second": 0.0, "processed_rows_per_second": 0.0, "state_rows": 0.0, "state_bytes": 0.0, "late_rows_dropped": 0.0, "lag": 0.0}
    states = progress.get("stateOperators") or []
    lag = 0.0
    for source in progress.get("sources") or []:
        metrics = source.get("metrics") or {}
        lag += float(metrics.get("maxOffsetsBehindLatest") or metrics.get("numFilesOutstanding") or 0)
    return {
        "input_rows_per_second": float(progress.get("inputRowsPerSecond") or 0), "processed_rows_per_second": float(progress.get("processedRowsPerSecond") or 0),
        "state_rows": float(sum(s.get("numRowsTotal", 0) for s in states)), "state_bytes": float(sum(s.get("memoryUsedBytes", 0) for s in states)),
        "late_rows_dropped": float(sum(s.get("numRowsDroppedByWatermark", 0) for s in states)), "lag": lag,
    }
