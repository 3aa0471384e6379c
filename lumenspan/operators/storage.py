"""Tables as day-partitioned Parquet: writing, deduplication, retention, the cold tier and statistics."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import RETENTION_DAYS, SORT_KEYS, TABLES

DAY_NS = 86_400_000_000_000


def with_day(df: DataFrame) -> DataFrame:
    """``dt``: the UTC day of ``ts_ns``."""
    return df.withColumn("dt", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts_ns") / DAY_NS).cast("int")))


def write(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """Append to a table: a folder per day, rows in order of the table's key, a Bloom filter on trace ids."""
    keys = [k for k in SORT_KEYS.get(table, ()) if k in df.columns]
    out = with_day(df).repartition("dt", F.pmod(F.xxhash64(*keys), F.lit(16))).sortWithinPartitions("dt", *keys)
    writer = out.write.mode(mode).partitionBy("dt").option("compression", "zstd")
    if "trace_id" in df.columns:
        writer = writer.option("parquet.bloom.filter.enabled#trace_id", "true")
    writer.parquet(path)


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    schema = TABLES[table]
    return spark.read.schema(type(schema)(schema.fields[:]).add("dt", "date")).parquet(path)


def latest_version(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key, that of the highest version."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def distinct_rows(df: DataFrame, table: str) -> DataFrame:
    """One row for each key of the table, as a delivery can be repeated."""
    return df.dropDuplicates([k for k in SORT_KEYS[table] if k in df.columns])


def log_days(severity: F.Column) -> F.Column:
    """Days that a log is kept, by severity."""
    return F.when(severity >= 17, 90).when(severity >= 9, 14).otherwise(1)


def alive(df: DataFrame, table: str, now_ns: int) -> DataFrame:
    """Rows within their retention at ``now_ns``."""
    if table == "logs":
        return df.where(F.col("ts_ns") >= now_ns - log_days(F.col("severity_number")).cast("long") * DAY_NS)
    return df.where(F.col("ts_ns" if "ts_ns" in df.columns else "bucket") >= now_ns - RETENTION_DAYS[table] * DAY_NS)


@dataclass(frozen=True)
class Manifest:
    table: str
    day: str
    rows: int
    files: int
    path: str


class ColdTier:
    """Days moved to another folder: exported with a manifest, dropped only if it still holds, restored by the columns that still exist."""

    def __init__(self, spark: SparkSession, hot: str, cold: str):
        self.spark, self.hot, self.cold = spark, hot.rstrip("/"), cold.rstrip("/")

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _files(self, path: str) -> int:
        fs, at = self._fs(path)
        return sum(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(at)) if fs.exists(at) else 0

    def size(self, table: str, day: date | str) -> int:
        """Bytes of a hot day."""
        fs, at = self._fs(f"{self.hot}/{table}/dt={day}")
        return fs.getContentSummary(at).getLength() if fs.exists(at) else 0

    def _table(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.hot}/{table}")

    def candidates(self, table: str, older_than_ns: int) -> DataFrame:
        """Days all of whose rows are older."""
        days = self._table(table).groupBy("dt").agg(F.count(F.lit(1)).alias("n_rows"), F.max("ts_ns").alias("newest_ns"))
        return days.where(F.col("newest_ns") < older_than_ns).orderBy("dt")

    def export(self, table: str, day: date | str) -> Manifest:
        own = self._table(table).where(F.col("dt") == F.lit(str(day)).cast("date")).drop("dt")
        path = f"{self.cold}/{table}/dt={day}"
        distinct_rows(own, table).write.mode("overwrite").option("compression", "zstd").parquet(path)
        # the keys alone say how many rows there must be
        kept, wanted = self.spark.read.parquet(path).count(), own.select(*(k for k in SORT_KEYS[table] if k in own.columns)).distinct().count()
        if kept != wanted:
            raise RuntimeError(f"{path} holds {kept} rows of {wanted}")
        manifest = Manifest(table, str(day), kept, self._files(path), path)
        fs, at = self._fs(f"{self.cold}/{table}/_manifests/{day}.json")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(manifest.__dict__).encode()))
        out.close()
        return manifest

    def manifest(self, table: str, day: date | str) -> Manifest | None:
        fs, at = self._fs(f"{self.cold}/{table}/_manifests/{day}.json")
        if not fs.exists(at):
            return None
        text = "\n".join(r.value for r in self.spark.read.text(at.toString()).collect())
        return Manifest(**json.loads(text))

    def drop(self, table: str, day: date | str) -> None:
        """Delete a hot day; refused without a manifest, with other files than it names, or if the day has changed since."""
        m = self.manifest(table, day)
        if m is None:
            raise RuntimeError(f"{table} {day} has no manifest")
        if self._files(m.path) != m.files:
            raise RuntimeError(f"{m.path} has not the {m.files} files of its manifest")
        now = distinct_rows(self._table(table).where(F.col("dt") == F.lit(str(day)).cast("date")).drop("dt"), table).count()
        if now != m.rows:
            raise RuntimeError(f"{table} {day} has {now} rows now, {m.rows} were exported")
        fs, at = self._fs(f"{self.hot}/{table}/dt={day}")
        fs.delete(at, True)

    def restore(self, table: str, day: date | str) -> int:
        """Append a cold day to the hot table, with the columns that both have."""
        m = self.manifest(table, day)
        if m is None:
            raise RuntimeError(f"{table} {day} has no manifest")
        cold = self.spark.read.parquet(m.path)
        live = [f.name for f in TABLES[table].fields]
        cold.select(*(c for c in live if c in cold.columns)).write.mode("append").parquet(f"{self.hot}/{table}/dt={day}")
        return m.rows


def stats(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Per table: files, bytes, rows, bytes of its columns before and after compression, and the ratio, from Parquet footers."""
    return column_stats(spark, paths).groupBy("table").agg(
        F.count_distinct("file").alias("n_files"), F.sum("compressed").alias("compressed_bytes"), F.sum("uncompressed").alias("uncompressed_bytes"),
        F.round(F.sum("uncompressed") / F.greatest(F.sum("compressed"), F.lit(1)), 2).alias("ratio"), F.sum(F.when(F.col("first"), F.col("rows"))).alias("n_rows"),
    )


def column_stats(spark: SparkSession, paths: dict[str, str | list[str]]) -> DataFrame:
    """A row for each file, row group and column: rows and bytes, read by tasks from the files' footers."""
    import pyarrow as pa

    listed = None
    for table, path in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select(F.lit(table).alias("table"), F.col("path").alias("file"))
        listed = files if listed is None else listed.unionByName(files)

    def footers(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        for b in batches:
            rows = []
            for table, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, where = fs.FileSystem.from_uri(file)
                with store.open_input_file(where) as f:
                    meta = pq.ParquetFile(f).metadata
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        x = group.column(c)
                        rows.append((table, file, x.path_in_schema, c == 0, group.num_rows, x.total_compressed_size, x.total_uncompressed_size))
            if rows:
                types = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["table", "file", "column", "first", "rows", "compressed", "uncompressed"])

    return listed.mapInArrow(footers, "table string, file string, column string, first boolean, rows long, compressed long, uncompressed long")


def estimated_rows(spark: SparkSession, path: str | list[str]) -> int:
    """Rows of a table, or of some of its folders, from their footers, without reading them."""
    return column_stats(spark, {"t": path}).where("first").agg(F.sum("rows")).first()[0] or 0


def readable(size: float) -> str:
    """Bytes as text with binary units."""
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if size < 1024:
            return f"{size:.2f} {unit}"
        size /= 1024
    return f"{size:.2f} PiB"
