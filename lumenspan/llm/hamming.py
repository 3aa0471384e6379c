"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import remove, staged

#: Bits of a segment: its values are looked up with all values of up to a radius around them.
SEGMENT = 16


def coded(table: DataFrame, id_column: str, vector: str, words: int) -> DataFrame:
    """id and words w0, w1, ... of 64 sign bits of the vector: bit i is set if dimension i is above 0."""
    out = [F.col(id_column).cast("long").alias("id")]
    for k in range(words):
        part = F.slice(F.coalesce(vector, F.array().cast("array<float>")), 64 * k + 1, 64)
        bits = F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        out.append(F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)).alias(f"w{k}"))
    return table.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).select(*out)


def _masks(spark: SparkSession, radius: int, parts: int) -> DataFrame:
    """For each segment the 16-bit values with ``radius`` bits set: at most 12,870 each, whatever the data."""
    values = spark.range(1 << SEGMENT).select(F.col("id").cast("int").alias("mask")).where(F.bit_count("mask") == radius)
    return values.select("mask", F.explode(F.array(*map(F.lit, range(parts)))).alias("segment"))


def _segments(words: int) -> list[Column]:
    return [F.call_function("shiftrightunsigned", F.col(f"w{j * SEGMENT // 64}"), F.lit(j * SEGMENT % 64)).bitwiseAND(F.lit((1 << SEGMENT) - 1)).cast("int") for j in range(words * 64 // SEGMENT)]


def top_k(table: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, neighbor_id, distance: the k rows of ``table`` nearest to each query by Hamming distance of the sign codes.

    Codes are cut into segments of 16 bits. In round r each open query looks up, in each segment, all values at
    distance r from its own, so that after the round every code within ``segments * (r + 1) - 1`` bits has been
    met. A query is closed when its k-th verified distance is at most that: nothing unseen can be nearer or as near.
    A lookup keeps only codes that are not farther than the k-th so far.

    Equal codes are one entry with its k smallest ids, so a code that very many rows share costs no more. Equal distances
    are ordered by id; a query is found by itself if the table has it. Null ids and null vectors are left out; vectors of
    different lengths are filled up with zeros; repeated ids are one row; fewer than k rows give all of them; other
    columns are ignored; an empty table or no queries give no rows.
    """
    spark = table.sparkSession
    width = table.agg(F.max(F.size(vector))).first()[0] or 1
    words = max(1, -(-width // 64))
    names = [f"w{i}" for i in range(words)]
    rows = coded(table, id_column, vector, words).dropDuplicates(["id"])
    first = F.row_number().over(Window.partitionBy(*names).orderBy("id"))
    codes = staged(rows.withColumn("n", first).where(F.col("n") <= k).groupBy(*names).agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    # one entry for each segment's value
    index = codes.select(*names, "ids", F.posexplode(F.array(*_segments(words))).alias("segment", "value"))
    asked = staged(coded(queries, id_column, vector, words).dropDuplicates(["id"]).withColumnRenamed("id", "query_id"), "queries")
    parts = words * 64 // SEGMENT
    far = 64 * words + 1
    open_ = asked.withColumn("most", F.lit(far))
    best: DataFrame | None = None
    closed: list[DataFrame] = []
    for radius in range(SEGMENT + 1):
        probes = open_.select("query_id", "most", *(F.col(n).alias(f"q_{n}") for n in names), F.posexplode(F.array(*_segments(words))).alias("segment", "own"))
        probes = probes.join(F.broadcast(_masks(spark, radius, parts)), "segment").withColumn("value", F.col("own").bitwiseXOR(F.col("mask"))).drop("own", "mask")
        distance = reduce(lambda a, b: a + b, (F.bit_count(F.col(n).bitwiseXOR(F.col(f"q_{n}"))) for n in names))
        p, i = probes.alias("p"), index.alias("i")
        met = p.join(i, (F.col("p.segment") == F.col("i.segment")) & (F.col("p.value") == F.col("i.value")) & (distance <= F.col("most")))
        met = met.select("query_id", distance.alias("distance"), F.explode("ids").alias("neighbor_id"))
        if best is not None:
            met = met.unionByName(best.drop("rank").join(open_.select("query_id"), "query_id"))
        met = met.dropDuplicates(["query_id", "neighbor_id"])
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
        best = staged(met.withColumn("rank", rank).where(F.col("rank") <= k), "best")
        covered = parts * (radius + 1) - 1
        state = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d"))
        seen = open_.drop("most").join(state, "query_id", "left")
        full = F.coalesce(F.col("n") >= k, F.lit(False))
        done = (full & (F.col("d") <= covered)) if radius < SEGMENT else F.lit(True)
        seen = staged(seen.withColumn("most", F.when(full, F.col("d")).otherwise(far)).withColumn("done", done).drop("n", "d"), "open")
        closed.append(best.join(seen.where("done").select("query_id"), "query_id"))
        open_ = seen.where("NOT done").drop("done")
        if open_.isEmpty():
            break
    remove(spark, asked.staged_at)
    return reduce(DataFrame.unionByName, closed).select("query_id", "rank", "neighbor_id", F.col("distance").cast("int").alias("distance"))
