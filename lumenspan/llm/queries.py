"""The corpus queries of the driver's contract; each applies its operator to a whole table."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, hamming, jaccard, mixing, packing, quality, rans, secrets, suffixes


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.schedule(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = mixing.SCHEDULE_SQL + """
SELECT c.doc_id, size, source_size, target, size * (copies + CASE WHEN k = 1 THEN 1 ELSE 0 END) AS taken
FROM counted c LEFT JOIN (SELECT * FROM ranked WHERE k = 1) USING (doc_id)
"""


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hamming.top_k(table, table.where("vec_id % 100 = 0"), k=10)


OP2_SQL = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id,
         CAST(len(list_filter(range(1, 65), lambda i: (q.embedding[i] > 0) <> (r.embedding[i] > 0))) AS INTEGER) AS distance
  FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank, neighbor_id, distance
FROM pairs QUALIFY rank <= 10
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(documents(spark, sf_dir)).drop("removed")


OP3_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, encode(coalesce(text, '')) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, hash(array_slice(x, i + 1, i + 200)) AS g FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS i FROM t WHERE n >= 200)),
hits AS (SELECT doc_id, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM hits),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
runs AS (SELECT doc_id, k, min(i) AS b, max(i) + 200 AS e FROM numbered GROUP BY doc_id, k),
pieces AS (SELECT doc_id, k, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY k), 0) AS a FROM runs),
kept AS (SELECT p.doc_id, sum(e - b) AS gone, count(*) AS n_spans, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY k) || substr(any_value(h), 2 * max(e) + 1) AS rest FROM pieces p JOIN t USING (doc_id) GROUP BY p.doc_id)
SELECT t.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""


def _digest(batches):
    for batch in batches:
        ids = [np.frombuffer(x, "<u2") for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.tokens_round_trip(documents(spark, sf_dir), then=_digest, schema="doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir)).drop("ids")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), n=3, percent=90)


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
grams AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY ALL),
links AS (SELECT x, y FROM shared WHERE 100 * c >= 90 * (nx + ny - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
SELECT s.doc_id, CAST(n AS BIGINT) AS n_shingles, r.component_id
FROM sized s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON s.doc_id = r.x
"""


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    trick = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trick).alias("text"))
    turns = turns.unionByName(extra)
    back = chat.read_back(chat.formatted(turns))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["target"]), lambda x: x["text"]), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("windows", F.lit(0).cast("long"), lambda a, w: a + F.length(w["text"])).alias("formatted_chars"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The sketches hold groups of up to a few thousand rows exactly, so at such sizes the quartiles are those of sorted lists.
OP9_SQL = r"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
again AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(x, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
  FROM t JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS a, n_dup_lines / greatest(n_words, 1) AS b, n_repeat_words / greatest(n_words, 1) AS c, word_chars / greatest(n_words, 1) AS d FROM m),
q AS (SELECT lang, source, count(*) AS n, list_sort(list(a)) AS a, list_sort(list(b)) AS b, list_sort(list(c)) AS c, list_sort(list(d)) AS d FROM f WHERE NOT base_failed GROUP BY lang, source),
placed AS (SELECT *, CAST(greatest(1, ceil(0.25 * n)) AS BIGINT) AS lo, CAST(greatest(1, ceil(0.75 * n)) AS BIGINT) AS up FROM q),
most AS (SELECT lang, source, a[up] + greatest(6.0 * (a[up] - a[lo]), 0.1) AS a, b[up] + greatest(6.0 * (b[up] - b[lo]), 0.02) AS b, c[up] + greatest(6.0 * (c[up] - c[lo]), 0.25) AS c, d[up] + greatest(6.0 * (d[up] - d[lo]), 4.0) AS d FROM placed)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(f.a > most.a OR f.b > most.b OR f.c > most.c OR f.d > most.d, false) AS kept
FROM f LEFT JOIN most ON f.lang IS NOT DISTINCT FROM most.lang AND f.source IS NOT DISTINCT FROM most.source
"""


def op10_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = classifier.scored(docs, model).drop("text")
    return out.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_mixing, op2_topk, op3_suffix_dedup, op4_token_files, op5_packing, op6_jaccard, op7_chat, op8_secrets, op9_quality, op10_classifier)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op2_topk": OP2_SQL, "op3_suffix_dedup": OP3_SQL, "op6_jaccard": OP6_SQL, "op9_quality": OP9_SQL}
