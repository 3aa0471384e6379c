"""Log templates: a fixed-depth tree per leaf, parameters, counts and what templating saves."""

from __future__ import annotations

from operator import eq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DEFAULTS, NO_SPAN, NO_TRACE
from ..work import gathered

WILD = "<*>"


class Leaf:
    """Clusters of lines with the same number of tokens and the same leading tokens, in order of arrival."""

    def __init__(self, similarity: float = DEFAULTS["drain_similarity"], most: int = DEFAULTS["drain_clusters_per_leaf"]):
        self.similarity, self.most = similarity, most
        self.clusters: dict[int, list[str]] = {}
        #: Places of the wildcards and the text of each cluster's template.
        self.wild: dict[int, list[int]] = {}
        self.text: dict[int, str] = {}
        self.made = 0

    def _similar(self, i: int, template: list[str], tokens: list[str]) -> int:
        """Tokens that are equal or stand at a wildcard."""
        wild = self.wild[i]
        return sum(map(eq, template, tokens)) + sum(1 for k in wild if tokens[k] != WILD)

    def add(self, tokens: list[str]) -> tuple[int, list[str]]:
        """Cluster of a line and its template, widened where they differ. A full leaf gives up the cluster used least recently."""
        best, score = None, 0
        for i, template in self.clusters.items():
            same = self._similar(i, template, tokens)
            if same > score:
                best, score = i, same
                if same == len(tokens):  # none can be nearer
                    break
        if best is None or score / len(tokens) < self.similarity:
            if len(self.clusters) >= self.most:
                old = next(iter(self.clusters))
                del self.clusters[old], self.wild[old], self.text[old]
            best = self.made
            self.made += 1
            self._set(best, list(tokens))
        else:
            template = self.clusters.pop(best)
            if score < len(tokens):
                self._set(best, [t if t == x else WILD for t, x in zip(template, tokens, strict=True)])
            else:
                self.clusters[best] = template
        return best, self.clusters[best]

    def restore(self, made: int, texts: dict[int, str]) -> None:
        """Go on from the clusters of an earlier leaf, least recently used first."""
        self.made = made
        for i, text in texts.items():
            self._set(i, text.split(" "))

    def _set(self, i: int, template: list[str]) -> None:
        self.clusters[i], self.text[i] = template, " ".join(template)
        self.wild[i] = [k for k, t in enumerate(template) if t == WILD]


def tokens_of(body: Column) -> Column:
    """Tokens between white space; an empty line is one empty token."""
    return F.split(F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", " ")), " ")


def with_templates(logs: DataFrame, depth: int = DEFAULTS["drain_depth"], similarity: float = DEFAULTS["drain_similarity"], children: int = DEFAULTS["drain_children"]) -> DataFrame:
    """Logs with template_id, template_text (as it was then) and params.

    Lines meet by leaf, in order of time. A level with more than ``children`` different tokens keeps the first ones by
    time as branches and sends the others to the wildcard; which they are is found by a grouped pass over all lines.
    """
    w = WILD
    keyed = logs.withColumn("__tokens", tokens_of(F.col("body")))
    lead = F.transform(F.slice("__tokens", 1, max(depth - 2, 0)), lambda t: F.when(t.rlike("[0-9]"), w).otherwise(t))
    keyed = keyed.withColumns({"__path": F.size("__tokens").cast("string"), "__lead": lead})
    for level in range(max(depth - 2, 0)):
        keyed = keyed.withColumn("__token", F.get("__lead", F.lit(level)))
        seen = keyed.where(F.col("__token").isNotNull()).groupBy("__path", "__token").agg(F.min("ts_ns").alias("__first"))
        rank = F.row_number().over(Window.partitionBy("__path").orderBy("__first", "__token"))
        over = seen.withColumn("__n", rank).where((F.col("__n") > children) & (F.col("__token") != w)).select("__path", "__token", F.lit(True).alias("__over"))
        keyed = keyed.join(over, ["__path", "__token"], "left")
        step = F.when(F.col("__token").isNull(), "").when(F.col("__over"), w).otherwise(F.col("__token"))
        keyed = keyed.withColumn("__path", F.concat_ws("\x1f", "__path", step)).drop("__token", "__over")
    names = logs.columns
    keyed = keyed.select(*names, "__path", "__tokens")
    schema = keyed.select(*names).schema.add("template_id", "long").add("template_text", "string").add("params", T.ArrayType(T.StringType())).add("leaf", "string")

    def run(batches):
        leaf, at = None, None
        for b in batches:
            ids, texts, params = [], [], []
            for path, tokens in zip(b.column("__path").to_pylist(), b.column("__tokens").to_pylist(), strict=True):
                if path != at:
                    leaf, at = Leaf(similarity), path
                i, _ = leaf.add(tokens)
                ids.append(i)
                texts.append(leaf.text[i])
                params.append([tokens[k] for k in leaf.wild[i]])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(params, pa.list_(pa.string())), b.column("__path")], [*names, "template_id", "template_text", "params", "leaf"])

    order = [c for c in ("ts_ns", "trace_id", "span_id", "body") if c in names]
    out = gathered(keyed, "__path", *order).mapInArrow(run, schema)
    # the id of a template is a hash of its leaf and its place there, so that no global numbering is needed
    return out.withColumn("template_id", F.pmod(F.xxhash64("leaf", "template_id"), F.lit((1 << 62) - 1))).drop("leaf")


def dictionary(parsed: DataFrame) -> DataFrame:
    """Templates with their last text, first and last use."""
    return parsed.groupBy("template_id").agg(F.max_by("template_text", F.struct("ts_ns", F.length("template_text") * -1)).alias("template_text"), F.min("ts_ns").alias("first_seen"), F.max("ts_ns").alias("updated_at"))


def latest_templates(versions: DataFrame) -> DataFrame:
    """The newest version of each template, with the first time it was seen in any."""
    return versions.groupBy("template_id").agg(F.max_by("template_text", "updated_at").alias("template_text"), F.min("first_seen").alias("first_seen"), F.max("updated_at").alias("updated_at"))


def template_counts(parsed: DataFrame, versions: DataFrame, since: int, until: int, limit: int = 0) -> DataFrame:
    """Occurrences of templates in [since, until), most frequent first; templates that the dictionary lacks have no text."""
    used = parsed.where((F.col("ts_ns") >= since) & (F.col("ts_ns") < until)).groupBy("template_id").agg(F.count(F.lit(1)).alias("occurrences"), F.min("ts_ns").alias("first_seen"), F.max("ts_ns").alias("last_seen"))
    texts = latest_templates(versions).select("template_id", "template_text")
    return used.join(texts, "template_id", "left").orderBy(F.desc("occurrences"), "template_text", "template_id").limit(limit if limit > 0 else DEFAULTS["templates_limit"])


def instances(parsed: DataFrame, template_id: int, since: int, until: int, limit: int = 0) -> DataFrame:
    """Lines of a template in [since, until), newest first; ids of zeros are blank."""
    picked = parsed.where((F.col("template_id") == template_id) & (F.col("ts_ns") >= since) & (F.col("ts_ns") < until))
    return blank_ids(picked).orderBy(F.desc("ts_ns"), "span_id").limit(limit if limit > 0 else DEFAULTS["instances_limit"])


def of_trace(logs: DataFrame, trace_id: str) -> DataFrame:
    """Logs of a trace, newest first."""
    return blank_ids(logs.where(F.col("trace_id") == trace_id.lower())).orderBy(F.desc("ts_ns"), "span_id")


def blank_ids(logs: DataFrame) -> DataFrame:
    return logs.withColumns({"trace_id": F.when(F.col("trace_id") == NO_TRACE, "").otherwise(F.col("trace_id")), "span_id": F.when(F.col("span_id") == NO_SPAN, "").otherwise(F.col("span_id"))})


def savings(parsed: DataFrame) -> DataFrame:
    """Bytes of all bodies, and bytes as template ids with parameters."""
    small = 4 + F.aggregate("params", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p) + 1)
    return parsed.agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("body")).cast("long").alias("raw_bytes"), F.sum(small).cast("long").alias("templated_bytes"))
