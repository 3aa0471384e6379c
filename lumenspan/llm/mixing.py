"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import fresh, staged

#: A word: what stands between blanks and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Fixed value: a source that the queue and one further document leave off its target by more than this part of it is filled up.
NEAR = 0.01


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.0, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per source (``skey, snull``): its size, documents, weight and target.

    Sources in order of code points, null last, weigh ``weights`` in turn and share ``share`` of all sizes. A target
    stops at ``most`` times its source's size; the excess goes to the others by weight until none is above. With the
    sources in order of cap / weight the capped ones are a prefix: source i is capped if, with all before it capped,
    an even share of what is left gives it more than its cap.
    """
    per = sizes.groupBy("skey", "snull").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    order = Window.orderBy("snull", "skey")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    all_rows = Window.partitionBy()
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "snull", "skey")
    per = per.withColumns({
        "budget": F.floor(F.sum("source_size").over(all_rows) * share),
        "caps_before": F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weights_from": F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)),
    })
    per = per.withColumn("capped", F.col("weight") * (F.col("budget") - F.col("caps_before")) >= F.col("cap") * F.col("weights_from"))
    free = ~F.col("capped")
    per = per.withColumns({
        "caps": F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(all_rows), F.lit(0)),
        "free_weight": F.sum(F.when(free, F.col("weight"))).over(all_rows),
    })
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * (F.col("budget") - F.col("caps"))).cast("double") / F.col("free_weight"))
    return per.select("skey", "snull", "source_size", "source_docs", "weight", target.alias("target"))


def _running(rows: DataFrame, lead: list[str], *order: str) -> DataFrame:
    """``running``: the sum of sizes within a source up to each row, by the columns of ``lead`` and then ``order``, in two steps over the groups of ``lead``."""
    key = ["skey", "snull", *lead]
    sums = rows.groupBy(*key).agg(F.sum("size").alias("part"))
    before = Window.partitionBy("skey", "snull").orderBy(*lead).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, F.coalesce(F.sum("part").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("inside", F.sum("size").over(inside)).join(sums, key).withColumn("running", F.col("before") + F.col("inside")).drop("before", "inside")


def _nearest(rows: DataFrame, gap: DataFrame, most: int) -> DataFrame:
    """Per source the row ``pick`` whose size is nearest to the gap, if a copy of it makes the gap smaller."""
    apart = F.abs(F.col("gap") - F.col("size"))
    candidates = rows.where((F.col("size") > 0) & (F.col("copies") < most)).join(gap, ["skey", "snull"]).where(apart < F.col("gap"))
    return candidates.groupBy("skey", "snull").agg(F.min(F.struct(apart.alias("apart"), "sent", "row", "doc_id", "size")).alias("pick"))


def _filled(rows: DataFrame, gap: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Further copies (``skey, snull, sent, more``) of rows that fit into their source's gap, and the gaps that stay.

    A round goes through the queue again, rows with fewer copies first, and takes those that fit together; if the first
    one too many is more than half of the gap and the others are less, it is taken instead. So a round halves a gap or
    takes all rows there are, and their number is logarithmic. It ends when nothing fits.
    """
    source, none = ["skey", "snull"], rows.select("skey", "snull", "sent").limit(0)
    taken, left = none, rows
    while True:
        left = staged(left.where(F.col("copies") < most).join(gap, source).where(F.col("size") <= F.col("gap")), "left")
        if left.isEmpty():
            break
        run = staged(_running(left, ["copies", "bucket"], "sent"), "run")
        over = F.col("running") > F.col("gap")
        first = over & (F.col("running") - F.col("size") <= F.col("gap"))
        step = run.groupBy(*source).agg(F.first("gap").alias("was"), F.coalesce(F.max(F.when(~over, F.col("running"))), F.lit(0)).alias("fit"), F.max(F.when(first, F.col("size"))).alias("next"))
        alone = F.coalesce((F.col("fit") * 2 < F.col("was")) & (F.col("next") > 0), F.lit(False))
        step = staged(step.withColumn("alone", alone), "step")
        marked = staged(run.join(step.select(*source, "alone"), source).withColumn("take", F.when(F.col("alone"), first).otherwise(~over)), "marked")
        taken = taken.unionByName(marked.where("take").select("skey", "snull", "sent"))
        new = F.col("was") - F.when(F.col("alone"), F.col("next")).otherwise(F.col("fit"))
        after = step.select(*source, new.alias("new"))
        gap = staged(gap.join(after, source, "left").select(*source, F.coalesce("new", "gap").alias("gap")), "gap")
        left = marked.select(*source, "bucket", "sent", "size", (F.col("copies") + F.col("take").cast("long")).alias("copies"))
    return taken.groupBy("skey", "snull", "sent").agg(F.count(F.lit(1)).alias("more")), gap


def _served(queued: DataFrame, most: int, budget: float) -> DataFrame:
    """``skey, snull, sent, copies``: how many copies of a queued row are served, and how many of them its source keeps.

    Every copy has its virtual finish time. All are range-sorted by it, a prefix sum in two steps (over the ranges, then
    in each) says how many words have been served up to a copy, and the first one beyond the budget and all behind it are cut.
    """
    each = queued.where((F.col("size") > 0) & (F.col("target") > 0)).select("skey", "snull", "sent", "size", "target", "source_size", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("turn"))
    words = F.col("turn") * F.col("source_size") + F.col("sent")
    order = ["finish", "snull", "skey", "sent"]
    each = each.select("skey", "snull", "sent", "size", (words <= F.col("target")).alias("within"), (words / F.col("target")).alias("finish"))
    each = staged(each.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "served")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = each.groupBy("range").agg(F.sum("size").alias("part"))
    sums = staged(sums.select("range", F.coalesce(F.sum("part").over(before), F.lit(0)).alias("before")), "ranges")
    inside = F.sum("size").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    served = each.withColumn("inside", inside).join(sums, "range").where(F.col("before") + F.col("inside") <= budget)
    return served.groupBy("skey", "snull", "sent").agg(F.count(F.when(F.col("within"), 1)).alias("copies"))


def schedule(docs: DataFrame, share: float = 1.0, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """How often the mix takes each document, with the virtual finish time of its first copy.

    Documents of a source are shuffled by a hash of seed and doc_id and queue up; after the last one the source starts
    again, up to ``most`` times. A copy's virtual finish time is the words its source has sent up to its end, divided
    by the source's target. All copies are sorted by it and served until the budget is used up (``_served``). Then the last
    documents are repaired: the budget that no whole document filled up was served to copies that take their source beyond its
    target, and these go back. What is then missing to a target goes to the further document of that source whose size is
    nearest to the gap, if it makes the difference smaller. A source that is still off its target by more than ``NEAR``
    of it goes through its queue again, over the documents that fit into the gap, until none does; then once more to the
    nearest one. So a source ends within ``NEAR`` of its target, or no further copy brings it nearer.

    The running sum within a source is made in two steps, over about sqrt(documents) buckets and within each, so that
    no task holds a whole source.

    Input: doc_id, text, source. Null text has size 0, is never taken and counts 0 copies; null source is a source;
    null doc_ids and repeated rows are queued each on its own; other columns are ignored; an
    empty table gives no rows. Output: doc_id, row, tkey (a hash of the text), size,
    source_size, target, copies, finish.
    """
    # rows without a doc_id are shuffled by their text
    row = F.md5(F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))))
    sizes = staged(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("skey"), F.col("source").isNull().alias("snull"), size_of(F.col("text")).alias("size"), row.alias("row"), F.xxhash64("text").alias("tkey")), "sizes")
    targets = staged(source_targets(sizes, share, most, weights), "targets")
    shuffled = sizes.join(targets, ["skey", "snull"])
    parts = F.greatest(F.lit(1), F.ceil(F.sqrt("source_docs"))).cast("long")
    shuffled = shuffled.withColumn("bucket", F.floor(F.conv(F.substring("row", 1, 8), 16, 10).cast("long") * parts / (1 << 32)))
    queued = _running(shuffled, ["bucket"], "row", "size", "doc_id", "tkey").withColumnRenamed("running", "sent")
    queued = staged(queued.select("doc_id", "row", "tkey", "skey", "snull", "size", "source_size", "target", "sent", "bucket"), "queue")
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    served = _served(queued, most, budget * (1 + 1e-12))
    queued = queued.join(served, ["skey", "snull", "sent"], "left").withColumn("copies", F.when(F.col("size") > 0, F.coalesce("copies", F.lit(0))).otherwise(0).cast("long"))
    queued = staged(queued, "queued")
    # small tables of known size, so that joins with them need not deal rows by source
    gap = staged(queued.groupBy("skey", "snull").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap")), "gaps")
    source = ["skey", "snull"]
    # a row of size > 0 is the only one of its source with its sum
    here = (F.col("sent") == F.col("pick.sent")) & (F.col("size") > 0)
    filler = staged(_nearest(queued, gap, most), "filler")
    missed = F.coalesce("pick.apart", "gap")
    far = gap.join(filler, source, "left").join(targets.select(*source, "target"), source).where(missed > NEAR * F.col("target"))
    below = F.coalesce(F.col("pick.size") <= F.col("gap"), F.lit(False))
    far = staged(far.select(*source, "gap", "pick", missed.alias("missed"), below.alias("below")), "far")
    extra = F.coalesce(here, F.lit(False)).cast("long")
    if far.isEmpty():
        out = queued.join(filler, source, "left").withColumn("extra", extra)
    else:
        rows = queued.where(F.col("size") > 0).join(far.drop("gap"), source)
        rows = rows.withColumn("copies", F.col("copies") + F.when(F.col("below"), extra).otherwise(0)).select(*source, "bucket", "sent", "size", "row", "doc_id", "copies")
        rows = staged(rows, "far_rows")
        start = far.select(*source, (F.col("gap") - F.when(F.col("below"), F.col("pick.size")).otherwise(0)).alias("gap"))
        more, rest = _filled(rows.select(*source, "bucket", "sent", "size", "copies"), start, most)
        rows = rows.join(staged(more, "more"), [*source, "sent"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0)))
        rows = staged(rows, "filled")
        last = staged(_nearest(rows, rest, most), "last")
        better = rest.join(last, source, "left").join(far.select(*source, "missed"), source).where(F.coalesce("pick.apart", "gap") < F.col("missed"))
        better = staged(better.select(*source, "pick"), "better")
        final = rows.join(better, source).select(*source, "sent", (F.col("copies") + extra).alias("final"))
        out = queued.join(filler, source, "left").join(final, [*source, "sent"], "left")
        out = out.withColumn("extra", F.when(F.col("final").isNotNull() & (F.col("size") > 0), F.col("final") - F.col("copies")).otherwise(extra))
    finish = F.when(F.col("target") > 0, F.col("sent") / F.col("target"))
    return out.select("doc_id", "row", "tkey", "size", "source_size", "target", (F.col("copies") + F.col("extra")).alias("copies"), finish.alias("finish"))


def mix(docs: DataFrame, share: float = 1.0, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """The mixed rows of ``docs`` with all their columns, whatever these are called, a row for each copy, globally sorted by virtual finish time.

    Rows with the same doc_id and text share their copies evenly, the first rows getting one more. Nulls and the rest
    are as in ``schedule``.
    """
    names = docs.columns
    own, text, doc, tkey, part, copy = fresh(names, "own", "text_hash", "doc", "tkey", "part", "copy")
    plan = schedule(docs, share, most, weights, seed).groupBy("doc_id", "tkey").agg(F.sum("copies").alias("c"), F.min("finish").alias("finish"), F.count(F.lit(1)).alias("m")).where("c > 0")
    plan = staged(plan.select(F.col("doc_id").alias(doc), F.col("tkey").alias(tkey), F.struct("c", "finish", "m").alias(part)), "plan")
    c, m = F.col(part)["c"], F.col(part)["m"]
    marked = docs.withColumns({own: F.col("doc_id"), text: F.xxhash64("text")})

    def copied(plan: DataFrame, of: Column) -> DataFrame:
        rows = marked.join(plan.hint("merge"), F.col(own).eqNullSafe(F.col(doc)) & (F.col(text) == F.col(tkey)))
        rows = rows.withColumn(copy, of).where(F.col(copy) > 0)
        return rows.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copy) - 1)))

    rows = copied(plan.where(m == 1), c)
    if not (often := plan.where(m > 1)).isEmpty():
        turn = F.row_number().over(Window.partitionBy(doc, tkey).orderBy(doc))
        rows = rows.unionByName(copied(often, F.floor(c / m) + (turn <= c % m).cast("long")))
    return rows.orderBy(F.col(part)["finish"] + F.col(copy), own).select(*names)


#: The schedule in SQL; the queue order is that of the md5 of seed and doc_id.
SCHEDULE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, coalesce(source, '') AS skey, source IS NULL AS snull, md5(concat('mix', chr(31), CAST(doc_id AS VARCHAR))) AS row,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (SELECT skey, snull, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY ALL),
weighed AS (SELECT *, CAST((row_number() OVER (ORDER BY snull, skey) - 1) % 3 + 1 AS BIGINT) AS weight, source_size * 3 AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM per),
levels AS (
  SELECT *, CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, snull, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS caps_before,
         CAST(sum(weight) OVER (ORDER BY cap / weight, snull, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights_from
  FROM weighed),
marked AS (SELECT *, weight * (budget - caps_before) >= cap * weights_from AS capped FROM levels),
targets AS (
  SELECT skey, snull, source_size,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE CAST(weight * (budget - CAST(coalesce(sum(cap) FILTER (capped) OVER (), 0) AS BIGINT)) AS DOUBLE) / CAST(sum(weight) FILTER (NOT capped) OVER () AS BIGINT) END AS target
  FROM marked),
queued AS (
  SELECT s.*, source_size, target, CAST(sum(size) OVER (PARTITION BY skey, snull ORDER BY row, size, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sent
  FROM sizes s JOIN targets USING (skey, snull)),
counted AS (SELECT *, CASE WHEN size > 0 THEN CAST(greatest(0, least(3, floor((target - sent) / source_size) + 1)) AS BIGINT) ELSE 0 END AS copies FROM queued),
gaps AS (SELECT skey, snull, any_value(target) - CAST(sum(size * copies) AS BIGINT) AS gap FROM counted GROUP BY ALL),
ranked AS (
  SELECT c.doc_id, row_number() OVER (PARTITION BY c.skey, c.snull ORDER BY abs(gap - size), sent, row, c.doc_id) AS k
  FROM counted c JOIN gaps USING (skey, snull) WHERE size > 0 AND copies < 3 AND abs(gap - size) < gap)
"""
