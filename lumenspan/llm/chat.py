"""Chat formatting with budgeted windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template. No text holds one after escaping, which puts a backslash behind each of its
#: first characters and behind each backslash, so that undoing it needs no context.
BEGIN, CLOSE = "<s>", "</s>"
ROLE_END = "[/INST]"
ROLE = "[INST]"
MASK = "<m>"
#: A training window ends with this mark.
WINDOW = "<w>"


def escaped(text: Column) -> Column:
    """Text in which every ``<``, ``[`` and backslash is followed by a backslash, so that no mark can occur."""
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def turn_tokens(text: Column) -> Column:
    """Estimated tokens of a turn: words and the four marks around it."""
    return (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 4).cast("long")


def _history(last: Column, n: Column, room: Column, history: int) -> tuple[Column, Column]:
    """How many of the last turns are repeated before a span that begins with a turn of n tokens, and their tokens: as many as leave half of the room, and that turn's place, free."""
    count, tokens, total = F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(1, history + 1):
        total = total + F.coalesce(F.get(last, F.lit(k - 1)), F.lit(0))
        fits = (F.size(last) >= k) & (total * 2 <= room) & (total + n <= room)
        count, tokens = F.when(fits, k).otherwise(count), F.when(fits, total).otherwise(tokens)
    return count, tokens


def formatted(turns: DataFrame, budget: int = 1024, history: int = 2) -> DataFrame:
    """Format conversations (``conv_id, turn, role, text``) as windows of whole turns within a token budget.

    The conversation's system turns are reserved first; the rest of the budget is room for spans of whole turns, chosen
    by running sums of the turns' tokens: a turn that would pass the room opens a new span. Each span becomes a window:
    the system turns before it, up to ``history`` turns before it, then the span. History takes at most half of the
    room and is shortened, from its oldest turn on, until the span's first turn fits. So no window passes the
    budget, but one whose single turn doesn't fit beside the system turns: turns are never cut, and a turn that is larger
    than the room stands alone with them. Assistant turns in the span are targets; system turns and history are
    repeated context and are masked, so each assistant text is a target once.

    A turn is written as ``<s>`` role number ``[INST]`` text ``[/INST]`` ``</s>`` with the text escaped; ``<m>``
    before ``</s>`` marks a masked copy. The number of the turn lets a reader drop repeated copies.

    Output: conv_id, windows: array of (span, text, estimated_tokens: the sum of ``turn_tokens``). Null text counts as
    empty, null role as the empty role; null turns come first; equal turns go in the order of role and text; null
    conv_ids form one conversation; other columns are ignored; an empty table gives no rows. A conversation is one
    array, as its digest needs all of it; each turn is read a bounded number of times.
    """
    # sorted whole turns of each conversation
    one = F.struct(
        F.coalesce("turn", F.lit(-(1 << 31))).cast("long").alias("t"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    conv = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    conv = conv.withColumn("turns", F.transform("turns", lambda x, i: F.struct(i.alias("i"), x["role"].alias("role"), x["text"].alias("text"), turn_tokens(x["text"]).alias("n"))))
    conv = conv.withColumn("systems", F.filter("turns", lambda x: x["role"] == "system"))
    conv = conv.withColumn("room", F.greatest(F.lit(0), budget - F.aggregate("systems", F.lit(0).cast("long"), lambda a, x: a + x["n"])))
    start = F.struct(
        F.lit(0).alias("first"), F.lit(0).alias("past"), F.lit(0).cast("long").alias("used"),
        F.array().cast("array<bigint>").alias("last"), F.array().cast("array<struct<first:int,end:int,past:int>>").alias("spans"),
    )

    def span(acc: Column, end: Column) -> Column:
        return F.struct(acc["first"].alias("first"), end.alias("end"), acc["past"].alias("past"))

    def place(acc: Column, x: Column) -> Column:
        # system turns are reserved already
        n = F.when(x["role"] == "system", F.lit(0).cast("long")).otherwise(x["n"])
        over = (x["i"] > acc["first"]) & (acc["used"] + n > F.col("room"))
        past, tokens = _history(acc["last"], n, F.col("room"), history)
        return F.struct(
            F.when(over, x["i"]).otherwise(acc["first"]).alias("first"),
            F.when(over, past).otherwise(acc["past"]).alias("past"),
            (F.when(over, tokens).otherwise(acc["used"]) + n).alias("used"),
            F.slice(F.concat(F.array(n), acc["last"]), 1, history).alias("last") if history else acc["last"].alias("last"),
            F.when(over, F.array_append(acc["spans"], span(acc, x["i"]))).otherwise(acc["spans"]).alias("spans"),
        )

    size = F.size("turns")
    conv = conv.withColumn("spans", F.aggregate("turns", start, place, lambda acc: F.array_append(acc["spans"], span(acc, size))))

    def window(w: Column, k: Column) -> Column:
        since = w["first"] - w["past"]
        system = F.filter("systems", lambda x: x["i"] < since)
        past, own = F.slice("turns", since + 1, w["past"]), F.slice("turns", w["first"] + 1, w["end"] - w["first"])

        def written(x: Column, repeated: bool) -> Column:
            target = F.lit(False) if repeated else x["role"] == "assistant"
            return F.concat(F.lit(BEGIN), escaped(x["role"]), F.lit(" "), x["i"].cast("string"), F.lit(ROLE), escaped(x["text"]), F.lit(ROLE_END), F.when(target, "").otherwise(MASK), F.lit(CLOSE))

        parts = F.concat(F.transform(system, lambda x: written(x, True)), F.transform(past, lambda x: written(x, True)), F.transform(own, lambda x: written(x, False)))
        tokens = F.aggregate(F.concat(system, past, own), F.lit(0).cast("long"), lambda a, x: a + x["n"])
        return F.struct(k.alias("span"), F.concat(F.array_join(parts, ""), F.lit(WINDOW)).alias("text"), tokens.alias("estimated_tokens"))

    return conv.select("conv_id", F.transform("spans", window).alias("windows"))


def read_back(windows: DataFrame) -> DataFrame:
    """Turns of formatted conversations: conv_id, turns: array of (i, role, text, target) in order, each turn once.

    A repeated copy is dropped for the copy in the turn's own window, which is the last one with its number.
    """
    parts = F.flatten(F.transform("windows", lambda w: F.split(w["text"], r"<s>|</s>(?:<s>)?|<w>")))
    pieces = F.filter(parts, lambda p: F.length(p) > 0)

    def read(p: Column) -> Column:
        head = F.substring_index(p, ROLE, 1)
        body = F.substring_index(F.substring(p, F.length(head) + len(ROLE) + 1, F.length(p)), ROLE_END, 1)
        masked = p.endswith(ROLE_END + MASK)
        return F.struct(
            F.substring_index(head, " ", -1).cast("int").alias("i"),
            (~masked).alias("target"),
            unescaped(F.substring(head, F.lit(1), F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1)).alias("role"),
            unescaped(body).alias("text"),
        )

    copies = F.array_sort(F.transform(pieces, read), lambda a, b: F.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).when(a["target"] & ~b["target"], -1).when(~a["target"] & b["target"], 1).otherwise(0))
    out = windows.select("conv_id", "windows", copies.alias("copies"))
    kept = F.filter("copies", lambda x, k: (k == 0) | (F.element_at("copies", F.greatest(k, F.lit(1)))["i"] != x["i"]))
    return out.select("conv_id", "windows", kept.alias("turns"))
