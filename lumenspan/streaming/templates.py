"""Log templates over a stream: each leaf's clusters are state, so that a template goes on widening."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.logs import WILD, Leaf, tokens_of
from ..schema import DEFAULTS

OUTPUT = "leaf string, ts_ns long, body string, local_id long, template_text string, params array<string>, changed boolean"


def templates(lines: DataFrame, depth: int = DEFAULTS["drain_depth"], similarity: float = DEFAULTS["drain_similarity"]) -> DataFrame:
    """Lines (ts_ns, body) with their template as it is then; ``changed`` marks a template that is new or has widened."""
    tokens = tokens_of(F.col("body"))
    lead = F.transform(F.slice(tokens, 1, max(depth - 2, 0)), lambda t: F.when(t.rlike("[0-9]"), WILD).otherwise(t))
    keyed = lines.select("ts_ns", F.coalesce("body", F.lit("")).alias("body"), F.concat_ws("\x1f", F.size(tokens).cast("string"), lead).alias("leaf"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        leaf = Leaf(similarity)
        if state.exists:
            made, ids, texts = state.get
            leaf.restore(made, dict(zip(ids, texts, strict=True)))
        known = dict(leaf.text)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts_ns", "body"])
        for ts, body in zip(rows.ts_ns, rows.body, strict=True):
            words = body.split() or [""]
            i, _ = leaf.add(words)
            text = leaf.text[i]
            out.append((key[0], ts, body, i, text, [words[k] for k in leaf.wild[i]], known.get(i) != text))
            known[i] = text
        state.update((leaf.made, list(leaf.clusters), [leaf.text[i] for i in leaf.clusters]))
        yield pd.DataFrame(out, columns=["leaf", "ts_ns", "body", "local_id", "template_text", "params", "changed"])

    return keyed.groupBy("leaf").applyInPandasWithState(step, OUTPUT, "made long, ids array<long>, texts array<string>", "append", "NoTimeout")
