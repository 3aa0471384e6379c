"""Hashes of the wire format on unsigned 64-bit numbers, kept in longs by their bits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a's offset and prime, and the constants of splitmix64's finaliser.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
MASK = (1 << 64) - 1


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & MASK
    return h


def splitmix64(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fnv1a_batch(values: pd.Series) -> pd.Series:
    codes, seen = pd.factorize(values.fillna(""))
    hashes = np.array([signed(fnv1a(v.encode())) for v in seen], np.int64)
    return pd.Series(hashes[codes] if len(seen) else np.zeros(0, np.int64))


def fnv1a_of(text: Column) -> Column:
    """FNV-1a of text as the bits of a long. Equal values of a batch are hashed once."""
    return F.pandas_udf(_fnv1a_batch, "long")(text)


def series_hash(service: Column, metric: Column, labels: Column) -> Column:
    """Identity of a time series: service, metric and its labels in order of their names, each ended by a NUL."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit("\0")))
    return fnv1a_of(F.concat(service, F.lit("\0"), metric, F.lit("\0"), F.array_join(pairs, "")))


def share_of(key: Column, salt: str) -> Column:
    """A number from 0 to below 1 that depends on the key alone, from the leading 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key)), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def bucket_of(value: Column, buckets: int) -> Column:
    """``bucket_<n>``, the same for equal values."""
    return F.concat(F.lit("bucket_"), (F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long") % buckets).cast("string"))


def owner(key: Column, replicas: list[str]) -> Column:
    """Rendezvous hashing: the replica whose hash with the key is highest; a new replica takes only its own share of keys."""
    ranked = [F.struct(F.md5(F.concat(key, F.lit(f"@{r}"))).alias("h"), F.lit(r).alias("r")) for r in replicas]
    return F.array_max(F.array(*ranked))["r"]
