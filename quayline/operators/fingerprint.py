"""Fingerprints of tables that don't depend on the order of rows or on partitions, without a sort."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> str:
    """SHA-256 over the number of rows and two sums of the rows' 64-bit hashes."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"})
    one, two = F.xxhash64(row), F.xxhash64(F.sha2(row, 256))
    r = df.agg(F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("a"), F.sum(two.cast("decimal(38,0)")).alias("b")).head()
    return hashlib.sha256(f"{r.n}|{r.a}|{r.b}".encode()).hexdigest()


def combined(fingerprints: dict[str, str]) -> str:
    return hashlib.sha256("\n".join(f"{k}={v}" for k, v in sorted(fingerprints.items())).encode()).hexdigest()
