"""Row filters and column redaction, applied at the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def restrict(df: DataFrame, policies: Sequence[Column]) -> DataFrame:
    """Rows for which every policy is true."""
    for p in policies:
        df = df.where(p)
    return df


def redact(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Columns replaced by 'hash' (SHA-256), 'null' or a literal mask; call after row filters."""
    out = {}
    for c, rule in rules.items():
        out[c] = F.sha2(F.col(c).cast("string"), 256) if rule == "hash" else F.lit(None).cast("string") if rule == "null" else F.when(F.col(c).isNotNull(), F.lit(rule))
    return df.withColumns(out)
