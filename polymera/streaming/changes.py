"""Change streams: filtered operations, compaction and late data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_stream(events: DataFrame, operations: Sequence[str] = (), column: str = "op") -> DataFrame:
    """Events of some operations, all if none is named; batch or streaming."""
    return events.where(F.col(column).isin(*operations)) if operations else events


def compacted(changes: DataFrame, keys: Sequence[str], order: str, op: str = "op") -> DataFrame:
    """The last change of each key, without deleted keys, of a batch of changes."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), F.struct(order, op)).alias("__r")).select("__r.*")
    return last.where(F.col(op) != "delete")


def apply_to(target_path: str, keys: Sequence[str], order: str, op: str = "op") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a Parquet table of the latest rows under numbered folders.

    Batch n reads folder n - 1 and writes folder n, so a batch that is run again writes the same again. Only
    batch 0 begins without a folder before it: a later one that misses it raises rather than begin empty.
    """

    def run(batch: DataFrame, n: int) -> None:
        if n:
            batch = batch.sparkSession.read.parquet(f"{target_path}/{n - 1}").unionByName(batch, allowMissingColumns=True)
        compacted(batch, keys, order, op).write.mode("overwrite").parquet(f"{target_path}/{n}")

    return run


def late_policy(stream: DataFrame, ts: str, policy: str = "allow", delay: str = "0 seconds") -> DataFrame:
    """'allow' keeps all late rows, 'drop' forgets windows older than the watermark, 'recompute' is allow with corrections emitted."""
    if policy not in ("allow", "drop", "recompute"):
        raise ValueError(f"unknown policy {policy!r}")
    return stream.withWatermark(ts, delay) if policy == "drop" else stream


def emit_corrections(sink: Callable[[DataFrame, int], None], keys: Sequence[str], store: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for update mode: rows go to the sink with `corrects`, true where a key was emitted before."""

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(store).where(F.col("__batch") < n).select(*keys).distinct().withColumn("corrects", F.lit(True))
            out = batch.join(known, list(keys), "left").withColumn("corrects", F.coalesce("corrects", F.lit(False)))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            out = batch.withColumn("corrects", F.lit(False))
        sink(out, n)
        batch.select(*keys).withColumn("__batch", F.lit(n)).write.mode("append").parquet(store)

    return run
