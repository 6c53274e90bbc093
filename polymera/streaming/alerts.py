"""Alert rules with hysteresis: fire after so many breaches in a row, recover after so many without."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tests of a value against a threshold.
TESTS = {
    ">": lambda v, x: v > x,
    ">=": lambda v, x: v >= x,
    "<": lambda v, x: v < x,
    "<=": lambda v, x: v <= x,
}


def breaches(windows: DataFrame, value: str, test: str, threshold: float) -> DataFrame:
    """Window aggregates with `breach`, their test's result; nulls do not breach."""
    return windows.withColumn("breach", F.coalesce(TESTS[test](F.col(value), threshold), F.lit(False)))


def alert_events(windows: DataFrame, group_by: Sequence[str], bucket: str, fire_after: int = 1, recover_after: int = 1) -> DataFrame:
    """(group, bucket, event) where an alert fires or recovers, from rows with `breach` in order of bucket.

    Runs of equal tests are numbered by windows; a run long enough changes the state at the row that
    makes it so, unless the state is that already.
    """
    w = Window.partitionBy(*group_by).orderBy(bucket)
    runs = windows.withColumn("__new", F.coalesce((F.col("breach") != F.lag("breach").over(w)).cast("int"), F.lit(1))).withColumn("__run", F.sum("__new").over(w))
    n = F.row_number().over(Window.partitionBy(*group_by, "__run").orderBy(bucket))
    marks = runs.withColumn("__n", n).where((F.col("breach") & (F.col("__n") == fire_after)) | (~F.col("breach") & (F.col("__n") == recover_after)))
    before = F.lag("breach").over(w)
    changed = marks.withColumn("__before", before).where(F.col("breach") != F.coalesce("__before", F.lit(False)))
    return changed.select(*group_by, bucket, F.when(F.col("breach"), "fire").otherwise("recover").alias("event"))


def stream_alerts(windows: DataFrame, group: str, bucket: str, fire_after: int = 1, recover_after: int = 1) -> DataFrame:
    """alert_events over a stream of closed windows with `breach`, by state kept for each group."""

    def run(key, batches, state):
        firing, streak, last = state.get if state.exists else (False, 0, False)
        out = []
        rows = pd.concat(list(batches)).sort_values(bucket)
        for at, breach in zip(rows[bucket], rows["breach"]):
            streak = streak + 1 if breach == last else 1
            last = bool(breach)
            if breach and not firing and streak >= fire_after:
                firing = True
                out.append((key[0], at, "fire"))
            elif not breach and firing and streak >= recover_after:
                firing = False
                out.append((key[0], at, "recover"))
        state.update((firing, streak, last))
        yield pd.DataFrame(out, columns=[group, bucket, "event"])

    kinds = {f.name: f.dataType.simpleString() for f in windows.schema}
    return windows.groupBy(group).applyInPandasWithState(run, f"{group} {kinds[group]}, {bucket} {kinds[bucket]}, event string", "firing boolean, streak long, last boolean", "append", "NoTimeout")
