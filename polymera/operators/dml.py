"""Changes to tables as whole-table rewrites: each returns the new table, and changed rows where asked."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _matching(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & (a[k] == b[k])
    return on


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows appended by column name; absent columns are null."""
    return target.unionByName(rows, allowMissingColumns=True).select(target.columns)


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING: rows whose key is new, one for each key."""
    new = rows.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")
    return insert(target, new)


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows replace those of equal keys; of several new rows the last in `order` wins, ties by all columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in [*order, *[c for c in rows.columns if c not in keys and c not in order]]])
    last = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return insert(target.join(last.select(*keys), list(keys), "left_anti").select(target.columns), last)


def on_conflict_update(target: DataFrame, rows: DataFrame, keys: Sequence[str], updates: Mapping[str, Column]) -> DataFrame:
    """ON CONFLICT DO UPDATE: expressions over columns of the target and excluded.<column> of the new row."""
    t, e = target.alias("target"), rows.alias("excluded")
    j = t.join(e, F.expr(" AND ".join(f"target.`{k}` = excluded.`{k}`" for k in keys)), "full_outer")
    there, new = F.expr(f"target.`{keys[0]}` IS NOT NULL"), F.expr(f"excluded.`{keys[0]}` IS NOT NULL")
    out = []
    for c in target.columns:
        own = F.col(f"target.`{c}`")
        fresh = F.col(f"excluded.`{c}`") if c in rows.columns else F.lit(None)
        changed = updates[c] if c in updates else own
        out.append(F.when(there & new, changed).when(there, own).otherwise(fresh).alias(c))
    return j.select(*out)


def update(target: DataFrame, where: Column, sets: Mapping[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return target.select(*[F.when(hit, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in target.columns])


def update_from(target: DataFrame, source: DataFrame, target_key: str, source_key: str, sets: Mapping[str, Column]) -> DataFrame:
    """UPDATE ... FROM on one equal key: expressions over target.<column> and source.<column>."""
    j = target.alias("target").join(source.dropDuplicates([source_key]).alias("source"), F.expr(f"target.`{target_key}` = source.`{source_key}`"), "left")
    hit = F.expr(f"source.`{source_key}` IS NOT NULL")
    return j.select(*[(F.when(hit, sets[c]).otherwise(F.col(f"target.`{c}`")) if c in sets else F.col(f"target.`{c}`")).alias(c) for c in target.columns])


def delete(target: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return target.where(~F.coalesce(where, F.lit(False)))


def truncate(target: DataFrame) -> DataFrame:
    return target.limit(0)


@dataclass
class When:
    """One arm of MERGE: 'matched', 'not_matched' or 'not_matched_by_source'; an optional condition; an action.

    The action is 'update', 'delete', 'insert' or 'nothing'; values are for update and insert. Conditions
    and values are over target.<column> and source.<column>.
    """

    kind: str
    action: str
    values: Mapping[str, Column] | None = None
    condition: Column | None = None


def merge(target: DataFrame, source: DataFrame, target_key: str, source_key: str, arms: Sequence[When]) -> DataFrame:
    """MERGE: of each row's kind, the first arm whose condition holds acts. One full outer join.

    A target row that several source rows match is an error, as it is in SQL.
    """
    seen = source.groupBy(source_key).agg(F.count("*").alias("__times")).withColumnRenamed(source_key, "__sk")
    s = source.join(seen, source[source_key] == seen["__sk"], "left").drop("__sk").withColumn("__in_source", F.lit(True))
    t = target.withColumn("__in_target", F.lit(True))
    j = t.alias("target").join(s.alias("source"), F.expr(f"target.`{target_key}` = source.`{source_key}`"), "full_outer")
    in_t, in_s = F.col("target.__in_target").isNotNull(), F.col("source.__in_source").isNotNull()
    kinds = {"matched": in_t & in_s, "not_matched": ~in_t & in_s, "not_matched_by_source": in_t & ~in_s}
    chosen = F.lit(-1)
    for i in range(len(arms) - 1, -1, -1):
        test = kinds[arms[i].kind]
        if arms[i].condition is not None:
            test = test & F.coalesce(arms[i].condition, F.lit(False))
        chosen = F.when(test, i).otherwise(chosen)
    twice = kinds["matched"] & (F.col("source.__times") > 1) & (chosen >= 0)
    chosen = F.when(twice, F.raise_error(F.lit("21000: MERGE would change a row twice")).cast("int")).otherwise(chosen)
    j = j.withColumn("__arm", chosen)
    gone = [i for i, a in enumerate(arms) if a.action == "delete"]
    inserts = [i for i, a in enumerate(arms) if a.action == "insert"]
    keep = (in_t & ~F.col("__arm").isin(gone)) if gone else in_t
    keep = keep | (F.col("__arm").isin(inserts) if inserts else F.lit(False))
    out = []
    for c in target.columns:
        value = F.col(f"target.`{c}`")
        for i, a in enumerate(arms):
            if a.action == "update" and a.values and c in a.values:
                value = F.when(F.col("__arm") == i, a.values[c]).otherwise(value)
            elif a.action == "insert":
                value = F.when(F.col("__arm") == i, a.values[c] if a.values and c in a.values else F.lit(None)).otherwise(value)
        out.append(value.alias(c))
    return j.where(keep).select(*out)


def update_returning(target: DataFrame, where: Column, sets: Mapping[str, Column]) -> DataFrame:
    """RETURNING of update(): the rows it touches as they are after, changed or not, without a shuffle."""
    return target.where(F.coalesce(where, F.lit(False))).select(*[sets[c].alias(c) if c in sets else F.col(c) for c in target.columns])


def delete_returning(target: DataFrame, where: Column) -> DataFrame:
    """RETURNING of delete(): the rows that go, as they were."""
    return target.where(F.coalesce(where, F.lit(False)))


def insert_returning(target: DataFrame, rows: DataFrame) -> DataFrame:
    """RETURNING of insert(): the new rows with all columns of the target."""
    return insert(target.limit(0), rows)


def upsert_returning(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """RETURNING of upsert(): the one row that stays of each new key."""
    return upsert(target.limit(0), rows, keys, order)


def materialized_sum(target: DataFrame, key: str, rows: DataFrame, row_key: str, value: str, out: str) -> DataFrame:
    """The target with the sum of its rows' values, 0 where there are none."""
    sums = rows.groupBy(row_key).agg(F.sum(F.col(value).cast("double")).alias("__s")).withColumnRenamed(row_key, "__k")
    return target.join(sums, target[key] == sums["__k"], "left").withColumn(out, F.coalesce("__s", F.lit(0.0))).drop("__k", "__s")
