"""Query functions by name: lookups in time, balances, hash chains, trees, versions and batch views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polymera.operators import graph
from polymera.operators.search import ranked, rrf


def temporal_lookup(table: DataFrame, key_column: str, time_column: str, key, as_of) -> DataFrame:
    """The row of a key with the latest time not after as_of."""
    return table.where((F.col(key_column) == key) & (F.col(time_column) <= as_of)).orderBy(F.col(time_column).desc()).limit(1)


def convert_currency(amounts: DataFrame, rates: DataFrame, amount: str, currency: str, at: str, key_column: str, rate_column: str, time_column: str, precision: int = 2, out: str = "converted") -> DataFrame:
    """Amounts times the rate of their currency in force at their time, rounded half up; null without a rate."""
    from polymera.operators.joins import asof_join

    r = rates.select(F.col(key_column).alias(currency), F.col(time_column).alias("__at"), F.col(rate_column).alias("rate"))
    found = asof_join(amounts, r, at, "__at", [currency], prefix="__")
    return found.withColumn(out, F.round(F.col(amount) * F.col("__rate"), precision)).drop("__rate", "____at")


def balance_as_of(balances: DataFrame, entries: DataFrame, key: str, entry_key: str, balance: str, amount: str, time_column: str, as_of) -> DataFrame:
    """(key, balance): the current balance less the entries after as_of."""
    later = entries.where(F.col(time_column) > as_of).groupBy(F.col(entry_key).alias("__k")).agg(F.sum(F.col(amount).cast("double")).alias("__later"))
    return balances.join(later, balances[key] == F.col("__k"), "left").select(F.col(key), (F.col(balance) - F.coalesce("__later", F.lit(0.0))).alias(balance))


def verify_balance(balances: DataFrame, entries: DataFrame, key: str, entry_key: str, balance: str, amount: str, tolerance: float = 1e-9) -> DataFrame:
    """(key, stored, computed) of the balances that differ from the sum of their entries, missing ones included."""
    sums = entries.groupBy(F.col(entry_key).alias("__k")).agg(F.sum(F.col(amount).cast("double")).alias("computed"))
    j = balances.select(key, F.col(balance).cast("double").alias("stored")).join(sums, F.col(key) == F.col("__k"), "full_outer")
    differs = F.abs(F.coalesce("stored", F.lit(0.0)) - F.coalesce("computed", F.lit(0.0))) > tolerance
    return j.where(differs).select(F.coalesce(key, "__k").alias(key), "stored", "computed")


def hash_chain(rows: DataFrame, seq: str, payload: str, first: str = "") -> DataFrame:
    """Rows with `hash`: SHA-256 of the hash before and the payload. A chain is a recurrence, so it is one task's."""
    import hashlib

    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq)
        last, out = first, []
        for p in pdf[payload]:
            last = hashlib.sha256((last + (p or "")).encode()).hexdigest()
            out.append(last)
        return pdf.drop(columns="__chain").assign(hash=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", hash string"
    return rows.withColumn("__chain", F.lit(1)).groupBy("__chain").applyInPandas(run, schema)


def verify_hash_chain(rows: DataFrame, seq: str, payload: str, hash_column: str = "hash", first: str = "", partitions: str | None = None) -> DataFrame:
    """One row (valid, entries, broken_at, last_hash): every link is checked by itself from the stored hash before it.

    The row before comes from a join on consecutive numbers, so nothing is sorted in one task.
    """
    own = rows.select(F.col(seq).alias("s"), F.coalesce(F.col(payload), F.lit("")).alias("p"), F.col(hash_column).alias("h"))
    least = own.agg(F.min("s").alias("least"))
    before = own.select((F.col("s") + 1).alias("s"), F.col("h").alias("before"))
    linked = own.join(before, "s", "left").crossJoin(F.broadcast(least))  # one row
    given = F.when(F.col("s") == F.col("least"), F.lit(first)).otherwise(F.col("before"))
    broken = F.coalesce(F.sha2(F.concat(given, F.col("p")), 256) != F.col("h"), F.lit(True))
    return linked.agg(F.coalesce(~F.bool_or(broken), F.lit(True)).alias("valid"), F.count("*").alias("entries"), F.min(F.when(broken, F.col("s"))).alias("broken_at"), F.max_by("h", "s").alias("last_hash"))


def tree_children(edges: DataFrame, root, max_depth: int = 100) -> DataFrame:
    """(id, depth) of all descendants of a node of a tree of (src, dst)."""
    start = edges.where(F.col("src") == root).select(F.col("src").alias("id")).limit(1)
    return graph.bfs(edges, start, max_depth).where("depth > 0")


def tree_sum(edges: DataFrame, nodes: DataFrame, root, column: str, id_column: str = "id", max_depth: int = 100) -> DataFrame:
    """One row (total): a column's sum over a node and its descendants."""
    ids = tree_children(edges, root, max_depth).select("id").unionAll(nodes.where(F.col(id_column) == root).select(F.col(id_column).alias("id"))).distinct()
    return nodes.join(ids, nodes[id_column] == ids["id"], "left_semi").agg(F.sum(F.col(column).cast("double")).alias("total"))


def estimate_count(table: DataFrame, field: str) -> DataFrame:
    """About how many different values a field has."""
    return table.agg(F.approx_count_distinct(field, 0.008).alias("estimate"))


def show_changes(log: DataFrame, time_column: str, since=None, limit: int | None = None) -> DataFrame:
    """Recorded changes after a time, the oldest first."""
    rows = log if since is None else log.where(F.col(time_column) > since)
    rows = rows.orderBy(time_column)
    return rows if limit is None else rows.limit(limit)


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change, column, old, new): rows added and removed, and every changed value of the rest."""
    columns = [c for c in before.columns if c not in keys]
    a = before.select(*keys, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("__a"))
    b = after.select(*keys, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("__b"))
    j = a.join(b, keys, "full_outer")
    one = lambda c: F.struct(F.lit("changed").alias("change"), F.lit(c).alias("column"), F.col(f"__a.{c}").alias("old"), F.col(f"__b.{c}").alias("new"))
    whole = lambda kind: F.array(F.struct(F.lit(kind).alias("change"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    changed = F.filter(F.array(*map(one, columns)), lambda x: ~x["old"].eqNullSafe(x["new"]))
    return j.select(*keys, F.inline(F.when(F.col("__a").isNull(), whole("added")).when(F.col("__b").isNull(), whole("removed")).otherwise(changed)))


class MaterializedViews:
    """Batch views: a definition each, written as Parquet when refreshed."""

    def __init__(self, folder: str):
        self.folder, self.definitions = folder, {}

    def create(self, name: str, definition) -> None:
        """definition() gives the DataFrame; it runs at each refresh."""
        self.definitions[name] = definition

    def refresh(self, name: str) -> None:
        self.definitions[name]().write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def read(self, spark, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")

    def show(self) -> list[str]:
        return sorted(self.definitions)

    def drop(self, name: str) -> None:
        self.definitions.pop(name)


def graph_rag(seeds: DataFrame, edges: DataFrame, k: int, max_depth: int = 2, text_scores: DataFrame | None = None, rank_k: float = 60, direction: str = "out", list_size: int | None = None) -> DataFrame:
    """(id, score, rank): nearest rows (id, distance) as seeds, their neighbourhood by hops, and text scores if given, fused by rank.

    Whole lists are fused unless list_size keeps the first of each.
    """
    lists = [ranked(seeds, k, "distance", True)]
    near = graph.bfs(edges, lists[0].select("id"), max_depth, direction)
    lists.append(ranked(near.select("id", F.col("depth").alias("distance")), list_size, "distance", True))
    if text_scores is not None:
        lists.append(ranked(text_scores, list_size))
    return rrf(lists, rank_k).orderBy("rank").limit(k)
