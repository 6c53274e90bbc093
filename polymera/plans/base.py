"""How queries are registered: a name, a function of the tables, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder by attribute, and SQL over them."""

    NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        """SQL in which {name} stands for a table or a given DataFrame."""
        used = {n: getattr(self, n) for n in self.NAMES if f"{{{n}}}" in text}
        return self.spark.sql(text, **used, **more)


def query(name: str, sql: str | None = None):
    """Register a function of Tables as a query; sql is its equivalent for DuckDB."""

    def keep(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def both(name: str, sql: str):
    """Register a query whose SQL both engines run: {table} is a table."""
    query(name, sql.replace("{", "").replace("}", ""))(lambda t: t.sql(sql))
