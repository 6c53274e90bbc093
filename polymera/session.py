"""The engine's front: named collections, SQL over them with the engine's functions, and registered views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from polymera import sql_functions
from polymera.functions.datetimes import interval_ms

class Engine:
    """Collections by name over one Spark session.

    Its options make plans that hold at scale: adaptive execution with skew joins, partitions sized by
    bytes, UTC times.
    """

    OPTIONS = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.filterPushdown": "true",
    }

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        for k, v in self.OPTIONS.items():
            self.spark.conf.set(k, v)
        self.schemas: dict[str, dict[str, str]] = {}
        sql_functions.register(self.spark)

    def register(self, name: str, df: DataFrame) -> DataFrame:
        """Make a DataFrame a collection; the name replaces any before."""
        df.createOrReplaceTempView(name)
        self.schemas[name] = dict(df.dtypes)
        return df

    def collection(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def drop(self, name: str) -> None:
        self.spark.catalog.dropTempView(name)
        self.schemas.pop(name, None)

    def sql(self, text: str, **parameters) -> DataFrame:
        """Run SQL; :name parameters are bound, never spliced."""
        return self.spark.sql(text, parameters or None)

    def function(self, name: str, f: Callable, returns: str) -> None:
        """Register a Python function of Arrow-batched pandas series for SQL."""
        from pyspark.sql import functions as F

        self.spark.udf.register(name, F.pandas_udf(f, returns))

    @staticmethod
    def duration(text: str) -> int:
        return interval_ms(text)


class Sequences:
    """nextval, currval and setval, kept by the driver."""

    def __init__(self):
        self.values: dict[str, int] = {}

    def nextval(self, name: str, count: int = 1) -> range:
        """The next `count` numbers."""
        first = self.values.get(name, 0) + 1
        self.values[name] = first + count - 1
        return range(first, first + count)

    def currval(self, name: str) -> int:
        if name not in self.values:
            raise ValueError(f"55000: {name} has not been used in this session")
        return self.values[name]

    def setval(self, name: str, value: int) -> int:
        self.values[name] = value
        return value

    def number(self, df: DataFrame, name: str, column: str = "id", order: list[str] | None = None) -> DataFrame:
        """Rows with consecutive numbers of a sequence, in an order if one is given; partitions are counted, then numbered apart."""
        from pyspark.sql import Window
        from pyspark.sql import functions as F

        from polymera.storage import written

        placed = written((df.orderBy(*order) if order else df).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()), "numbered")
        sizes = {r["__p"]: r["count"] for r in placed.groupBy("__p").count().collect()}
        first = self.nextval(name, sum(sizes.values())).start
        starts = {}
        for p in sorted(sizes):
            starts[p] = first
            first += sizes[p]
        base = placed.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "__p int, __start long")
        within = F.row_number().over(Window.partitionBy("__p").orderBy("__m"))
        return placed.withColumn("__n", within).join(F.broadcast(base), "__p").withColumn(column, F.col("__start") + F.col("__n") - 1).drop("__p", "__m", "__n", "__start")
