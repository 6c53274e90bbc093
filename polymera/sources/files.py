"""COPY FROM and COPY TO: line JSON, JSON arrays, CSV and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Formats by file extension.
EXTENSIONS = {
    "ndjson": "ndjson",
    "jsonl": "ndjson",
    "json": "json",
    "csv": "csv",
    "tsv": "csv",
    "parquet": "parquet",
}


def format_of(path: str) -> str:
    """A path's format by its extension."""
    extension = path.rstrip("/").rpartition(".")[2].lower()
    if extension not in EXTENSIONS:
        raise ValueError(f"no format is known for {path!r}")
    return EXTENSIONS[extension]


def copy_from(spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str | None = None, delimiter: str | None = None, header: bool = True) -> DataFrame:
    """A file or folder as a DataFrame; a stated schema spares a pass over the data. Rows that do not fit it are errors."""
    fmt = fmt or format_of(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        separator = delimiter or ("\t" if path.endswith(".tsv") else ",")
        return reader.csv(path, sep=separator, header=header, inferSchema=schema is None, mode="FAILFAST")
    if fmt == "parquet":
        return reader.parquet(path)
    return reader.json(path, multiLine=fmt == "json", mode="FAILFAST")


def copy_to(df: DataFrame, path: str, fmt: str | None = None, delimiter: str = ",", header: bool = True, mode: str = "error") -> None:
    """Write a DataFrame in a format; JSON is written by lines, which readers of either JSON form take."""
    fmt = fmt or format_of(path)
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.csv(path, sep=delimiter, header=header)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        writer.json(path)


def archive(df: DataFrame, path: str, partition_by: list[str], mode: str = "append") -> None:
    """Sealed partitions as Parquet, each partition's rows in few files."""
    df.repartition(*partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)


def scan(spark: SparkSession, path: str, where=None, columns: list[str] | None = None) -> DataFrame:
    """A Parquet scan to which the filter and the columns are pushed."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)
