"""What the corpus operators share: whole-text Arrow passes and folds."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polymera.storage import clean, forget, new_folder, shared_dir, written  # noqa: F401  used by the operators

#: Rows handled at a time inside an Arrow batch, and the bytes that end a slice early.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library than glibc
    _trim = None


def give_back() -> None:
    """Return this process's free memory to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def trimmed(run: Callable) -> Callable:
    """A task's pass over batches that ends by giving free memory back: workers live on, and would keep it from the next stages."""

    def inner(*args) -> Iterator:
        yield from run(*args)
        give_back()

    return inner


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids give null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def held_out(doc_id: Column, folds: int, fold_no: int = 2) -> Column:
    """True for ids of the held-out fold; a null id is never held out."""
    return F.coalesce(fold(doc_id, folds) == fold_no, F.lit(False))


def binary_values(column: pa.Array) -> list[bytes]:
    """The bytes of a string or binary Arrow column; nulls become empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, text_at: int, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A batch in runs of few rows and bytes (one row may exceed the bytes), each with its texts."""
    for start in range(0, batch.num_rows, rows):
        part = batch.slice(start, rows)
        texts = binary_values(part.column(text_at))
        begun = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > most:
                yield part.slice(begun, i - begun), texts[begun:i]
                begun, size = i, 0
            size += len(t)
        if begun < len(texts):
            yield part.slice(begun), texts[begun:]


def append_columns(df: DataFrame, text: str, make: Callable[[], Callable[[list[bytes]], Sequence[pa.Array]]], fields: Sequence[T.StructField], keep: Sequence[str] | None = None) -> DataFrame:
    """df's columns in keep (all if None) and new ones computed from whole texts, without a shuffle.

    make() runs once in a task and gives the function from a run of texts (null: empty) to one Arrow
    array per field. An input column named as a new one gives way to it, whatever its case. The text
    column may be string or binary; one that is kept travels once.
    """
    taken = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    at, n = kept.index(text) if text in kept else len(kept), len(kept)
    shape = df.select(*[F.col(f"`{c}`") for c in kept], *([] if at < n else [F.col(f"`{text}`").alias("__text")]))
    schema = T.StructType([shape.schema[i] for i in range(n)] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, names = make(), [f.name for f in schema.fields]
        for batch in batches:
            for part, texts in slices(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *work(texts)], names=names)

    return shape.mapInArrow(trimmed(run), schema)


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) runs of bytes other than space and 09-0D."""
    return text.lower().split()


#: The same in Spark SQL over a string column.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
