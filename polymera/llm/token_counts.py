"""Token counts by a map-side two-tier lookup of pre-token lengths."""

from __future__ import annotations

import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polymera.llm.common import append_columns

#: Rows sampled for the first tier (about so many), its entries and their greatest length in bytes, and the entries
#: of a worker's own cache. They change the speed only, never a count.
SAMPLE_ROWS, FREQUENT, FREQUENT_BYTES, CACHE = 2_000, 65_536, 64, 400_000

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer of a file, loaded once a process, with one thread."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _loaded[path] = made
    return _loaded[path]


def encoded_lengths(path: str, chunks: list[bytes]) -> list[int]:
    """Tokens of each chunk by the library, without begin, end or added special tokens."""
    found = tokenizer(path).encode_batch_fast([c.decode("utf-8", "replace") for c in chunks], add_special_tokens=False)
    return [len(e) for e in found]


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", sample_rows: int = SAMPLE_ROWS, entries: int = FREQUENT) -> dict[bytes, int]:
    """Lengths of the most frequent chunks of a sample of about sample_rows rows, chosen by hash.

    Of at most `entries` chunks of at most FREQUENT_BYTES bytes: a few MB, whatever the corpus.
    """
    chunk = F.explode(F.split(F.col(f"`{text}`").cast("string"), "[ \\t-\\r]+")).alias("chunk")
    every = max(1, docs.count() // sample_rows)
    sample = docs.where(F.pmod(F.xxhash64(f"`{text}`"), F.lit(every)) == 0).select(chunk).where((F.octet_length("chunk") > 0) & (F.octet_length("chunk") <= FREQUENT_BYTES))
    top = sample.groupBy("chunk").count().orderBy(F.desc("count"), "chunk").limit(entries).collect()
    chunks = [r["chunk"].encode() for r in top]
    return dict(zip(chunks, encoded_lengths(path, chunks)))


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 2048, keep: list[str] | None = None, frequent: dict[bytes, int] | None = None) -> DataFrame:
    """Append n_bytes, n_tokens and over_limit (n_tokens > limit), exactly as the library counts.

    For tokenizers whose pre-tokens never span ASCII white space and that drop it: a text is cut there,
    and each chunk's length comes from the broadcast table of frequent chunks, else from the worker's
    cache, else from the library. No pre-token is shuffled. Special strings count as the library's
    default has it. Null and empty texts count 0 tokens; repeated rows are counted each; input columns
    named like the new ones give way.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text) if frequent is None else frequent)

    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        first, own = table.value, {}

        def work(texts: list[bytes]) -> list[pa.Array]:
            split = [t.split() for t in texts]
            missing = {c for chunks in split for c in chunks if c not in first and c not in own}
            if missing:
                if len(own) + len(missing) > CACHE:
                    own.clear()
                    missing = {c for chunks in split for c in chunks if c not in first}
                ordered = list(missing)
                own.update(zip(ordered, encoded_lengths(path, ordered)))
            counts = [sum([first[c] if c in first else own[c] for c in chunks]) for chunks in split]
            return [pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]

        return work

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return append_columns(docs, text, make, fields, keep)
