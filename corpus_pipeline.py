"""The corpus pipeline: toxicity, language, near-duplicates, mixing, then sampled segmentations.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of documents. A stage's result is written as Parquet and read again by the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polymera.llm import language_id, mixing, near_dedup, subword, toxicity
from polymera.storage import written

#: Tokenizer file of the last stage.
PIECES = "piece_bpe_32k.model"
#: Least score of a told language: below, the others together are likelier. Of one language alone it is always 1.
LEAST_SCORE = 0.5
#: Numbers of dropped rows that are broadcast at most (16 bytes each, 8 MB).
GONE = 1 << 19


def _packed(docs: DataFrame) -> DataFrame:
    """Rows without their texts beside the texts, so that no column's name can clash with an operator's and each text travels once."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]).alias("row"), F.col("text"))


def _whole(packed: DataFrame, columns: list[str]) -> DataFrame:
    """The packed rows as they were."""
    return packed.select(*[F.col("text" if c.lower() == "text" else f"row.`{c}`").alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, by a model of the labels that cover them."""
    model = toxicity.learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _whole(toxicity.score_toxicity(_packed(docs), model, keep=["row", "text"]).where("predicted = 0"), docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without any letter go, and those of a score below LEAST_SCORE.

    Where no document has a lang there is nothing to tell languages by, and all texts with a letter stay.
    """
    profiles = language_id.learn_profiles(docs)
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = language_id.identify(_packed(docs), profiles, keep=["row", "text"])
    return _whole(told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least id, and one row of it.

    Rows are told apart by a number written beside them once, so that all plans read the same. The numbers of
    rows that go are broadcast if they are few (GONE at most); if not, the join shuffles the texts.
    """
    packed = _packed(docs).withColumn("place", F.monotonically_increasing_id())
    placed = written(packed.select("row", "text", F.struct(F.col("row.doc_id"), "place").alias("id")), "pipeline-placed")
    gone = near_dedup.near_duplicates(placed, key="id").where("NOT kept").select(F.col("id.place").alias("place"))
    gone = written(gone, "pipeline-gone")
    kept = placed.withColumn("place", F.col("id.place")).join(F.broadcast(gone) if gone.count() <= GONE else gone, "place", "left_anti")
    return _whole(kept, docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of small sources as often as the mix shows them."""
    return mixing.mix(docs).select(*docs.columns)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document shown."""
    return subword.sample_segmentations(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("segmentation", segment),
]

#: SQL cannot express the learned stages; tests hold each stage's decisions, chained, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
