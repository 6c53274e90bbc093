"""Mixing sources to target weights by temperature, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polymera.llm.common import WORD_PATTERN, written

#: Most often that a token may occur, the seed of the permutations, and documents of a source for each
#: bucket of the distributed prefix sum (a source's partial block is cut inside one bucket).
REPEAT_LIMIT, SEED, BUCKET_ROWS = 2.0, 11, 10_000
#: Plans of at most so many sources are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Exponents tried in one pass over the source totals when an entropy is sought, and passes.
GRID, PASSES = 16, 10


def token_count(text: str) -> Column:
    """Words of a whole text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def place_hash(seed: int, block: Column, key: Column) -> Column:
    """60 bits of md5 over seed, block and key: a document's place in a block's permutation."""
    said = F.concat_ws("|", F.lit(str(seed)), block.cast("string"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def exponent_for_repeats(least: float, most: float, limit: float) -> float:
    """The least exponent, to 9 decimals, at which the smallest source repeats at most `limit` times as often as the largest."""
    if not 0 < least < most:
        return 1.0 if limit <= 1 else 0.0
    low, high = 0.0, 1.0
    if (least / most) ** (low - 1) <= limit:
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (least / most) ** (mid - 1) <= limit else (mid, high)
    return round(high, 9)


def exponent_for_entropy(totals: DataFrame, entropy: float) -> float:
    """The largest exponent whose weights have at least this entropy (nats), by sections of [0, 1]; 0 if none has."""
    p = F.col("tokens") / F.lit(float(totals.agg(F.sum("tokens")).first()[0]))
    shares = totals.where("tokens > 0").select(p.alias("p"))
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        tried = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        sums = [f(F.pow("p", F.lit(t))) for t in tried for f in (F.sum, lambda w: F.sum(w * F.log("p")))]
        got = shares.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        at = [math.log(got[2 * i]) - t * got[2 * i + 1] / got[2 * i] for i, t in enumerate(tried)]
        enough = [t for t, h in zip(tried, at) if h >= entropy]
        if not enough:
            return 0.0
        if len(enough) == len(tried):
            return tried[-1]
        low, high = enough[-1], tried[len(enough)]
    return low


def source_plan(rows: DataFrame, repeat_limit: float = REPEAT_LIMIT, entropy: float | None = None) -> DataFrame:
    """(source, tokens, weight, repeats) from rows (source, n_tokens).

    Weights are token shares to an exponent, normalised. The exponent meets the entropy if one is given,
    else the repeat limit. The budget is the least that shows every document once, so repeats are at
    least 1 and the limit bounds the largest. A source without tokens has weight 0 and is shown once.
    """
    totals = written(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mix-totals")
    whole, least, most = totals.where("tokens > 0").agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not whole:
        return totals.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("repeats"))
    exponent = exponent_for_entropy(totals, entropy) if entropy is not None else exponent_for_repeats(least / whole, most / whole, repeat_limit)
    share = F.pow(F.col("tokens") / F.lit(float(whole)), F.lit(exponent))
    z = totals.where("tokens > 0").agg(F.sum(share)).first()[0]
    some = F.col("tokens") > 0
    repeats = F.when(some, F.round(F.pow(F.col("tokens") / F.lit(float(most)), F.lit(exponent - 1)), 9)).otherwise(1.0)
    return totals.select("source", "tokens", F.when(some, F.round(share / z, 9)).otherwise(0.0).alias("weight"), repeats.alias("repeats"))


def _cuts(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """The plan with each source's cut: the last (place, key, tokens) of its partial block's permutation that fits the budget.

    Tokens are summed by bucket of the place, buckets by source in order, and only the bucket in which
    the budget ends is summed by rows; a hot source is never gathered in one task.
    """
    partial = plan.withColumn("full", F.floor("repeats").cast("long")).withColumn("allowed", F.floor((F.col("repeats") - F.floor("repeats")) * F.col("tokens")).cast("long"))
    partial = written(partial, "mix-plan")
    largest = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 1
    width = (1 << 60) // max(1, math.ceil(largest / BUCKET_ROWS)) + 1
    blocks = _with_plan(rows, partial.where("allowed > 0"), "inner")
    placed = blocks.withColumn("place", place_hash(seed, F.col("full"), F.col("key"))).select("source", "key", "n_tokens", "place", "allowed", F.floor(F.col("place") / F.lit(width)).cast("long").alias("bucket"))
    placed = written(placed, "mix-places")
    sums = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"), F.first("allowed").alias("allowed"))
    sums = sums.withColumn("before", F.expr("sum(n) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")).na.fill(0, ["before"])
    edge = sums.where("before <= allowed AND before + n > allowed").select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before")
    inside = placed.join(edge, placed["source"].eqNullSafe(edge["s"]) & (placed["bucket"] == edge["b"]))
    inside = inside.withColumn("upto", F.expr("before + sum(n_tokens) OVER (PARTITION BY source, bucket ORDER BY place, key, n_tokens ROWS UNBOUNDED PRECEDING)"))
    last = inside.where("upto <= allowed").groupBy(F.col("source").alias("s")).agg(F.max(F.struct("place", "key", "n_tokens")).alias("cut"))
    # with nothing of the edge bucket in, all places before the bucket are; with no edge at all, every place is
    starts = edge.select("s", (F.col("b") * F.lit(width)).alias("start"))
    joined = partial.join(starts.withColumnRenamed("s", "s1"), partial["source"].eqNullSafe(F.col("s1")), "left").join(last.withColumnRenamed("s", "s2"), partial["source"].eqNullSafe(F.col("s2")), "left")
    return written(joined.select("source", "weight", "repeats", "full", "allowed", "start", "cut", F.col("s1").isNotNull().alias("named")).withColumn("start", F.when(F.col("allowed") > 0, F.coalesce("start", F.lit(1 << 62))).otherwise(F.lit(0))).drop("named"), "mix-cuts")


def _with_plan(rows: DataFrame, plan: DataFrame, how: str) -> DataFrame:
    """rows and their source's plan; the plan is broadcast if it has few sources (counted, not guessed)."""
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    right = plan.withColumnRenamed("source", "__plan_source")
    return rows.join(F.broadcast(right) if few else right, rows["source"].eqNullSafe(right["__plan_source"]), how).drop("__plan_source")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", repeat_limit: float = REPEAT_LIMIT, entropy: float | None = None, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """The mix as one row per shown document: docs' columns in keep, and n_tokens, weight, repeats, block and mix_key.

    A source's documents are shown in `floor(repeats)` whole blocks, each a permutation of its own, and a
    last block that ends where the budget does (documents whose running tokens exceed it are out). Rows
    in order of mix_key interleave the sources at their weights, each block after the one before.
    Null sources are a source; null and empty texts have no tokens and are shown as often as the whole
    blocks say, in the last block by their place; repeated rows are shown each; an empty table gives none. Input columns
    named like the new ones give way. Texts are not shuffled unless there are more than
    BROADCAST_SOURCES sources.
    """
    new = ["n_tokens", "weight", "repeats", "block", "mix_key"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    slim = written(docs.select(F.col(f"`{source}`").alias("source"), F.col(f"`{key}`").alias("key"), token_count(text).alias("n_tokens")), "mix-rows")
    cuts = _cuts(slim, source_plan(slim, repeat_limit, entropy), seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{source}`").alias("source"), F.col(f"`{key}`").alias("key"), token_count(text).alias("n_tokens"))
    rows = _with_plan(rows, cuts, "left").withColumn("place", place_hash(seed, F.col("full"), F.col("key")))
    within = (F.col("place") < F.col("start")) | F.coalesce(F.struct("place", "key", "n_tokens") <= F.col("cut"), F.lit(False))
    shown = F.col("full") + F.when((F.col("allowed") > 0) & within, 1).otherwise(0)
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), shown - 1)))
    mix_key = F.round((F.col("block") + place_hash(seed, F.col("block"), F.col("key")) / F.lit(float(1 << 60))) / F.col("repeats"), 9)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in kept], "n_tokens", "weight", "repeats", "block", mix_key.alias("mix_key"))
