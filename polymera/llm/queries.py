"""The registered queries of the corpus operators, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polymera.llm import language_id, lm_score, media, mixing, near_dedup, subword, token_counts, toxicity, url_filter, vector_search
from polymera.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id", "source"])


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(_table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id"), 7))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 4))
    labels = _table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 4))
    model = toxicity.learn_toxicity(docs, labels)
    return toxicity.score_toxicity(docs, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), keep=["page_id"])


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer_path("word_bpe_49k.json"), keep=["doc_id"])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 4))
    profiles = language_id.learn_profiles(docs.where(~F.col("held_out")))
    return language_id.identify(docs, profiles, keep=["doc_id", "held_out"])


def op9_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.sample_segmentations(_table(spark, sf_dir, "documents"), _tokenizer_path("piece_bpe_32k.model"))


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media_columns": op1_media_columns,
        "op2_mixing": op2_mixing,
        "op3_lm_score": op3_lm_score,
        "op4_toxicity": op4_toxicity,
        "op5_near_dedup": op5_near_dedup,
        "op6_url_filter": op6_url_filter,
        "op7_token_counts": op7_token_counts,
        "op8_language_id": op8_language_id,
        "op9_sampled_segmentations": op9_sampled_segmentations,
        "op10_vector_search": op10_vector_search,
    }


def _boundary(terms: tuple[str, ...]) -> str:
    one = "CAST(regexp_matches(u, '(^|[^a-z0-9]){}([^a-z0-9]|$)') AS INTEGER)"
    return " + ".join(one.format(t) for t in terms)


_A = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP6_SQL = f"""
WITH a AS (SELECT page_id, translate(coalesce(url, ''), '{_A}', '{_A.lower()}') AS u,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, u, translate(h, '{_A}', '{_A.lower()}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
  CAST({_boundary(url_filter.STRICT)} AS INTEGER) AS strict_hits,
  CAST({_boundary(url_filter.SOFT)} AS INTEGER) AS soft_hits FROM c)
SELECT page_id, host, path, rule, strict_hits, soft_hits, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN strict_hits >= 1 OR soft_hits >= {url_filter.SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict FROM d"""


def _place(block: str) -> str:
    return f"CAST('0x' || substr(md5('{mixing.SEED}|' || CAST({block} AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)"


OP2_SQL = rf"""
WITH a AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
t AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM a GROUP BY source),
u AS (SELECT sum(tokens)::DOUBLE AS whole, min(tokens)::DOUBLE AS least, max(tokens)::DOUBLE AS most FROM t WHERE tokens > 0),
x AS (SELECT *, CASE WHEN least = most OR least / most >= 1 / {mixing.REPEAT_LIMIT} THEN 0.0
  ELSE round(1 - ln({mixing.REPEAT_LIMIT}) / ln(most / least), 9) END AS exponent FROM u),
z AS (SELECT sum(pow(tokens / whole, exponent)) AS z FROM t, x WHERE tokens > 0),
p AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN round(pow(tokens / whole, exponent) / z, 9) ELSE 0.0 END AS weight,
  CASE WHEN tokens > 0 THEN round(pow(tokens / most, exponent - 1), 9) ELSE 1.0 END AS repeats FROM t, x, z),
q AS (SELECT *, floor(repeats)::BIGINT AS full_, floor((repeats - floor(repeats)) * tokens)::BIGINT AS allowed FROM p),
r AS (SELECT a.doc_id, a.source, n_tokens, weight, repeats, full_, allowed,
  sum(n_tokens) OVER (PARTITION BY a.source ORDER BY {_place("full_")}, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM a JOIN q ON a.source IS NOT DISTINCT FROM q.source),
s AS (SELECT *, unnest(range(full_ + CASE WHEN allowed > 0 AND upto <= allowed THEN 1 ELSE 0 END)) AS block FROM r)
SELECT doc_id, source, n_tokens, weight, repeats, block, round((block + {_place("block")} / 1152921504606846976.0) / repeats, 9) AS mix_key FROM s"""

OP5_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_A}', '{_A.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n, hash(list_sort(s)) AS h FROM s),
c AS (SELECT h, min(n) AS n, min(doc_id) AS c FROM n WHERE n > 0 GROUP BY h),
x AS (SELECT doc_id AS c, unnest(s) AS g FROM s WHERE doc_id IN (SELECT c FROM c)),
both_ AS (SELECT a.c AS a, b.c AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.c < b.c GROUP BY 1, 2),
e AS (SELECT a, b FROM both_ JOIN c ca ON ca.c = a JOIN c cb ON cb.c = b WHERE 100 * k >= 75 * (ca.n + cb.n - k)),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT c AS a, c AS b FROM c UNION SELECT r.a, d.b FROM r JOIN d ON d.a = r.b),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.m, n.doc_id) AS component_id, n.doc_id = coalesce(m.m, n.doc_id) AS kept
FROM n LEFT JOIN c ON c.h = n.h AND n.n > 0 LEFT JOIN m ON m.a = c.c"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op5_near_dedup": OP5_SQL, "op6_url_filter": OP6_SQL}
