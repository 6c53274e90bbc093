"""The pipeline's stages on a small corpus, against plain versions of what they decide."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from polymera.llm import common, near_dedup, queries, subword  # noqa: E402
from tests.compare import rows_of, rows_of_sql  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near-duplicates", "mixing", "segmentation"]


def test_run(spark, sf_dir):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    safe = STAGES["toxicity"](spark, docs, sf_dir)
    assert safe.columns == columns
    known = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    left = {r["doc_id"] for r in safe.collect()}
    clean = [i for i, t in known.items() if t == 0]
    assert sum(i in left for i in clean) >= 0.97 * len(clean)
    odd = spark.createDataFrame([(10**6, "12 34 --", None, "s", 8), (10**6 + 1, None, None, None, 0)], docs.schema)
    told = STAGES["language"](spark, docs.unionByName(odd), sf_dir)
    assert told.columns == columns and {r["doc_id"] for r in told.collect()} == {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    once = STAGES["near-duplicates"](spark, docs, sf_dir)
    kept = {r["doc_id"] for r in once.collect()}
    assert once.columns == columns and kept == {r["doc_id"] for r in near_dedup.near_duplicates(docs).where("kept").collect()}
    mixed = STAGES["mixing"](spark, docs, sf_dir)
    assert mixed.columns == columns and {r["doc_id"] for r in mixed.collect()} == set(texts)
    model = subword.load_pieces(__import__("public_tokenizers").path(corpus_pipeline.PIECES))
    for r in STAGES["segmentation"](spark, docs, sf_dir).limit(50).collect():
        assert model.decode(r["pieces"]) == texts[r["doc_id"]]


def test_one_of_repeated_rows_stays(spark, sf_dir, tmp_path):
    docs = spark.createDataFrame([(2, "a b c d e f g", "en", "s", 1), (2, "a b c d e f g", "en", "s", 1), (1, "A b c d e f g", "en", "s", 1), (None, None, None, None, None), (3, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "d"))
    got = STAGES["near-duplicates"](spark, spark.read.parquet(str(tmp_path / "d")), sf_dir).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "3", "None"]


def test_texts_travel_once_and_need_no_shuffle(spark, sf_dir, monkeypatch):
    """pipeline: a stage sends each text to Python once, and near-duplicates go without a shuffle of texts while they are few; rows are the same if they are not."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan_of = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for stage in ("toxicity", "language"):
        passed = [line for line in plan_of(STAGES[stage](spark, docs, sf_dir)).splitlines() if "MapInArrow" in line]
        assert len(passed) == 1
    packed = corpus_pipeline._packed(docs)
    assert packed.columns == ["row", "text"] and "text" not in packed.schema["row"].dataType.names
    sent = common.append_columns(packed, "text", lambda: lambda texts: [[len(t) for t in texts]], [T.StructField("n", T.LongType())])
    assert sent.columns == ["row", "text", "n"] and "__text" not in plan_of(sent)
    assert sorted((r["text"] or "", r["n"]) for r in sent.collect()) == sorted((r["text"] or "", len((r["text"] or "").encode())) for r in docs.collect())
    few = STAGES["near-duplicates"](spark, docs, sf_dir)
    assert "broadcast" in plan_of(few) and few.columns == docs.columns
    monkeypatch.setattr(corpus_pipeline, "GONE", 0)
    many = STAGES["near-duplicates"](spark, docs, sf_dir)
    assert "broadcast" not in plan_of(many)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.count() < docs.count()


def test_passes_give_memory_back(monkeypatch):
    """pipeline: a pass ends by giving memory back, and yields the same."""
    called = []
    monkeypatch.setattr(common, "give_back", lambda: called.append(1))
    assert list(common.trimmed(lambda a, b: (x + a for x in b))(1, [2, 3])) == [3, 4] and called == [1]
    monkeypatch.undo()
    common.give_back()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(name, spark, sf_dir, duck):
    names, rows = rows_of(queries.queries()[name](spark, sf_dir))
    want_names, want = rows_of_sql(duck, queries.oracle_sql()[name])
    assert names == want_names and rows == want


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the larger tables")
def test_held_out_quality(spark):
    """Held-out toxicity and language on the larger tables."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    told = queries.op8_language_id(spark, folder).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert told.where("lang = lang_pred").count() >= 0.97 * told.count()
    toxic = queries.op4_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    right = {r["toxic"]: r["p"] for r in toxic.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert right[0] <= 0.03 and right[1] >= 0.5


def test_language_rejects_by_score_and_keeps_all_when_nothing_was_learned(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, "日本語 テキスト です", None, "s", 11), (10**6 + 1, "a1b2 c3d4 e5f6", None, "s", 14), (10**6 + 2, "12 --", None, "s", 5)], docs.schema)
    left = STAGES["language"](spark, docs.unionByName(odd), sf_dir)
    assert left.where(f"doc_id >= {10**6}").count() == 0 and left.count() >= 0.98 * docs.count()
    none = docs.unionByName(odd).withColumn("lang", F.lit(None).cast("string"))
    kept = {r["doc_id"] for r in STAGES["language"](spark, none, sf_dir).collect()}
    assert kept == {r["doc_id"] for r in none.collect() if any(c.isalpha() for c in r["text"] or "")}
