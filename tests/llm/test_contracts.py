"""What the operators promise for untaught models, ties, large groups and whole registered tables."""

import os

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from polymera.llm import media, near_dedup, queries, subword, toxicity, url_filter, vector_search


def test_untaught_toxicity_rejects_nothing(spark):
    docs = spark.createDataFrame([(1, "stupid idiot trash"), (2, "a fine day"), (3, None)], "doc_id long, text string")
    kinds = ([], [(1, 1), (2, 1)], [(1, 0), (2, 0)], [(1, None)])
    for labels in kinds:
        model = toxicity.learn_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        found = toxicity.score_toxicity(docs, model).collect()
        assert len(found) == 3 and all(abs(r["score"] - toxicity.UNTAUGHT) < 1e-12 and r["predicted"] == 0 for r in found)


def test_toxicity_with_repeated_ids_learns_from_a_bounded_number_of_rows(spark):
    docs = spark.createDataFrame([(i % 4, ("vile scum words here" if i % 4 < 2 else "some calm text here") + f" {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 2)) for i in range(4)], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(docs, labels, labelled_rows=50)
    got = {r["p"] for r in toxicity.score_toxicity(docs, model).select(F.struct((F.col("doc_id") < 2).cast("int").alias("t"), "predicted").alias("p")).collect()}
    assert got == {(1, 1), (0, 0)}


def test_earlier_rule_wins_a_tie(spark):
    pages = spark.createDataFrame([(1, "http://a.b.com/x")], "page_id long, url string")
    rules = [("block", "b.com", "/"), ("allow", "a.b.com", ""), ("block", "a.b.com", ""), ("allow", "b.com", "/")]
    got = url_filter.filter_urls(pages, rules=rules).first()
    assert (got["rule"], got["verdict"]) == ("a.b.com", "allow")
    assert url_filter.filter_urls(pages, rules=[rules[0], rules[3]]).first()["verdict"] == "block"
    assert url_filter.filter_urls(pages, rules=[rules[3], rules[0]]).first()["verdict"] == "allow"


def test_large_group_of_near_copies_is_one_class(spark):
    """3,000 copies that differ in one word, dealt over blocks, and a chain whose ends are unlike."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:60] + [f"x{i}"] + base[60:])) for i in range(3000)]
    chain = [f"c{i}" for i in range(400)]
    rows += [(10_000 + j, " ".join(chain[8 * j : 8 * j + 120])) for j in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert {got[i] for i in range(3000)} == {0}
    assert {got[10_000 + j] for j in range(30)} == {10_000}


@pytest.mark.parametrize("block_sets", [2, 3, 1000])
def test_blocks_lose_no_link(spark, block_sets, monkeypatch):
    rng = np.random.default_rng(7)
    rows, texts = [], []
    for i in range(60):
        words = list(texts[rng.integers(len(texts))]) if texts and rng.random() < 0.8 else [f"v{x}" for x in rng.integers(0, 500, 60)]
        words[int(rng.integers(len(words)))] = f"n{i}"
        texts.append(words)
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(near_dedup.true_links, "__defaults__", (near_dedup.BLOCK_BYTES, block_sets))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in texts]
    label = list(range(60))
    for a in range(60):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if 100 * k >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert got == dict(enumerate(label))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_the_index_on_registered_tables(spark, folder):
    """Default probing finds nine tenths; of the larger table with many lists, fitted on a quarter of its rows."""
    if not os.path.exists(folder):
        pytest.skip("needs the larger tables")
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = table.where("vec_id % 20 = 0 OR embedding IS NOT NULL").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    sizes = {"sample": len(rows) // 4, "list_size": 50} if len(rows) >= 1000 else {}
    out = vector_search.nearest_neighbours(table, F.col("vec_id") % 20 == 0, **sizes).collect()
    found: dict[int, set] = {}
    for r in out:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for q in ids[ids % 20 == 0]:
        s = (x * x[ids == q][0]).sum(1)
        want = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        recall.append(len(found[q] & set(want)) / 20)
    assert np.mean(recall) >= 0.9


def test_few_lists_are_probed_among_clusters():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(32, 16)) * 3
    x = centres[rng.integers(32, size=4000)] + rng.normal(size=(4000, 16)) * 0.3
    coarse = vector_search.k_means(x, 32)
    at, far = vector_search.nearest(x, coarse)
    n = np.maximum(np.bincount(at, minlength=len(coarse)), 1)
    index = vector_search.Index(coarse, np.sqrt(np.bincount(at, far, len(coarse)) / n), n / n.sum(), 4000, [], [], np.arange(4000), x, at)
    probed = index.probes(np.arange(0, 4000, 40), x[::40], 20, vector_search.EXPECTED)
    assert np.mean([len(p) for p in probed]) < 8


def test_rows_name_their_bytes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "abc")], "doc_id long, text string")
    index = media.store_media(docs, f"file://{tmp_path}")
    index.write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for r in media.read_media(media.media_headers(index)).collect():
        with open(r["shard"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            assert len(media.decode_png(f.read(r["media_bytes"]))) == r["payload_bytes"]


def test_encoding_is_the_library_s_and_decodes(spark):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["Hello  world, it is.", "", None, "née ▁ x\t日本", "a" * 3000]
    got = [r["pieces"] for r in subword.encode_pieces(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), path).collect()]
    library = SentencePieceProcessor(model_file=path)
    assert got == [None if t is None else library.encode(t) for t in texts]


def test_no_query_is_lost():
    assert len(queries.queries()) == 10
