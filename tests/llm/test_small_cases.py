"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polymera.llm import language_id, lm_bits, lm_score, media, mixing, near_dedup, subword, token_counts, toxicity, url_filter, vector_search

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")

LONG = " ".join(f"word{i % 997}" for i in range(40_000))
TEXTS = [None, "", "   \n", "one", "The cat sat on the mat and ran away", "The cat sat on the mat and ran away", "über naïve — 日本語 \U0001f600 <|endoftext|>", "x" * 5000, LONG]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, a null id and a repeated row, beside columns whose names operators give to their own."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 2}" if i else None, 1.5, "mine") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id here at all today", "en", "s1", 1.5, "mine"), rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, N_TOKENS string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_media(docs, empty, tmp_path):
    rows = media.media_columns(docs).collect()
    assert len(rows) == len(TEXTS) + 2 and media.media_columns(empty).count() == 0
    for r in rows:
        if r["doc_id"] is None:
            continue
        text = (TEXTS[r["doc_id"]] or "").encode()
        data = media.payload(text)
        assert len(data) % media.UNIT == 0 and len(data) >= media.UNIT
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert (r["width"], r["height"]) == (media.UNIT, len(data) // media.UNIT)
    same = {r["feature"] for r in rows if r["doc_id"] in (4, 5)}
    assert len(same) == 1
    folder = f"file://{tmp_path}/shards"
    index = media.store_media(docs.coalesce(1), folder).collect()
    shard = next((tmp_path / "shards").iterdir())
    members = media.tar_members(shard.read_bytes())
    assert len(members) == len({bytes(r["payload_digest"]) for r in index})
    assert all(hashlib.sha256(media.decode_png(v)).hexdigest() == k.removesuffix(".png") for k, v in members.items())


def test_damaged_media():
    stored = bytearray(media.encode_png(media.payload(b"abc")))
    stored[50] ^= 1
    with pytest.raises(Exception):
        media.decode_png(bytes(stored))


def test_mixing(docs, empty):
    out = mixing.mix(docs, keep=["doc_id", "source", "N_TOKENS"])
    assert out.columns == ["doc_id", "source", "n_tokens", "weight", "repeats", "block", "mix_key"]
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == {*range(len(TEXTS)), None}  # every document is shown
    assert max(r["repeats"] for r in rows) <= mixing.REPEAT_LIMIT + 1e-6 and min(r["repeats"] for r in rows) == 1
    assert abs(sum({r["source"]: r["weight"] for r in rows}.values()) - 1) < 1e-6
    assert mixing.mix(empty).count() == 0


def test_mixing_budget_and_entropy(spark):
    sizes = {"a": 400, "b": 60, "c": 30}
    rows = [(f"{s}{i}", s, "w " * (1 + i % 7)) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id string, source string, text string")
    out = mixing.mix(df, repeat_limit=3.0).collect()
    total = {s: sum(1 + i % 7 for i in range(n)) for s, n in sizes.items()}
    for s in sizes:
        mine = [r for r in out if r["source"] == s]
        allowed = mine[0]["repeats"] * total[s]
        shown = sum(r["n_tokens"] for r in mine)
        assert allowed - 7 <= shown <= allowed
        for block in {r["block"] for r in mine}:
            ids = [r["doc_id"] for r in mine if r["block"] == block]
            assert len(ids) == len(set(ids))
    totals = spark.createDataFrame([(s, t) for s, t in total.items()], "source string, tokens long")
    t = mixing.exponent_for_entropy(totals, 1.0)
    p = np.array(list(total.values())) / sum(total.values())
    w = p**t / (p**t).sum()
    assert abs(-(w * np.log(w)).sum() - 1.0) < 1e-6


def test_near_duplicates(spark, docs, empty):
    got = by_id(near_dedup.near_duplicates(docs))
    assert got[0]["n_shingles"] == 0 and got[0]["kept"] and got[2]["component_id"] == 2
    assert got[3]["n_shingles"] == 1 and got[5]["component_id"] == 4 and not got[5]["kept"] and got[4]["kept"]
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_brute_force(spark):
    """Chains of edits, blocks split small: components are those of all true links."""
    rng = np.random.default_rng(1)
    vocabulary = [f"v{i}" for i in range(500)]
    texts = []
    for _ in range(12):
        words = list(rng.choice(vocabulary, 120))
        for _ in range(15):
            if rng.random() < 0.5:
                words[rng.integers(len(words))] = "edit"
            texts.append(" ".join(words))
    ids = rng.permutation(len(texts)) * 3
    df = spark.createDataFrame([(int(i), t) for i, t in zip(ids, texts)], "doc_id long, text string").repartition(4)
    sets = [set(near_dedup.shingles(t.encode()).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        least[find(i)] = min(least.get(find(i), 1 << 60), int(ids[i]))
    want = {int(ids[i]): least[find(i)] for i in range(len(texts))}
    found = {}
    for size in (near_dedup.BLOCK_BYTES, 6_000):
        near_dedup.true_links.__defaults__ = (size, near_dedup.BLOCK_SETS)
        try:
            found[size] = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()}
        finally:
            near_dedup.true_links.__defaults__ = (near_dedup.BLOCK_BYTES, near_dedup.BLOCK_SETS)
    assert all(f == want for f in found.values())


def test_url_filter(spark):
    urls = [None, "", "no scheme/spam", "http://COM/x", "http://a.com", "http://www.example.com/en/x?q", "http://example.com/en/", "http://m.example.com/EN/", "http://x.net/fr/#a", "http://x.org/cheap-bonus", "http://x.org/cheap", "http://x.org/spam", "http://x.org/spammer", "http://notexample.com/en/", "http://h/p\nq?z"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)] + [(3, urls[3], "mine")], "page_id long, url string, Verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("", "", None, "block")
    assert got[3] == ("com", "/x", "com/", "allow") and got[4] == ("a.com", "", None, "allow")
    assert got[5] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[6] == ("example.com", "/en/", "example.com/en/", "block") and got[7][2:] == ("com/", "allow")
    assert got[8] == ("x.net", "/fr/", "net/fr/", "block")
    assert [got[i][3] for i in (9, 10, 11, 12)] == ["block", "allow", "block", "allow"]
    assert got[13][2] == "com/" and got[14] == ("h", "/p\nq", None, "allow")
    assert url_filter.filter_urls(df).count() == len(urls) + 1 and url_filter.filter_urls(df.limit(0)).count() == 0


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rows = token_counts.count_tokens(docs, WORDS, keep=["doc_id", "N_TOKENS"])
    assert rows.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    for r in rows.collect():
        if r["doc_id"] is not None:
            text = TEXTS[r["doc_id"]] or ""
            n = len(library.encode(text, add_special_tokens=False).ids)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)
    assert token_counts.count_tokens(empty, WORDS).count() == 0


def test_token_counts_of_any_text():
    """Cutting at ASCII white space never changes the library's count."""
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)

    @settings(max_examples=150, deadline=None)
    @given(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(list(" \t\n'sé́  <|>Σς")), max_size=60))
    def check(text):
        assert sum(token_counts.encoded_lengths(WORDS, text.encode().split())) == len(library.encode(text, add_special_tokens=False).ids)

    check()


def test_language(spark, docs, empty):
    english, german = "the quick thing that they were with this", "und der die das nicht ist ein schön"
    rows = [(i, t, l) for i in range(20) for t, l in ((english, "en"), (german, "de"))]
    profiles = language_id.learn_profiles(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    assert sorted(profiles) == ["de", "en"]
    test = spark.createDataFrame([(1, "they that with"), (2, "nicht und das"), (3, None), (4, "12 -- !"), (5, ""), (6, english * 5000)], "doc_id long, text string")
    got = by_id(language_id.identify(test, profiles))
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.identify(empty, profiles).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}
    out = language_id.identify(docs, profiles, keep=["doc_id", "score"])
    assert out.columns == ["doc_id", "lang_pred", "score"] and out.count() == docs.count()


def test_bundles_brute_force():
    texts = ["Ab ba!", "", "ça va? ÇA VA", "日本 語"]
    vectors = language_id.Vectors(64)
    first, second, third = vectors.places
    codes = language_id.letter_codes()
    found, letters = language_id.bundles([t.encode() for t in texts], vectors)
    for row, n, t in zip(found, letters, texts):
        c = [int(codes[ord(x)]) for x in f" {t} ".lower()]
        c = [x for i, x in enumerate(c) if i == 0 or not (x == 32 and c[i - 1] == 32)]
        want = sum((first[a] * second[b] * third[d] for a, b, d in zip(c, c[1:], c[2:])), np.zeros(64))
        assert (row == want).all() and n == sum(x.isalpha() for x in t)


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(0)
    plain = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(plain, 60)) for _ in range(300)]
    toxic = [int(i % 6 == 0) for i in range(300)]
    texts = [t + " vile nasty rotten" if y else t for t, y in zip(texts, toxic)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic) if i < 240] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(df, labels)
    got = by_id(toxicity.score_toxicity(df, model))
    assert all(got[i]["predicted"] == toxic[i] for i in range(240, 300))
    spans = got[240]["passages"]
    assert spans and texts[240].split()[spans[0]["first"] : spans[0]["end"]] == ["vile", "nasty", "rotten"]
    odd = toxicity.score_toxicity(docs, model, keep=["doc_id", "score"])
    assert odd.columns == ["doc_id", "score", "predicted", "passages"] and odd.where("score BETWEEN 0 AND 1").count() == docs.count()
    assert toxicity.score_toxicity(empty, model).count() == 0
    blank = toxicity.learn_toxicity(df, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score_toxicity(df, blank).collect()} <= {0, 1}


def test_segments_brute_force():
    """Maximal segments: no part of one scores 0 or less at its start or end, and none can grow."""
    rng = np.random.default_rng(3)

    def maximal(s, a, b):
        """All maximal segments of s[a:b], by the definition: the best one, then those left and right of it."""
        if a >= b:
            return []
        best = max(((sum(s[i:j]), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best[0] <= 0:
            return []
        _, _, _, i, j = best
        return [*maximal(s, a, i), (i, j), *maximal(s, j, b)]

    for _ in range(200):
        s = rng.integers(-5, 6, 14).astype(float) + rng.random(14) * 1e-3
        found = toxicity.segments(s)
        assert [(a, b) for a, b, _ in found] == maximal(list(s), 0, len(s))
        assert all(abs(score - s[a:b].sum()) < 1e-9 for a, b, score in found)


def test_scores(spark, docs, empty):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(words, 80, p=p / p.sum())) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = lm_score.score_texts(df, F.col("doc_id") % 4 != 2).toPandas().set_index("doc_id")
    train = [w for i, t in enumerate(texts) if i % 4 != 2 for w in t.split()]
    ends, total = 90, len(train) + 90
    distinct = len(set(train)) + 1
    for i in (2, 6, 7):
        want = sum(np.log10((train.count(w) + 1) / (total + distinct + 1)) for w in texts[i].split()) + np.log10((ends + 1) / (total + distinct + 1))
        assert abs(out.base_score[i] - want) < 1e-6 and out.train_tokens[i] == total and out.n_tokens[i] == 81
    odd = lm_score.score_texts(docs, F.col("doc_id") != 3).collect()
    assert len(odd) == docs.count() and all(np.isfinite(r["score"]) and r["score"] < 0 for r in odd)
    assert [r["n_tokens"] for r in odd if r["doc_id"] in (0, 1, 2)] == [1, 1, 1]
    assert len({r["score"] for r in odd if r["doc_id"] in (4, 5)}) == 1
    assert lm_score.score_texts(empty, F.lit(True)).count() == 0
    assert lm_score.score_texts(docs, F.lit(False)).count() == docs.count()


def test_word_probabilities_sum_to_one():
    """Over all next symbols the mixed and refined probabilities sum to one, in a text's first and later blocks."""
    rng = np.random.default_rng(2)
    code = lm_bits.Code.of([int(x) for x in rng.integers(1, 60, 40)])
    n, contexts = 40, 3
    tables = rng.integers(-90, 90, (contexts, 1 << 12)).astype(np.int8)
    weights = rng.normal(0.4, 0.3, lm_bits.start(code, 4).shape).astype(np.float32)
    model = lm_bits.Predictor(code, 12, tables, weights, np.clip(lm_bits.CENTRE + rng.normal(0, 0.1, len(lm_bits.CENTRE)), 0.01, 0.99))
    counts = [rng.integers(0, 4, n) * (rng.random(n) < 0.5)]
    begins, (told,) = lm_bits.exact_values(code, np.zeros(n, np.uint64), np.arange(n), counts)
    for length in (0, 2, 700):
        before = rng.integers(0, n, length)
        scores = []
        for symbol in range(n):
            text = np.append(before, symbol)
            hashes = [np.append(rng.integers(0, 1 << 32, 0), (np.arange(length + 1) * 2654435761 + k) % (1 << 32)).astype(np.uint32) for k in range(contexts)]
            at = np.append(begins[code.rank[before]], begins[code.rank[symbol]])
            scores.append(model.scores(text, np.array([length + 1]), hashes, told, at)[0])
        whole = model.scores(before, np.array([length]), [h[:-1] for h in hashes], told, at[:-1])[0] if length else 0.0
        assert abs(np.exp(np.array(scores) - whole).sum() - 1) < 1e-3


def test_exact_values_brute_force():
    rng = np.random.default_rng(4)
    code = lm_bits.Code.of([int(x) for x in rng.integers(1, 200, 60)])
    rows = np.unique(np.stack((rng.integers(0, 30, 400), rng.integers(0, 60, 400)), 1), axis=0)
    rows = rows[(rows[:, 0] % 3 > 0) | (np.arange(len(rows)) % 7 == 0)]
    counts = [rng.integers(0, 50, len(rows)), rng.integers(0, 2, len(rows))]
    first, found = lm_bits.exact_values(code, rows[:, 0].astype(np.uint64), rows[:, 1], counts)
    path = lambda r: [int(x) for x in f"{int(code.words[code.by_rank[r]]):064b}"[: code.lengths[code.by_rank[r]]]]
    for (context, rank), at in zip(rows.tolist(), first.tolist()):
        own = path(rank)
        for c, got in zip(counts, found):
            for d in range(len(own)):
                under = [(path(r), k) for (x, r), k in zip(rows.tolist(), c.tolist()) if x == context and path(r)[:d] == own[:d]]
                support, against = sum(k for p, k in under if p[d] == own[d]), sum(k for p, k in under if p[d] != own[d])
                want = 0 if support + against == 0 else int(np.clip(np.rint(2 * np.log((support + 0.4) / (against + 0.4))), -12, 12)) * 10 or 2 * own[d] - 1
                assert got[at + d] == want


def _learned(df, half):
    rows = df.select(F.lit(1).alias("key"), "text", half.cast("int").alias("half"))
    counts = lm_score.word_counts(df)
    words = lm_score.learn_words(counts, df.count())
    held = lm_score.packs(rows, words)
    return words, held, *lm_score.learn(held, words)


@pytest.mark.parametrize("part", [50, 2_000_000])
def test_exact_context_gathers_the_whole_corpus(spark, part, monkeypatch):
    """Every pack is told the counts of all packs; nothing is capped."""
    monkeypatch.setattr(lm_score, "PART", part)
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(list("abcdefgh"), 30)) for _ in range(40)] + ["x y z x y z x"] * 5
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    words, _, exact, _ = _learned(df, F.pmod(F.xxhash64("text"), F.lit(2)))
    known, held = Counter(), exact.collect()
    for r in held:
        found, n, first = lm_score._read(r["symbols"], r["sizes"])
        known.update(zip(lm_score.word_contexts(found, first)[1].tolist(), found.tolist()))
    code = words.code
    path = [f"{int(w):064b}"[:n] for w, n in zip(code.words, code.lengths)]
    for r in held[:4]:
        found, n, _, told, at = lm_score._inputs_of(code, r["symbols"], r["sizes"], np.frombuffer(lm_score._unpacked(r["exact"]), np.int8))
        first = np.zeros(len(found), bool)
        first[np.cumsum(n) - n] = True
        two = lm_score.word_contexts(found, first)[1]
        for i in range(0, len(found), 17):
            own = path[found[i]]
            for d in range(len(own)):
                under = [(path[s], k) for (c, s), k in known.items() if c == two[i] and path[s][:d] == own[:d]]
                support, every = sum(k for p, k in under if p[d] == own[d]), sum(k for _, k in under)
                assert told[at[i] + d] == lm_bits.agreements(np.array([support]), np.array([every - support]), own[d] == "1")[0]


def test_answers_of_the_other_half():
    """A training pack is told what the other half alone says, beside all; one that teaches nothing, only all."""
    code = lm_bits.Code.of([5, 4, 3, 2])
    context, rank = np.array([7, 7, 9], np.uint32), np.array([0, 2, 1], np.uint16)

    def asked(which, n):
        at = np.array(which)
        return lm_score._packed(lm_score._planes(np.diff(context[at], prepend=np.uint32(0))) + lm_score._planes(rank[at]) + lm_score._planes(np.array(n, np.uint32)))

    rows = [(1, 0, asked([0, 2], [3, 1])), (2, 1, asked([0, 1], [2, 4])), (3, 2, asked([1, 2], [9, 9]))]
    told = {b.column(0)[0].as_py(): np.frombuffer(lm_score._unpacked(b.column(2)[0].as_py()), np.int8) for b in lm_score._answers(code, 0, rows)}
    begins, (zero, one, every) = lm_bits.exact_values(code, context.astype(np.uint64), rank.astype(np.int64), [np.array([3, 0, 1]), np.array([2, 4, 0]), np.array([5, 4, 1])])
    lengths = code.lengths[code.by_rank[rank]]
    of = lambda values, which: np.concatenate([values[begins[i] : begins[i] + lengths[i]] for i in which])
    assert np.array_equal(told[1], np.append(of(every, [0, 2]), of(one, [0, 2])))
    assert np.array_equal(told[2], np.append(of(every, [0, 1]), of(zero, [0, 1]))) and np.array_equal(told[3], of(every, [1, 2]))


def test_answers_in_runs_need_little_memory():
    """op3: a part is told the same in runs of contexts as at once, and holds a small part of the memory."""
    rng = np.random.default_rng(9)
    code = lm_bits.Code.of([int(x) for x in rng.integers(1, 1_000, 5_000)])
    rows = []
    for pack in range(24):
        context, rank, n, _ = lm_score.entries(rng.integers(0, 40_000, 25_000).astype(np.uint32), rng.integers(0, 5_000, 25_000))
        rows.append((pack, pack % 3, lm_score._packed(lm_score._planes(np.diff(context, prepend=np.uint32(0))) + lm_score._planes(rank) + lm_score._planes(n.astype(np.uint32)))))

    def told(*most):
        tracemalloc.start()
        found = [b.column(2)[0].as_py() for b in lm_score._answers(code, 0, rows, *most)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found, peak

    (runs, peak), (whole, much), (many, _) = told(), told(10**9), told(1_000)
    assert runs == whole == many and peak < 0.6 * much



def test_every_coded_word_is_a_context():
    """Words of any rank before, pairs of words and the last but one tell contexts apart."""
    first = np.array([True, False, False])
    (a, p), (b, q), (c, r) = (lm_score.word_contexts(np.array([x, y, 7]), first) for x, y in ((50_000, 60_000), (50_000, 60_001), (50_001, 60_000)))
    assert a[0][2] != b[0][2] and a[1][2] == b[1][2] and a[0][2] == c[0][2] and a[1][2] != c[1][2]
    assert len({p[2], q[2], r[2]}) == 3 and p[0] == (1 << 16 | 1) and p[1] == (1 << 16 | 50_000)
    pairs = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65_521)
    assert len(np.unique(lm_score.mixed(pairs))) == len(pairs)
    assert len(lm_score.byte_contexts(np.array([97, 98, 256]), first)) == 3


def test_packs_of_any_size_have_the_same_entries():
    rng = np.random.default_rng(8)
    two, rank = rng.integers(0, 500, 70_000).astype(np.uint32), rng.integers(0, 90, 70_000)
    long = lm_score.entries(two, rank)
    context, ranks, n, of = lm_score.entries(two[:60_000], rank[:60_000])
    for c, r, k, o, m in ((*long, 70_000), (context, ranks, n, of, 60_000)):
        assert n.sum() == 60_000 and (c[o] == lm_score.mixed(two[:m])).all() and (r[o] == rank[:m]).all() and (np.bincount(o) == k).all()


def test_every_text_teaches_counters_and_mixer(spark):
    df = spark.createDataFrame([(i, " ".join(["one two three four"] * 20)) for i in range(12)], "id long, text string")
    made = [_learned(df, h)[3] for h in (F.lit(0), F.lit(1), F.col("id") % 2)]
    assert made[0].tables.any() and all((m.tables == made[0].tables).all() for m in made[1:])
    first = lm_bits.start(made[2].code, 4)
    assert np.abs(made[2].weights - first).max() > 0
    mixer = lm_bits.Mixer(made[0].code, 3)
    mixer.learn(made[0].tables, made[0].bits, np.ones(100_000, np.int64), [np.zeros(100_000, np.uint32)] * 3)
    assert mixer.every.sum() == 100_000 * made[0].code.lengths[1]


def test_all_words_give_letter_counts(spark):
    """Also above 100,000 distinct words, with one very frequent."""
    counts = spark.range(120_000).select(F.format_string("w%d", "id").cast("binary").alias("word"), F.when(F.col("id") == 7, 10**6).otherwise(F.col("id") % 3 + 1).alias("n"))
    want = Counter()
    for r in counts.collect():
        for b in bytes(r["word"]):
            want[b] += r["n"]
    words = lm_score.learn_words(counts, 0, coded=10)
    rare = words.listed + words.new - (0 if words.new > 1 else 1)
    code = lm_bits.Code.of([want[b] + 1 if b < 256 else rare + 1 for b in range(257)])
    assert np.array_equal(code.static, words.spelling.code.static) and np.array_equal(code.words, words.spelling.code.words)


def test_tokens_are_the_words_of_the_contract():
    import re

    texts = ["  A\x0bb\x0c c\x1cd\x85e\u3000f  ", "", None, " \n", "É İx", "z"]
    flat, n = lm_score.tokens(pa.array(texts))
    want = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or "")) for t in texts]
    assert flat.to_pylist() == [w for ws in want for w in ws] and n.tolist() == [len(w) for w in want]


def test_segmentations(docs, empty):
    rows = subword.sample_segmentations(docs, PIECES, samples=3).collect()
    assert subword.sample_segmentations(empty, PIECES).count() == 0
    model = subword.load_pieces(PIECES)
    seen = {}
    for r in rows:
        if r["doc_id"] is not None:
            assert model.decode(r["pieces"]) == (TEXTS[r["doc_id"]] or "")
            assert r["n_pieces"] == len(r["pieces"]) and r["log_prob"] <= 1e-9
        seen.setdefault(r["doc_id"], []).append((r["rank"], tuple(r["pieces"])))
    assert len(seen[0]) == len(seen[1]) == 1 and len(set(seen[3])) == 3
    assert len(seen[4]) == 6 and len(set(seen[4])) == 3  # the repeated row gives the same again
    back = subword.decode_pieces(subword.sample_segmentations(docs.where("doc_id = 6"), PIECES), PIECES).collect()
    assert {r["text"] for r in back} == {TEXTS[6]}


def test_segmentations_without_replacement():
    """First choices follow the lattice's probabilities, second ones those without the first."""
    model = subword.load_pieces(PIECES, 0.3)
    n = 6_000
    rows = subword.sample_texts(model, [b"hello"] * n, subword._mix(np.arange(n, dtype=np.uint64)), 2)
    log_p = {tuple(r[2]): r[3] for r in rows}
    first = {r[0]: tuple(r[2]) for r in rows if r[1] == 1}
    second = {r[0]: tuple(r[2]) for r in rows if r[1] == 2}
    assert all(first[i] != second[i] for i in second) and len(second) == n
    a = max(log_p, key=log_p.get)
    share = np.mean([f == a for f in first.values()])
    assert abs(share - np.exp(log_p[a])) < 0.03
    b = max((s for s in log_p if s != a), key=log_p.get)
    pair = np.mean([first[i] == a and second[i] == b for i in first])
    assert abs(pair - np.exp(log_p[a]) * np.exp(log_p[b]) / (1 - np.exp(log_p[a]))) < 0.03


def test_vector_search(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[100:160] = x[40]  # a hot vector
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [1.0]), (None, rows[3][1]), (1080, [None] + [1.0] * 7)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(4)
    for sizes in ({"list_size": 1000}, {"list_size": 40, "expected": 1.0}):
        out = vector_search.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=20, **sizes).collect()
        for q in (0, 40, 120, 380):
            s = (x.astype(float) * x[q].astype(float)).sum(1)
            order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
            mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
            assert [m[1] for m in mine] == order and all(abs(m[2] - s[m[1]]) < 1e-9 for m in mine)
        assert {r["query_id"] for r in out} == set(range(0, 400, 20))
    few = vector_search.nearest_neighbours(df.where("vec_id < 5"), F.col("vec_id") == 0, k=20).collect()
    assert len(few) == 4
    assert vector_search.nearest_neighbours(df.limit(0), F.lit(True)).count() == 0


def test_vector_search_among_near_copies(spark):
    """A query beside 1,000 near copies finds its true neighbours, more than a shortlist holds."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1600, 64))
    x[300:1300] = x[300] + rng.normal(size=(1000, 64)) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(2)
    out = vector_search.nearest_neighbours(df, F.col("vec_id").isin(0, 300, 700), k=20, sample=400, list_size=10_000).collect()
    for q in (0, 300, 700):
        s = (x * x[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]
        assert [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_vector_search_returns_what_the_index_finds(spark):
    """Rows outside the probed lists never come back, and recall holds on more rows than the sample."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 16)) * 0.1
    x[:10, 0] += 30  # a list of ten
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(2)
    one = vector_search.nearest_neighbours(df, F.col("vec_id") == 3, k=2, list_size=200, expected=1e-9).collect()
    assert {r["vec_id"] for r in one} <= set(range(10)) - {3}
    out = vector_search.nearest_neighbours(df, F.col("vec_id") % 50 == 11, k=20, sample=500, list_size=200).collect()
    found = 0
    for q in range(11, 2000, 50):
        s = (x * x[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]
        mine = {r["vec_id"] for r in out if r["query_id"] == q}
        assert len(mine) == 20
        found += len(mine & set(want))
    assert found >= 0.9 * 40 * 20
