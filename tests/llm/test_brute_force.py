"""Learned queries and the whole pipeline against plain versions, one text and one token at a time."""

import json
import math
import os
import shutil
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from polymera.llm import language_id, queries, subword, toxicity  # noqa: E402

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="needs the larger tables")


def fold_of(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def plain_features(token):
    """The token, then its first five and four bytes if it is longer; the mark tells prefixes from tokens."""
    return [("token", token)] + [("prefix", token[:n]) for n in (5, 4) if len(token) > n]


def plain_words(text):
    return [w.strip(toxicity.EDGES) for w in (text or "").encode().lower().split()]


def plain_segments(scores):
    """Scores of the maximal segments by their definition: the best one, then the same left and right of it."""
    found, open_ = [], [(0, len(scores))]
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    while open_:
        a, b = open_.pop()
        if a >= b:
            continue
        low = np.minimum.accumulate(sums[a:b])
        gain = sums[a + 1 : b + 1] - low
        end = int(gain.argmax())
        if gain[end] <= 1e-12:
            continue
        first = a + int(np.flatnonzero(sums[a : a + end + 1] == low[end])[-1])
        found.append(float(gain[end]))
        open_ += [(a, first), (a + end + 1, b)]
    return found


class PlainToxicity:
    """Log-odds under Dirichlet priors, a Gumbel tail over clean texts, and a logistic map."""

    def __init__(self, rows):
        """rows: (text, toxic)."""
        held = Counter()
        sizes = Counter(y for _, y in rows)
        for text, y in rows:
            held.update({(f, y) for w in plain_words(text) if w for f in plain_features(w)})
        every = sum(sizes.values())
        prior = [toxicity.PRIOR * sizes[y] / every for y in (0, 1)]
        self.weights = {}
        for f in {f for f, _ in held}:
            a, b = held[f, 1] + prior[1], held[f, 0] + prior[0]
            odds = math.log(a / (sizes[1] + prior[1])) - math.log(b / (sizes[0] + prior[0]))
            z = odds / math.sqrt(1 / a + 1 / b)
            if abs(z) >= toxicity.LEAST_Z and abs(odds) >= toxicity.LEAST_ODDS:
                self.weights[f] = min(max(odds, -toxicity.MOST_ODDS), toxicity.MOST_ODDS)
        clean = [(max(s, default=0.0), n) for s, n in (self.found(t) for t, y in rows if y == 0)]
        at = float(np.quantile([s for s, _ in clean], 0.9))
        over = [s - at for s, _ in clean if s > at]
        self.scale = min(max(1 / max(1e-3, sum(over) / len(over)), 0.2), 2.0) if over else 1.0
        self.size = max(len(over), 1) / len(clean) * math.exp(self.scale * at) / (sum(max(1, n) for _, n in clean) / len(clean))
        x = np.array([self.evidence(t) for t, _ in rows])
        y = np.array([y for _, y in rows])
        self.line = self.fitted(x, y)

    def found(self, text):
        words = plain_words(text)
        scores = [next((self.weights[f] for f in plain_features(w) if f in self.weights), toxicity.DRIFT) for w in words]
        return plain_segments(scores), len(words)

    def evidence(self, text):
        scores, n = self.found(text)
        chance = math.log(self.size * max(1, n) + 1e-12)
        bits = [self.scale * s - chance for s in scores]
        return min(60.0, sum(b for b in bits if b >= -math.log(toxicity.SIGNIFICANT)))

    @staticmethod
    def fitted(x, y, ridge=1e-3):
        """The line of least loss, by nested sections: the best offset for each slope."""

        def p(a, b):
            return 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))

        def section(slope_of, low, high):
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (low, mid) if slope_of(mid) > 0 else (mid, high)
            return (low + high) / 2

        def offset(a):
            return section(lambda b: (p(a, b) - y).sum(), -30.0, 30.0)

        a = section(lambda a: ((p(a, offset(a)) - y) * x).sum() + ridge * a, 0.0, 30.0)
        return a, offset(a)

    def score(self, text):
        return 1 / (1 + math.exp(-(self.line[0] * self.evidence(text) + self.line[1])))


class PlainLanguage:
    """Letter trigrams as products of rolled letter vectors, summed by language, compared by cosine."""

    def __init__(self, rows):
        """rows: (text, lang)."""
        self.base = np.random.default_rng(language_id.SEED).integers(0, 2, (1024, language_id.DIMENSIONS), np.int8).astype(int) * 2 - 1
        self.vectors = {}
        sums = {}
        for text, lang in rows:
            sums[lang] = sums.get(lang, 0) + self.bundle(text)
        self.names = sorted(sums)
        unit = [sums[n] / np.linalg.norm(sums[n]) for n in self.names]
        self.shared = sum(unit) / len(unit)
        self.centred = [(u - self.shared) / np.linalg.norm(u - self.shared) for u in unit]

    def trigrams(self, text):
        codes = [0x20]
        for c in (text or "").lower() + " ":
            cp = ord(c)
            code = (cp if cp < 0x250 else 0x250 + cp % (1024 - 0x250)) if c.isalpha() else 0x20
            if code != 0x20 or codes[-1] != 0x20:
                codes.append(code)
        return Counter(zip(codes, codes[1:], codes[2:]))

    def bundle(self, text):
        out = np.zeros(language_id.DIMENSIONS)
        for g, n in self.trigrams(text).items():
            if g not in self.vectors:
                a, b, c = (self.base[x] for x in g)
                self.vectors[g] = np.roll(a, 2) * np.roll(b, 1) * c
            out += n * self.vectors[g]
        return out

    def told(self, text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        v = self.bundle(text)
        v = v / np.linalg.norm(v) - self.shared
        cosine = [float(v @ c / np.linalg.norm(v)) for c in self.centred]
        best = max(range(len(cosine)), key=lambda i: cosine[i])
        return self.names[best], 1 / sum(math.exp(language_id.SHARPNESS * (c - cosine[best])) for c in cosine)


@pytest.fixture(scope="module")
def corpus(spark):
    """(documents, labels) of the larger tables as plain rows."""
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").collect()]
    return docs, {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}


def test_toxicity_scores(spark, corpus):
    docs, labels = corpus
    plain = PlainToxicity([(t, labels[i]) for i, t, _ in docs if labels.get(i) is not None and fold_of(i, 4) != 2])
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for i, text, _ in docs:
        score = plain.score(text)
        assert got[i]["held_out"] == (fold_of(i, 4) == 2)
        assert abs(got[i]["score"] - score) < 1e-4 and got[i]["predicted"] == int(got[i]["score"] >= 0.3), i
    assert sum(r["predicted"] for r in got.values()) > 20


def test_told_languages(spark, corpus):
    docs, _ = corpus
    plain = PlainLanguage([(t, g) for i, t, g in docs if g is not None and fold_of(i, 4) != 2])
    got = {r["doc_id"]: r for r in queries.op8_language_id(spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for i, text, _ in docs:
        lang, score = plain.told(text)
        assert got[i]["held_out"] == (fold_of(i, 4) == 2)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-6, i


def test_pipeline_run(spark, corpus, tmp_path):
    """run() against a plain chain, over a corpus with copies, near copies, odd texts and nulls, and columns of clashing names."""
    _, labels = corpus
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    long = docs.where("length(text) > 600").orderBy("doc_id").limit(40)
    exact = long.withColumn("doc_id", F.col("doc_id") + 10**6)
    near = long.withColumn("doc_id", F.col("doc_id") + 2 * 10**6).withColumn("text", F.concat("text", F.lit(" so it ends")))
    odd = spark.createDataFrame([(3 * 10**6, None, None, None, None), (3 * 10**6 + 1, "", "en", "odd", 0), (3 * 10**6 + 2, "12 -- 34", None, "odd", 8), (3 * 10**6 + 3, "The report says that prices went up last year.", "en", "odd", 46)], docs.schema)
    folder = str(tmp_path)
    clashing = [F.lit(1).alias(c) for c in ("row", "score", "predicted", "lang_pred", "place", "kept", "weight", "block")]
    docs.unionAll(exact).unionAll(near).unionAll(odd).select("*", *clashing).repartition(3).write.parquet(f"{folder}/documents.parquet")
    shutil.copytree(f"{FOLDER}/labels.parquet", f"{folder}/labels.parquet") if os.path.isdir(f"{FOLDER}/labels.parquet") else shutil.copy(f"{FOLDER}/labels.parquet", folder)

    duck = duckdb.connect()
    duck.execute(f"CREATE TABLE kept AS SELECT doc_id, text, lang, source FROM '{folder}/documents.parquet/*.parquet'")
    rows = duck.sql("SELECT doc_id, text, lang FROM kept").fetchall()
    toxic = PlainToxicity([(t, labels[i]) for i, t, _ in rows if labels.get(i) is not None])
    rows = [r for r in rows if toxic.score(r[1]) < 0.3]
    language = PlainLanguage([(t, g) for _, t, g in rows if g is not None])
    told = {i: language.told(t) for i, t, _ in rows}
    left = [i for i, (lang, score) in told.items() if lang != "und" and score >= corpus_pipeline.LEAST_SCORE]
    assert 3 * 10**6 + 3 in left and not {3 * 10**6, 3 * 10**6 + 1, 3 * 10**6 + 2} & set(left)
    duck.execute("CREATE TABLE left_ AS SELECT unnest(?::BIGINT[]) AS doc_id", [left])
    duck.execute("CREATE TABLE documents AS SELECT * FROM kept WHERE doc_id IN (SELECT doc_id FROM left_)")
    duck.execute(f"CREATE TABLE once AS SELECT doc_id FROM ({queries.OP5_SQL}) WHERE kept")
    duck.execute("DELETE FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM once)")
    shown = Counter(i for (i,) in duck.sql(f"SELECT doc_id FROM ({queries.OP2_SQL})").fetchall())
    assert len(shown) == len(duck.sql("SELECT doc_id FROM once").fetchall()) < len(left) and max(shown.values()) > 1

    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in got if r["rank"] == 1) == shown
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    model = subword.load_pieces(public_tokenizers.path(corpus_pipeline.PIECES))
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], Counter())[json.dumps(r["pieces"])] += 1
    for i, found in by_id.items():  # two different segmentations, each as often as the document is shown
        assert len(found) == subword.SAMPLES and set(found.values()) == {shown[i]}
        assert {model.decode(json.loads(p)) for p in found} == {texts[i]}


def test_pipeline_of_no_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
