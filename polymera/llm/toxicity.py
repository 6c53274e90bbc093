"""Toxic passages by maximum-scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polymera.llm.common import append_columns, slices, trimmed

#: Strength of the Dirichlet prior (pseudo-documents a token, dealt to the classes by their sizes), and
#: the z-score and size that a token's log-odds must reach to keep its weight; the rest drift by DRIFT.
PRIOR, LEAST_Z, LEAST_ODDS, MOST_ODDS, DRIFT = 2.0, 3.5, 2.5, 8.0, -0.35
#: A token without a weight of its own takes that of its first bytes, the longest known first.
PREFIXES = (5, 4)
#: Tokens of a model at most, the strongest first: the bound of what is broadcast.
MODEL_TOKENS = 200_000
#: Labelled rows that the classifier is fitted on at most, those whose ids have the least hashes; and the
#: decision's score.
LABELLED_ROWS, THRESHOLD = 50_000, 0.3
#: The score of every text where labels of both kinds are missing: under the threshold.
UNTAUGHT = 0.05
#: A passage counts if its expected number by chance in a text of this length is at most this.
SIGNIFICANT = 0.01

#: Bytes cut from both ends of a word to get its token.
EDGES = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words without ASCII punctuation at their ends; a word of punctuation is an empty token."""
    return [w.strip(EDGES) for w in text.lower().split()]


def features(token: bytes) -> list[bytes]:
    """A token and its prefixes (marked by a zero byte), in the order in which their weights are sought."""
    return [token, *(b"\0" + token[:n] for n in PREFIXES if len(token) > n)]


def segments(scores: Sequence[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences (Ruzzo and Tompa) as (first, end, score), in linear time."""
    kept: list[list[float]] = []  # first, end, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
    return [(int(a), int(b), after - before) for a, b, before, after in kept]


def passages(weights: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """segments() of a text's token weights, in which 0 stands for the drift; runs of it are skipped."""
    at = np.flatnonzero(weights > 0)
    if not len(at):
        return []
    sums = np.concatenate(([0.0], np.cumsum(np.where(weights == 0, drift, weights))))
    if len(at) == 1:
        return [(int(at[0]), int(at[0]) + 1, float(weights[at[0]]))]
    steps = np.empty(2 * len(at) - 1)  # a positive token, then what lies before the next
    steps[::2] = weights[at]
    steps[1::2] = sums[at[1:]] - sums[at[:-1] + 1]
    return [(int(at[a // 2]), int(at[(b - 1) // 2]) + 1, s) for a, b, s in segments(steps.tolist())]


@dataclass
class ToxicityModel:
    """Token weights, the extreme-value scale and size (lambda, K), and the logistic map to a score."""

    weights: dict[bytes, float]
    scale: float = 1.0
    size: float = 0.05
    slope: float = 1.0
    offset: float = 0.0
    prior: float = 0.05
    memo: dict[bytes, float] = field(default_factory=dict, repr=False, compare=False)

    def token_weights(self, found: list[bytes]) -> np.ndarray:
        """Each token's weight or 0; those of tokens seen before come from a bounded memo."""
        if len(self.memo) > 500_000:
            self.memo.clear()
        memo = self.memo
        for t in set(found):
            if t not in memo:
                memo[t] = next((self.weights[f] for f in features(t) if f in self.weights), 0.0)
        return np.array([memo[t] for t in found])

    def evidence(self, text: bytes) -> tuple[float, list[tuple[int, int, float]]]:
        """Sum over significant passages of -ln of the number expected by chance, and the passages."""
        weights = self.token_weights(tokens(text))
        if not len(weights):
            return 0.0, []
        found, kept = 0.0, []
        base = math.log(self.size * len(weights) + 1e-12)
        for first, end, score in passages(weights):
            bits = self.scale * score - base  # -ln E
            if bits >= -math.log(SIGNIFICANT):
                found += bits
                kept.append((first, end, score))
        return found, kept

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * evidence + self.offset))))


def _token_counts(rows: DataFrame) -> DataFrame:
    """(token, toxic, clean): documents of each label that hold a feature, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array([v[1] for v in sums.values()], pa.int64()), pa.array([v[0] for v in sums.values()], pa.int64())], names=["token", "toxic", "clean"])
            sums.clear()
            return made

        for batch in batches:
            for part, texts in slices(batch, 0):
                for t, y in zip(texts, part.column(1).to_pylist()):
                    for w in {f for w in set(tokens(t)) if w for f in features(w)}:
                        sums.setdefault(w, [0, 0])[y] += 1
                if len(sums) > 200_000:
                    yield out()
        yield out()

    return rows.mapInArrow(trimmed(run), "token binary, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", model_tokens: int = MODEL_TOKENS, labelled_rows: int = LABELLED_ROWS) -> ToxicityModel:
    """Fit the model on the rows of docs that labels covers, `labelled_rows` labels at most.

    The labels used are broadcast, so no text is shuffled. A token's weight is the log ratio of the rates
    of toxic and clean texts that hold it under Dirichlet priors (Monroe et al.); weights whose z-score is
    under LEAST_Z, or which are smaller than LEAST_ODDS, are left out. Chance is fitted on clean texts:
    scores of their best passages follow a Gumbel law by length, whose tail is fitted. The last step is a
    two-parameter logistic fit on the same rows.
    Rows with null labels or ids teach nothing; a document labelled twice counts twice. Without labels of
    both kinds nothing tells toxic from clean: every weight is missing, every score is UNTAUGHT, and so no
    document is predicted toxic.
    """
    known = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("__k"), (F.col(f"`{label}`") == 1).cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("__k"), "__k", "toxic").limit(labelled_rows)
    rows = docs.select(F.col(f"`{key}`").alias("__k"), F.col(f"`{text}`").alias("text")).join(F.broadcast(known), "__k").select("text", "toxic")
    counts = _token_counts(rows)
    total = rows.agg(F.sum("toxic"), F.count("*")).first()
    n_toxic, n_clean = total[0] or 0, total[1] - (total[0] or 0)
    model = ToxicityModel({}, slope=0.0, offset=math.log(UNTAUGHT / (1 - UNTAUGHT)), prior=UNTAUGHT)
    if not n_toxic or not n_clean:
        return model
    for_toxic = PRIOR * n_toxic / (n_toxic + n_clean)
    a, b = F.col("toxic") + for_toxic, F.col("clean") + (PRIOR - for_toxic)
    odds = F.log(a / (n_toxic + for_toxic)) - F.log(b / (n_clean + PRIOR - for_toxic))
    z = odds / F.sqrt(1 / a + 1 / b)
    strong = counts.select("token", odds.alias("w"), z.alias("z")).where((F.abs("z") >= LEAST_Z) & (F.abs("w") >= LEAST_ODDS)).orderBy(F.desc(F.abs("z")), "token").limit(model_tokens).collect()
    model.weights = {bytes(r["token"]): max(-MOST_ODDS, min(MOST_ODDS, r["w"])) for r in strong}
    _calibrate(model, rows, labelled_rows)
    return model


def _calibrate(model: ToxicityModel, sample: DataFrame, most: int) -> None:
    """Fit chance on the clean texts of the labelled rows, then the score on all of them; `most` rows of each kind at most."""
    send = sample.sparkSession.sparkContext.broadcast(model)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = send.value
        for batch in batches:
            for part, texts in slices(batch, 0):
                n, top, every = [], [], []
                for t in texts:
                    weights = model.token_weights(tokens(t))
                    scores = [s for _, _, s in passages(weights)]
                    n.append(len(weights))
                    top.append(max(scores, default=0.0))
                    every.append(scores)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(n, pa.int64()), pa.array(top, pa.float64()), pa.array(every, pa.list_(pa.float64()))], names=["toxic", "n", "top", "every"])

    found = sample.select("text", "toxic").mapInArrow(trimmed(best), "toxic int, n long, top double, every array<double>")
    order = [F.xxhash64("n", "top"), "n", "top"]
    rows = [r for y in (0, 1) for r in found.where(F.col("toxic") == y).orderBy(*order).limit(most).collect()]  # ids may repeat in docs
    toxic = np.array([r["toxic"] for r in rows])
    n = np.array([max(1, r["n"]) for r in rows], float)
    top = np.array([r["top"] for r in rows])
    clean = top[toxic == 0]
    # A Gumbel law's upper tail falls exponentially: fit lambda on what exceeds the upper decile, then K
    # from the share that does: P(top > t) = K n exp(-lambda t).
    at = float(np.quantile(clean, 0.9))
    over = clean[clean > at] - at
    model.scale = float(np.clip(1 / max(1e-3, over.mean()) if len(over) else 1.0, 0.2, 2.0))
    share = max(len(over), 1) / len(clean)
    model.size = share * math.exp(model.scale * at) / float(n[toxic == 0].mean())
    base = np.log(model.size * n + 1e-12)
    least = -math.log(SIGNIFICANT)
    evidence = np.array([sum(x for s in r["every"] if (x := model.scale * s - b) >= least) for r, b in zip(rows, base)])
    model.slope, model.offset = _logistic(np.minimum(evidence, 60.0), toxic)
    model.prior = float(toxic.mean())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic regression of one feature, by Newton steps."""
    a, b = 0.1, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + ridge * a, (p - y).sum() + ridge * b])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = max(0.0, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Append score (0 to 1), predicted (score >= threshold) and passages to every whole text.

    passages are all significant maximal segments as (first token, end token, score). Null and empty
    texts have none and get the score of no evidence. Repeated rows are judged each; input columns named
    like the new ones give way.
    """
    send = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        model = send.value

        def work(texts: list[bytes]) -> list[pa.Array]:
            found = [model.evidence(t) for t in texts]
            scores = [model.score(min(e, 60.0)) for e, _ in found]
            spans = [[{"first": a, "end": b, "score": s} for a, b, s in p] for _, p in found]
            return [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(spans, pa.list_(passage))]

        return work

    spans = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    return append_columns(docs, text, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", spans)], keep)
