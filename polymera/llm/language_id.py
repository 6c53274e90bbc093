"""Language identification by hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polymera.llm.common import append_columns, slices, trimmed

#: Components of a vector, letters bound in an n-gram, and the seed of the letter vectors.
DIMENSIONS, SEED = 512, 20_240
#: Letters have 1,024 vectors: one for each code point below _LATIN, the rest of the scripts share the others.
_LETTERS, _LATIN, _SPACE = 1024, 0x250, 0x20
#: n-gram vectors a worker keeps.
_KEPT = 60_000
#: Different languages at most: the driver and each task hold one vector for each.
MOST_LANGUAGES = 4_096
#: Temperature that turns cosines into a score.
SHARPNESS = 20.0

_table: list[np.ndarray] = []


def letter_codes() -> np.ndarray:
    """Letter id of every code point; what is no letter has the id of the space."""
    if not _table:
        cp = np.arange(0x110000)
        letter = np.zeros(0x110000, bool)
        letter[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        codes = np.where(cp < _LATIN, cp, _LATIN + cp % (_LETTERS - _LATIN))
        _table.append(np.where(letter, codes, _SPACE).astype(np.int32))
        _table[0][0] = -1  # ends a document
    return _table[0]


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number and packed id of every letter trigram, and each document's letters.

    Texts are lower-cased; each run of other characters is one space, and one space stands before and
    after a text. Very long texts are one array of four bytes a character.
    """
    # chr(0) ends a document; a text's own is replaced by a space
    joined = " \0 ".join(t.decode("utf-8", "replace").replace("\0", " ") for t in texts)
    cp = np.frombuffer(f" {joined} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = letter_codes()[cp]
    space = code == _SPACE
    code = code[~(space & np.concatenate(([False], space[:-1])))]
    doc = np.cumsum(code < 0, dtype=np.int32)
    n_letters = np.bincount(doc[(code >= 0) & (code != _SPACE)], minlength=len(texts))
    if len(code) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), n_letters
    a, b, c = code[:-2], code[1:-1], code[2:]
    whole = (a >= 0) & (b >= 0) & (c >= 0)
    packed = (a << 20) | (b << 10) | c
    return doc[:-2][whole], packed[whole], n_letters


class Vectors:
    """n-gram vectors: letter vectors of +1 and -1, permuted (rolled) by place and bound by product."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        base = np.random.default_rng(seed).integers(0, 2, (_LETTERS, dimensions), np.int8) * 2 - 1
        self.places = [np.roll(base, 2, 1), np.roll(base, 1, 1), base]
        self.ids, self.rows = np.zeros(0, np.int32), np.zeros((0, dimensions), np.int8)

    def make(self, ids: np.ndarray) -> np.ndarray:
        first, second, third = self.places
        return first[ids >> 20] * second[(ids >> 10) & 1023] * third[ids & 1023]

    def of(self, ids: np.ndarray) -> np.ndarray:
        """Vectors of sorted, different ids; most come from the worker's cache."""
        at = np.searchsorted(self.ids, ids)
        known = np.zeros(len(ids), bool)
        inside = at < len(self.ids)
        known[inside] = self.ids[at[inside]] == ids[inside]
        out = np.empty((len(ids), self.rows.shape[1]), np.int8)
        out[known] = self.rows[at[known]]
        if not known.all():
            new = ids[~known]
            out[~known] = made = self.make(new)
            if len(self.ids) + len(new) > _KEPT:
                self.ids, self.rows = new[:_KEPT], made[:_KEPT]
            else:
                order = np.argsort(merged := np.concatenate((self.ids, new)))
                self.ids, self.rows = merged[order], np.concatenate((self.rows, made))[order]
        return out


def bundles(texts: list[bytes], vectors: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the n-gram vectors of each text, and its letters."""
    doc, packed, n_letters = trigrams(texts)
    out = np.zeros((len(texts), vectors.rows.shape[1]))
    if len(packed):
        ids, inverse = np.unique(packed, return_inverse=True)
        for at in range(0, len(ids), 8192):  # bounds the dense counts
            here = (inverse >= at) & (inverse < at + 8192) if len(ids) > 8192 else slice(None)
            width = min(8192, len(ids) - at)
            counts = np.bincount(doc[here].astype(np.int64) * width + (inverse[here] - at), minlength=len(texts) * width)
            out += counts.reshape(len(texts), width).astype(np.float32) @ vectors.of(ids[at : at + 8192]).astype(np.float32)
    return out, n_letters


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototype of each non-null language: the bundle of all n-grams of all its texts.

    Each task sums trigram counts by language, bundles them once and emits `dimensions` rows for each of
    its languages, which Spark sums as whole numbers: the prototypes do not depend on the order of rows.
    The driver gets dimensions x languages numbers; more than MOST_LANGUAGES different languages raise,
    since that is no column of languages.
    """
    source = docs.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = Vectors(dimensions, seed), {}
        for batch in batches:
            for part, texts in slices(batch, 1):
                langs = np.array(part.column(0).to_pylist(), object)
                doc, packed, _ = trigrams(texts)
                for name in set(langs):
                    ids, n = np.unique(packed[(langs == name)[doc]] if len(doc) else packed, return_counts=True)
                    total = sums.setdefault(name, np.zeros(dimensions, np.int64))
                    for at in range(0, len(ids), 8192):
                        total += np.rint(n[at : at + 8192].astype(np.float64) @ vectors.of(ids[at : at + 8192]).astype(np.float64)).astype(np.int64)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions, pa.string()), pa.array(range(dimensions), pa.int32()), pa.array(total, pa.int64())], names=["lang", "i", "v"])

    if (n := source.agg(F.approx_count_distinct("lang")).first()[0]) > MOST_LANGUAGES:
        raise ValueError(f"some {n} different languages in {lang}; {MOST_LANGUAGES} at most can be told apart")
    rows = source.mapInArrow(trimmed(run), "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect()
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(dimensions))[r["i"]] = r["v"]
    return out


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", keep: list[str] | None = None, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Append lang_pred and score to every whole text.

    The language is that of the greatest cosine between the text's bundle and a prototype, the score its
    softmax share of the cosines (times SHARPNESS). What all languages share (the mean of the unit
    prototypes) is taken from both sides first. Null texts, and texts without a letter, are `und` with score 0, as is every text if
    nothing was learned. Ties go to the language first in order; repeated rows are judged each; input
    columns named like the new ones give way.
    """
    names = sorted(profiles)
    unit = np.array([profiles[n] / (np.linalg.norm(profiles[n]) or 1) for n in names]).reshape(len(names), dimensions)
    shared = unit.mean(0) if len(names) > 1 else np.zeros(dimensions)
    centred = unit - shared
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
    model = docs.sparkSession.sparkContext.broadcast((names, shared, centred))

    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        names, shared, centred = model.value
        vectors = Vectors(dimensions, seed)

        def work(texts: list[bytes]) -> list[pa.Array]:
            found, n_letters = bundles(texts, vectors)
            norm = np.linalg.norm(found, axis=1, keepdims=True)
            found = found / np.maximum(norm, 1e-12) - shared
            found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
            if not names:
                return [pa.array(["und"] * len(texts)), pa.array([0.0] * len(texts))]
            cosine = (found @ centred.T).round(9)
            best = cosine.argmax(1)
            share = 1 / np.exp(SHARPNESS * (cosine - cosine.max(1, keepdims=True))).sum(1)
            known = (n_letters > 0) & (norm[:, 0] > 0)
            return [pa.array([names[b] if k else "und" for b, k in zip(best, known)], pa.string()), pa.array(np.where(known, share, 0.0))]

        return work

    return append_columns(docs, text, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], keep)
