"""Approximate nearest neighbours: inverted lists of coarse centroids, product-quantised residuals, exact reranking."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polymera.llm.common import written

#: Vectors the index is fitted on at most (least hash of the id), mean vectors of a list, lists at most,
#: components of a sub-vector, codes of a sub-space, k-means rounds.
SAMPLE, LIST_SIZE, MOST_LISTS, SUB, CODES, ROUNDS, SEED = 40_000, 1_024, 4_096, 4, 256, 8, 5
#: Share of a query's neighbours that the probed lists are expected to hold: few lists where vectors lie in
#: clusters, most of them where they do not.
EXPECTED = 0.97
#: Distinct vectors of a block reranked exactly at first for a query, whose k-th best then tells which others
#: can reach it; vectors and queries of a block at most.
SHORTLIST, BLOCK, QUERIES = 128, 8_192, 8_192
#: Rows of the sample kept whole: a query's k-th best of those in its lists is a floor under which nothing is returned.
REFERENCE = 10_000


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids by Lloyd's rounds from a random start among different rows; empty ones take far rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    c = distinct[rng.permutation(len(distinct))[:k]].astype(np.float64)
    for _ in range(rounds):
        at, far = nearest(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        c[empty] = x[np.argsort(-far)[: len(empty)]]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid of each row, and its squared distance."""
    at, far = np.empty(len(x), np.int64), np.empty(len(x))
    norms = (c * c).sum(1)
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096]
        d = norms - 2 * part @ c.T
        at[i : i + 4096] = d.argmin(1)
        far[i : i + 4096] = d.min(1) + (part * part).sum(1)
    return at, far


@dataclass
class Index:
    """Coarse centroids, the spread of residuals about each, and the residuals' code books."""

    coarse: np.ndarray  # lists x dimensions
    radius: np.ndarray  # lists
    filled: np.ndarray  # lists: their shares of the sample
    total: int  # rows of the table
    books: list[np.ndarray]  # a table of codes for each sub-space
    edges: list[tuple[int, int]]  # its components
    reference_ids: np.ndarray
    reference: np.ndarray
    reference_lists: np.ndarray

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        residual = x - self.coarse[lists]
        return np.stack([nearest(residual[:, a:b], book)[0] for book, (a, b) in zip(self.books, self.edges)], 1).astype(np.uint8)

    def approximate(self, codes: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Queries x rows: products with the coded residuals, from each query's tables of products with all codes."""
        out = np.zeros((len(queries), len(codes)), np.float32)
        for i, (book, (a, b)) in enumerate(zip(self.books, self.edges)):
            out += (queries[:, a:b] @ book.T).astype(np.float32)[:, codes[:, i]]
        return out

    def misses(self, codes: np.ndarray, x: np.ndarray, list_no: int) -> np.ndarray:
        """Rows x sub-spaces: how far each row of a list is from what its codes say."""
        residual = x - self.coarse[list_no]
        return np.stack([np.linalg.norm(residual[:, a:b] - book[codes[:, i]], axis=1) for i, (book, (a, b)) in enumerate(zip(self.books, self.edges))], 1)

    def probes(self, ids: np.ndarray, queries: np.ndarray, k: int, expected: float) -> list[np.ndarray]:
        """Each query's fewest lists that are expected to hold this share of its k nearest.

        The reference tells the product that about k rows of the table reach; how many rows of a list reach
        it follows from the centroid's product and a normal spread of the list's residuals along the query.
        """
        out = []
        rank = max(1, math.ceil(k * len(self.reference) / max(1, self.total)))
        for at in range(0, len(queries), 256):
            some = queries[at : at + 256]
            found = some @ self.reference.T
            found[ids[at : at + 256][:, None] == self.reference_ids[None]] = -np.inf
            rank = min(rank, found.shape[1])
            reached = -np.partition(-found, rank - 1, axis=1)[:, rank - 1 : rank]
            spread = np.linalg.norm(some, axis=1)[:, None] * np.maximum(self.radius, 1e-9) / math.sqrt(some.shape[1])
            z = np.clip((reached - some @ self.coarse.T) / np.maximum(spread, 1e-300), -12, 12)
            hits = self.filled / (1 + np.exp(0.07056 * z**3 + 1.5976 * z))  # upper tail of the normal law
            order = np.argsort(-hits, axis=1, kind="stable")
            share = np.cumsum(np.take_along_axis(hits, order, 1), axis=1)
            n = (share < expected * share[:, -1:]).sum(1) + 1 if expected < 1 else np.full(len(some), order.shape[1])
            n = np.maximum(n, (np.cumsum(self.filled[order], axis=1) * self.total < 4 * k).sum(1) + 1)  # enough rows to choose from
            out += [o[:m] for o, m in zip(order, np.minimum(n, order.shape[1]))]
        return out

    def floors(self, query_ids: np.ndarray, queries: np.ndarray, picked: list[np.ndarray], k: int) -> np.ndarray:
        """Each query's k-th best product with reference rows of other ids in its probed lists; minus infinity if they are fewer.

        As those rows stand in the probed lists too, the search finds k rows over the floor by itself.
        """
        floor, inside = np.full(len(queries), -np.inf), np.zeros(len(self.coarse), bool)
        for i, (q, v) in enumerate(zip(query_ids, queries)):
            inside[:] = False
            inside[picked[i]] = True
            allowed = inside[self.reference_lists] & (self.reference_ids != q)
            rough = np.where(allowed, self.reference @ v, -np.inf)
            n = min(4 * k, len(rough))
            pick = np.argpartition(-rough, n - 1)[:n]
            pick = pick[allowed[pick]]
            exact = products(self.reference[pick], v)
            pick = pick[np.argsort(-exact, kind="stable")]
            pick = pick[np.sort(np.unique(self.reference_ids[pick], return_index=True)[1])][:k]  # an id counts once
            if len(pick) == k:
                floor[i] = products(self.reference[pick[-1:]], v)[0]
        return floor


def products(rows: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products, summed alike for equal rows wherever they stand."""
    return (rows * v).sum(-1)


def usable(vector: Column) -> Column:
    """True for a vector that is not null, empty or zero and has neither null nor non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit(vectors: DataFrame, total: int, sample: int = SAMPLE, list_size: int = LIST_SIZE) -> Index:
    """An index fitted on a bounded sample of vectors (id, v), for a table of `total` rows."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    x = np.array(rows["v"].tolist(), np.float64)
    coarse = k_means(x, int(np.clip(total // list_size, 1, MOST_LISTS)))
    lists, far = nearest(x, coarse)
    n = np.maximum(np.bincount(lists, minlength=len(coarse)), 1)
    radius = np.sqrt(np.maximum(np.bincount(lists, far, len(coarse)) / n, 0))
    residual = x - coarse[lists]
    edges = [(a, min(a + SUB, x.shape[1])) for a in range(0, x.shape[1], SUB)]
    part = residual[:20_000]
    kept = rows["id"].to_numpy()[:REFERENCE]
    return Index(coarse, radius, n / n.sum(), total, [k_means(part[:, a:b], CODES) for a, b in edges], edges, kept, x[:REFERENCE], lists[:REFERENCE])


def search_block(index: Index, list_no: int, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int, shortlist: int = SHORTLIST) -> list[tuple[int, int, float]]:
    """(query, id, score) of each query's k best at or over its floor in a block of one list, ties to the smaller id.

    Equal vectors stand together, so copies never crowd others out. After the shortlist, every vector
    whose approximate product plus the most its coding can miss reaches the k-th best is reranked: the
    result is exact in the block.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors, codes = ids[order], vectors[order], codes[order]
    own, first, group = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
    members = np.argsort(group.ravel(), kind="stable")  # within a group by id
    starts = np.searchsorted(group.ravel()[members], np.arange(len(own)))
    ends = np.append(starts[1:], len(ids))
    own_codes = codes[first].astype(np.int64)
    miss = index.misses(own_codes, own, list_no)
    widest = np.linalg.norm(own - index.coarse[list_no], axis=1).max() + miss.max()
    out = []
    for at in range(0, len(queries), 64):
        some = slice(at, at + 64)
        rough = index.approximate(own_codes, queries[some])
        n = min(max(shortlist, k + 1), len(own))
        pick = np.argpartition(-rough, n - 1, axis=1)[:, :n]
        exact = products(own[pick], queries[some][:, None, :])
        if n > k + 1:  # the best k + 1 of the block, with all that tie with the last of them
            last = -np.partition(-exact, k, axis=1)[:, k]
        else:
            last = np.full(len(exact), -np.inf)
        last = np.maximum(last, floors[some])
        sizes = np.stack([np.linalg.norm(queries[some][:, a:b], axis=1) for a, b in index.edges], 1)
        slack = 1e-5 * np.linalg.norm(queries[some], axis=1) * (widest + np.linalg.norm(index.coarse[list_no]))  # of single precision
        most = rough + sizes @ miss.T + (queries[some] @ index.coarse[list_no] + slack)[:, None]
        for i, reach in enumerate(most >= last[:, None]):
            q = query_ids[at + i]
            near = np.flatnonzero(reach)
            score = products(own[near], queries[at + i])
            if len(score) > k + 1:
                last[i] = max(last[i], -np.partition(-score, k)[k])
            found = []
            for e in np.flatnonzero(score >= last[i]):
                g = near[e]
                found += [(-score[e], int(x)) for x in ids[members[starts[g] : min(ends[g], starts[g] + k + 1)]] if x != q]
            out += [(int(q), x, -float(v)) for v, x in sorted(found)[:k]]
    return out


def nearest_neighbours(table: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, expected: float = EXPECTED, sample: int = SAMPLE, list_size: int = LIST_SIZE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest other ids by inner product found by the index.

    A query probes the fewest lists that are expected to hold the share `expected` of its neighbours;
    1 probes all lists and makes the result exact. Lists meet their queries in blocks of bounded size, so a list with a third of all
    rows is many tasks. Scores are double-precision products of the original vectors; ties go to the
    smaller id. Rows with a null id or an unusable vector, and vectors not of the commonest length (which have no
    product with the others), take no part; rows that share an id count once each and are never neighbours of that id; an empty table
    gives no rows. With fewer candidates than k, all that the probed lists hold are returned.
    """
    spark = table.sparkSession
    rows = table.where(F.col(f"`{key}`").isNotNull() & usable(F.col(f"`{vector}`"))).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, total = rows.where(F.size("v") == lengths["d"]), lengths["count"]
    send = spark.sparkContext.broadcast(fit(rows.select("id", "v"), total, sample, list_size))

    def assign(batches):
        index = send.value
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), index.coarse.shape[1])
            lists = nearest(x, index.coarse)[0]
            yield pd.DataFrame({"id": pdf["id"], "v": list(x), "list_no": lists.astype(np.int32), "codes": [c.tobytes() for c in index.encode(x, lists)]})

    def probe(batches):
        index = send.value
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), index.coarse.shape[1])
            picked = index.probes(pdf["id"].to_numpy(), x, k, expected)
            floors = index.floors(pdf["id"].to_numpy(), x, picked, k)
            yield pd.DataFrame({"id": pdf["id"], "v": list(x), "lists": [p.astype(np.int32) for p in picked], "floor": floors})

    held = written(rows.select("id", "v").mapInPandas(assign, "id long, v array<double>, list_no int, codes binary"), "ann-lists")
    asked = written(rows.where("q").select("id", "v").mapInPandas(probe, "id long, v array<double>, lists array<int>, floor double"), "ann-probes")
    asked = asked.select("id", "v", "floor", F.explode("lists").alias("list_no"))
    deal = held.groupBy("list_no").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(asked.groupBy("list_no").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")), "list_no")
    deal = F.broadcast(deal)  # at most MOST_LISTS rows
    one = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = held.join(deal, "list_no").withColumn("block", one("blocks")).withColumn("part", every("parts")).drop("blocks", "parts")
    right = asked.join(deal, "list_no").withColumn("part", one("parts")).withColumn("block", every("blocks")).drop("blocks", "parts")

    def search(key, own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        index = send.value
        found = []
        if len(own) and len(queries):
            codes = np.frombuffer(b"".join(own["codes"]), np.uint8).reshape(len(own), len(index.books))
            found = search_block(index, int(key[0]), own["id"].to_numpy(), np.array(own["v"].tolist()), codes, queries["id"].to_numpy(), np.array(queries["v"].tolist()), queries["floor"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    names = ["list_no", "block", "part"]
    found = left.groupBy(*names).cogroup(right.groupBy(*names)).applyInPandas(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    found = found.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)")).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
