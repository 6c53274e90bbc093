"""Near-duplicate classes of whole texts: tensored MinHash banding, verified on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polymera.llm.common import give_back, slices, trimmed, words, written
from polymera.operators.components import connected_components

#: Words of a shingle; documents are linked at SIMILAR percent or more of shared shingles.
SHINGLE, SIMILAR = 5, 75
#: Two collections of TABLES sub-keys, each of BAND MinHash values. A table's key is a pair of sub-keys,
#: one from each: 12 x 12 keys of 4 values from 48 values instead of 576. A pair at similarity 0.75
#: shares no key with probability 1e-4.
TABLES, BAND, SEED = 12, 2, 77
#: Bytes and number of shingle sets compared at once: a larger group is dealt in blocks to many tasks.
BLOCK_BYTES, BLOCK_SETS = 24 << 20, 256
#: Bits for each class of the filter that spares a second look at texts, and its least and most bits (as
#: powers of 2): with more classes it lets more through, which the join on digests then removes.
CLASS_BITS, LEAST_BITS, MOST_BITS = 12, 20, 29

_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes) -> np.ndarray:
    """Sorted different 64-bit hashes of a text's word shingles; a shorter text's words are one shingle."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(found), seed=len(found))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(w) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h += w[i : i + n] * _POWERS[i]
    return np.unique(_mixed(h))


def _multipliers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, 2 * TABLES * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sub_keys(found: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The 2 x TABLES sub-keys of a non-empty set."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(least, (found[None, at : at + 4096] * multipliers[:, None]).min(1), out=least)
    bands = least.reshape(2 * TABLES, BAND)
    return _mixed(bands[:, 0] * _POWERS[0] + bands[:, 1] * _POWERS[1] + np.arange(2 * TABLES, dtype=np.uint64)).view(np.int64)


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n_shingles, digest of the set, sub-keys) of every row; an empty set has neither digest nor keys."""
    source = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers()
        for batch in batches:
            for part, texts in slices(batch, 1):
                sets = [shingles(t) for t in texts]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                keys = [sub_keys(s, multipliers) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n_shingles", "digest", "keys"])

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(trimmed(run), f"id {kind}, n_shingles long, digest binary, keys array<long>")


def _places(digests: list[bytes], bits: int) -> np.ndarray:
    """Four bit positions of the filter for each digest."""
    raw = np.frombuffer(b"".join(digests), np.uint32).reshape(len(digests), 4)
    return raw % np.uint32(bits)


def _filter_of(members: DataFrame) -> np.ndarray:
    """A Bloom filter over the members' digests, sized by their number within bounds, made in the tasks and merged by words."""
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (CLASS_BITS * members.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 64, np.uint64)
        for batch in batches:
            if batch.num_rows:
                at = _places(batch.column(0).to_pylist(), size).ravel()
                np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & np.uint32(63)).astype(np.uint64))
        used = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(bits[used].view(np.int64), pa.int64())], names=["i", "word"])

    rows = members.select("digest").mapInArrow(trimmed(run), "i int, word long").groupBy("i").agg(F.bit_or("word").alias("word"))
    out = np.zeros(size // 64, np.uint64)
    table = rows.toArrow()
    out[table.column("i").to_numpy()] = table.column("word").to_numpy().view(np.uint64)
    return out


def member_sets(docs: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, set) of the classes in members (digest, first_id): sets are made anew for one row of each.

    A filter of bounded size, over class digest and first id, spares most other texts; the join on digest
    removes what it lets through in error, so texts are never shuffled.
    """
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_filter_of(members.select(_tag(F.col("digest"), F.col("first_id")).alias("digest"))))
    source = docs.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = bits.value
        for batch in batches:
            for part, texts in slices(batch, 1):
                out, made = [], []
                for name, t in zip(part.column(0).to_pylist(), texts):
                    found = shingles(t)
                    if not len(found):
                        continue
                    digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    at = _places([hashlib.md5(digest + (name or "").encode()).digest()], 64 * len(bloom))[0]
                    if all(int(bloom[p >> 6]) >> int(p & 63) & 1 for p in at):
                        out.append(digest)
                        made.append(found.tobytes())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(made, pa.binary())], names=["digest", "shingles"])

    return source.mapInArrow(trimmed(run), "digest binary, shingles binary")


def _tag(digest: Column, first_id: Column) -> Column:
    return F.unhex(F.md5(F.concat(digest, F.coalesce(first_id.cast("string"), F.lit("")).cast("binary"))))


def candidate_stars(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (digest, hub) from each class to the least class of every table key it shares, and (digest, weight).

    classes has (digest, keys). Only sub-keys that occur twice are paired into table keys, so documents
    that resemble none cost 2 x TABLES rows rather than TABLES squared. weight counts the company in all keys.
    """
    sub = classes.select("digest", F.posexplode("keys").alias("place", "sub"))
    shared = sub.groupBy("place", "sub").count().where("count > 1").select("place", "sub")
    left = sub.join(shared, ["place", "sub"], "left_semi").groupBy("digest").agg(F.collect_list(F.when(F.col("place") < TABLES, F.col("sub"))).alias("a"), F.collect_list(F.when(F.col("place") >= TABLES, F.col("sub"))).alias("b"))
    pairs = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    keys = written(left.where("size(a) > 0 AND size(b) > 0").select("digest", F.explode(pairs).alias("key")), "near-keys")
    hubs = keys.groupBy("key").agg(F.min("digest").alias("hub"), F.count("*").alias("n")).where("n > 1")
    met = keys.join(hubs, "key").groupBy("digest", "hub").agg(F.sum("n").alias("n"))
    met = written(met, "near-stars")
    return met.where("digest <> hub").select("digest", "hub"), met.groupBy("digest").agg(F.sum("n").alias("weight"))


def links_within(sets: list[np.ndarray], keys: np.ndarray, start: np.ndarray, order: np.ndarray, similar: int = SIMILAR) -> list[tuple[int, int]]:
    """Links enough to connect what true links connect among sets that share a table key.

    keys are the sets' sub-keys, start their components so far. Sets are taken in the given order, each
    against all later ones of other components that share a key with it, so pairs already connected are
    never compared and none between components is missed.
    """
    label, found = start.copy(), []
    sizes = np.array([len(s) for s in sets])
    at = np.concatenate(([0], np.cumsum(sizes)))
    every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    rank = np.empty(len(sets), np.int64)
    rank[order] = np.arange(len(sets))
    for x in order:
        others = np.flatnonzero((label != label[x]) & (rank > rank[x]) & (100 * np.minimum(sizes, sizes[x]) >= similar * np.maximum(sizes, sizes[x])))
        if not len(others):
            continue
        same = keys[others] == keys[x]
        others = others[same[:, :TABLES].any(1) & same[:, TABLES:].any(1)]
        for y0 in range(0, len(others), 256):
            ys = others[y0 : y0 + 256]
            ys = ys[label[ys] != label[x]]
            if not len(ys):
                continue
            flat = np.concatenate([every[at[y] : at[y + 1]] for y in ys])
            place = np.searchsorted(sets[x], flat)
            hit = sets[x][np.minimum(place, len(sets[x]) - 1)] == flat
            both = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(sizes[ys])[:-1])))
            for y in ys[100 * both >= similar * (sizes[x] + sizes[ys] - both)]:
                if label[y] != label[x]:
                    found.append((int(x), int(y)))
                    label[label == label[y]] = label[x]
    return found


def _linked(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates("digest").reset_index(drop=True)
    sets = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
    keys = np.array(pdf["keys"].tolist(), np.int64).reshape(len(pdf), 2 * TABLES)
    start = pd.factorize(pdf["label"])[0]
    order = np.lexsort((np.arange(len(pdf)), -pdf["weight"].to_numpy()))
    pairs = links_within(sets, keys, start, order)
    del sets, keys
    give_back()
    return pd.DataFrame({"src": [pdf["digest"][x] for x, _ in pairs], "dst": [pdf["digest"][y] for _, y in pairs]}, columns=["src", "dst"])


def true_links(members: DataFrame, sets: DataFrame, block_bytes: int = BLOCK_BYTES, block_sets: int = BLOCK_SETS) -> DataFrame:
    """Links (src, dst) that connect what true links connect, from members (digest, coarse, n_shingles, keys, weight) and their sets.

    Each coarse component is compared in blocks of about block_bytes or block_sets sets, whichever is less. Where one has several blocks, its
    heaviest class goes into each and so joins them; then what is still outside the component's largest
    class meets every block, in blocks itself. No task holds more than two blocks.
    """
    size = F.sum(F.col("n_shingles") * 8 + 400)
    coarse = members.groupBy("coarse").agg(F.greatest(size / block_bytes, F.count("*") / block_sets).alias("load"), F.max_by("digest", F.struct("weight", "digest")).alias("hub"))
    coarse = written(coarse.select("coarse", F.greatest(F.lit(1), F.ceil("load")).cast("int").alias("blocks"), "hub"), "near-blocks")
    dealt = members.join(coarse, "coarse").join(sets, "digest").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    everywhere = F.when((F.col("digest") == F.col("hub")) & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    columns = ["digest", "keys", "weight", "shingles", "label"]
    first = dealt.withColumn("label", F.col("digest")).withColumn("block", F.explode(everywhere)).select("coarse", "block", *columns)
    edges = written(first.groupBy("coarse", "block").applyInPandas(_linked, "src binary, dst binary"), "near-links")
    if not coarse.where("blocks > 1").limit(1).count():
        return edges
    fine = connected_components(edges)
    large = dealt.where("blocks > 1").join(fine, dealt["digest"] == fine["id"], "left").withColumn("label", F.coalesce("component", "digest")).drop("id", "component")
    sizes = large.groupBy("coarse", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("coarse").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    outside = large.join(main, "coarse").where(F.col("label") != F.col("main"))
    rest = written(outside.withColumn("bytes", F.col("n_shingles") * 8 + 400).drop("main"), "near-rest")
    parts = rest.groupBy("coarse").agg(F.greatest(F.lit(1), F.ceil(F.sum("bytes") / block_bytes), F.ceil(F.count("*") / block_sets)).cast("int").alias("parts"))
    guests = rest.join(parts, "coarse").withColumn("part", F.pmod(F.xxhash64("digest", F.lit(1)), F.col("parts")).cast("int"))
    guests = guests.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("coarse", "block", "part", *columns)
    hosts = large.join(parts, "coarse").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("coarse", "block", "part", *columns)
    more = hosts.unionByName(guests).groupBy("coarse", "block", "part").applyInPandas(_linked, "src binary, dst binary")
    return written(edges.unionByName(more), "near-links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row: its set's size and the least id its links reach.

    Rows with equal sets are one class, compared once. An empty set (null, empty or blank text) is linked
    with nothing. A component without any id has a null component_id and is kept; repeated rows of an id
    are judged by their own texts, and all rows that hold the least id are kept. An empty table gives no
    rows. Recall: pairs at 0.75 share a table key with probability 0.9999, and more similar ones more surely;
    what is linked is always true.
    """
    rows = written(signatures(docs, key, text), "near-rows")
    classes = written(rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")), "near-classes")
    stars, weights = candidate_stars(classes)
    coarse = connected_components(stars, "digest", "hub")
    members = classes.join(coarse, classes["digest"] == coarse["id"]).drop("id").withColumnRenamed("component", "coarse").join(weights, "digest")
    members = written(members, "near-members")
    sets = member_sets(docs, members, key, text)
    links = true_links(members, sets)
    fine = connected_components(links)
    linked = classes.join(fine, classes["digest"] == fine["id"], "left").select("digest", "first_id", F.coalesce("component", "digest").alias("component"))
    least = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = written(linked.join(least, "component").select("digest", "component_id"), "near-named")
    out = rows.join(named, "digest", "left").withColumn("component_id", F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", kept.alias("kept"))
