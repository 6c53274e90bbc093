"""SentencePiece encoding and decoding, and segmentations sampled without replacement by perturbed A* search."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polymera.llm.common import slices, trimmed

#: Segmentations of a text, the seed beside each row's key, and the sharpness of piece probabilities.
SAMPLES, SEED, SHARPNESS = 2, 3, 1.0
#: A piece of rank r has a probability in proportion to 1 / (r + FLAT): the model's own scores are ranks.
FLAT = 10.0
#: Bytes and rows of texts whose lattices are held at once.
SLICE, ROWS = 3 << 19, 1_024

_SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_EDGE = 1 << 24  # an edge that spells a character in bytes: this plus its code point
_TILT = 16.0
_NONE, _BEGINS = -1, -2
_loaded: dict[tuple, "Pieces"] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """A model's pieces in a hash table by their characters, and their probabilities."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.model, n = model, model.get_piece_size()
        self.byte_ids = np.full(256, -1, np.int32)
        ids, texts = [], []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                ids.append(i)
                texts.append(piece)
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        if any(_SPACE in t.lstrip(_SPACE) for t in texts):
            raise ValueError("pieces of the model span words")
        rank = np.arange(n, dtype=float)
        p = 1 / (rank + FLAT)
        self.p = (p / p.sum()) ** sharpness
        self.longest = max(map(len, texts))
        # beside the pieces (their ids), their beginnings (_BEGINS), at which a search for longer ones goes on
        entries = {self._hash(t[:n]): _BEGINS for t in texts for n in range(1, len(t))}
        whole = {self._hash(t): i for i, t in zip(ids, texts)}
        if len(whole) < len(ids):
            raise ValueError("two pieces share a hash")
        entries |= whole
        self.mask = np.uint64((1 << 20) - 1)
        self.keys, self.ids = np.zeros(1 << 20, np.uint64), np.full(1 << 20, _NONE, np.int32)
        hashes = np.array(list(entries), np.uint64)
        for h, at, i in zip(hashes, (_mix(hashes) & self.mask).tolist(), entries.values()):
            while self.ids[at] != _NONE:
                at = (at + 1) & int(self.mask)
            self.keys[at], self.ids[at] = h, i
        self.longest_run = self._longest_run()
        self.alone = "".join(c for c in "\n\t\r" if not any(c in t for t in texts))
        self.chunk = re.compile(f"{_SPACE}|[{self.alone}]| *[^ {_SPACE}{self.alone}]+| +" if self.alone else f"{_SPACE}| *[^ {_SPACE}]+| +")

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _longest_run(self) -> int:
        free = np.flatnonzero(self.ids == _NONE)
        return int(np.diff(free).max())

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, _BEGINS where only longer pieces begin so, _NONE where none does."""
        at = _mix(h) & self.mask
        out = np.where(self.keys[at] == h, self.ids[at], _NONE)
        todo = np.flatnonzero((out == _NONE) & (self.ids[at] != _NONE))
        for _ in range(self.longest_run):
            if not len(todo):
                break
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
            hit = self.keys[at[todo]] == h[todo]
            out[todo[hit]] = self.ids[at[todo[hit]]]
            todo = todo[~hit]
            todo = todo[self.ids[at[todo]] != _NONE]
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of a segmentation: pieces and spelled bytes joined, the added first space taken away."""
        out = bytearray()
        byte = {int(i): b for b, i in enumerate(self.byte_ids)}
        for i in ids:
            out += bytes([byte[i]]) if i in byte else self.model.id_to_piece(int(i)).replace(_SPACE, " ").encode()
        return out.decode("utf-8", "replace")[1:]


def load_pieces(path: str, sharpness: float = SHARPNESS) -> Pieces:
    if (path, sharpness) not in _loaded:
        _loaded[path, sharpness] = Pieces(path, sharpness)
    return _loaded[path, sharpness]


class Lattice:
    """Lattices of different chunks side by side: at each character the edges out of it, by length."""

    def __init__(self, pieces: Pieces, chunks: list[str]):
        n = np.array([len(c) for c in chunks])
        self.start = np.cumsum(n) - n
        self.size = n
        # a text's own U+2581 is a chunk by itself, spelled in bytes; a space is that character in pieces
        raw = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        spelled = raw == ord(_SPACE)
        cp = np.where(raw == ord(" "), ord(_SPACE), raw).astype(np.uint64)
        total, longest = len(cp), pieces.longest
        left = np.repeat(self.start + n, n) - np.arange(total)
        # rows stand in order of the characters left, so that what follows is ready level by level
        order = np.argsort(np.minimum(left, 65_535).astype(np.uint16), kind="stable")
        if len(left) and left.max() >= 65_535:
            order = np.argsort(left, kind="stable")
        self.row = np.empty(total, np.int64)
        self.row[order] = np.arange(total)
        edges, weights = np.empty((longest, total), np.int32), np.zeros((longest, total))
        here, h = np.arange(total), np.zeros(total, np.uint64)
        for k in range(longest):
            going = left[here] > k
            here, h = here[going], h[going]
            h = h * _BASE + cp[here + k] + np.uint64(1)
            found = pieces.find(h)
            if k == 0:
                found[spelled[here]] = _NONE
            piece = np.flatnonzero(found >= 0)
            at, ids = self.row[here[piece]], found[piece]
            edges[k] = _NONE
            edges[k][at] = ids
            weights[k][at] = pieces.p[ids] * _TILT ** (k + 1)
            going = found != _NONE
            here, h = here[going], h[going]
            if not len(here):
                break
        longest = k + 1
        alone = np.flatnonzero(edges[0][self.row] < 0)
        edges[0][self.row[alone]] = raw[alone].astype(np.int32) + _BYTE_EDGE
        weights[0][self.row[alone]] = (1 / len(pieces.p)) ** _utf8_sizes(raw[alone]) * _TILT
        # Sums of what may follow, with one more place for each chunk's end. Weights are tilted by a factor
        # for each character, the same for all segmentations, so that they stay near 1.
        place = np.arange(total) + np.repeat(np.arange(len(chunks)), n)
        after = np.zeros(total + len(chunks))
        after[self.start + n + np.arange(len(chunks))] = 1.0
        place, first = place[order], 0
        for t, rows in enumerate(np.bincount(left)[1:].tolist(), 1):
            at, end, m = place[first : first + rows], first + rows, min(t, longest)
            s = np.zeros(rows)
            for k in range(m):
                weights[k][first:end] *= after[at + (k + 1)]
                s += weights[k][first:end]
            for k in range(m):
                weights[k][first:end] /= s
            after[at] = s
            first = end
            if t % 64 == 0:  # only the ratios of what follows matter: scale before it leaves the numbers' range
                for k in range(m):
                    after[at + k] /= s
        #: By length and row: the edge, and its share of what may follow.
        self.edge, self.share = edges[:longest], weights[:longest]
        #: By row: the likeliest edge and its share.
        self.best = np.zeros(total, np.int8)
        self.best_share = self.share[0].copy() if longest else np.zeros(0)
        for k in range(1, longest):
            better = self.share[k] > self.best_share
            self.best[better] = k
            np.maximum(self.best_share, self.share[k], out=self.best_share)

    def draw(self, row: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges' lengths less 1 and shares for uniform numbers: the likeliest edge has the first part of [0, 1), the others the rest."""
        k, p = self.best[row].astype(np.int64), self.best_share[row]
        other = np.flatnonzero(u >= p)
        if len(other):
            rest = self.share[:, row[other]]
            rest[k[other], np.arange(len(other))] = 0
            running = np.cumsum(rest, axis=0)
            v = (u[other] - p[other]) / (1 - p[other]) * running[-1]
            some = running[-1] > 0  # else rounding alone led here
            pick = np.minimum((running <= v).sum(0), len(rest) - 1)
            pick = np.where(rest[pick, np.arange(len(other))] > 0, pick, rest.argmax(0))
            k[other[some]] = pick[some]
            p[other[some]] = rest[pick, np.arange(len(other))][some]
        return k, p


def _utf8_sizes(cp: np.ndarray) -> np.ndarray:
    return 1 + (cp >= 0x80).astype(int) + (cp >= 0x800) + (cp >= 0x10000)


def _uniform(seeds: np.ndarray, sample: int, token: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) by row key, sample, chunk and place within it: no order or batch of rows matters."""
    x = seeds + np.uint64(sample * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF) + token.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) + place.astype(np.uint64) * np.uint64(0xABC98388FB8FAC03)
    return ((_mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


class Paths:
    """Steps of one segmentation of each text in order: (chunk's number in all texts, place in it, length, edge, probability).

    Columns must come with each chunk's steps in order of place; chunks may come in any.
    """

    def __init__(self, number, place, length, edge, p):
        order = np.argsort(number, kind="stable")
        self.number, self.place, self.length, self.edge, self.p = (a[order] for a in (number, place, length, edge, p))


def _walk(lattice: Lattice, seeds: np.ndarray, sample: int, token: np.ndarray, chunk: np.ndarray, number: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Draw on from a place of each chunk to its end: columns as in Paths. seeds and token are by number."""
    out = []
    at, left = lattice.start[chunk] + place, lattice.size[chunk] - place
    while True:
        on = left > 0
        if not on.all():
            at, left, number, place = at[on], left[on], number[on], place[on]
        if not len(number):
            break
        u = _uniform(seeds[number], sample, token[number], place)
        row = lattice.row[at]
        k, p = lattice.draw(row, u)
        out.append((number, place, k + 1, lattice.edge[k, row], p))
        k += 1
        place, at, left = place + k, at + k, left - k
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]


def _gumbel(log_mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The largest of the Gumbels under nodes of this mass, given that it is at most bound."""
    with np.errstate(divide="ignore", over="ignore"):
        out = log_mass - np.log(np.exp(np.clip(log_mass - bound, -700, 700)) - np.log(u))
    return np.where(np.isneginf(log_mass), -np.inf, np.minimum(out, bound))


class Frontier:
    """Unopened nodes of the search: at a step of an emitted path, the edges not yet taken there."""

    def __init__(self):
        self.doc, self.value, self.mass, self.path, self.step = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, doc, value, mass, path, step):
        keep = np.isfinite(value)
        for name, a in (("doc", doc), ("value", value), ("mass", mass), ("path", np.full(len(doc), path)), ("step", step)):
            setattr(self, name, np.concatenate((getattr(self, name), a[keep])))

    def keep(self, which: np.ndarray) -> None:
        for name in ("doc", "value", "mass", "path", "step"):
            setattr(self, name, getattr(self, name)[which])

    def best(self) -> np.ndarray:
        """Index of each text's node of the greatest value."""
        top = np.full(int(self.doc.max(initial=-1)) + 1, -np.inf)
        np.maximum.at(top, self.doc, self.value)
        hit = np.flatnonzero(self.value == top[self.doc])
        return hit[np.unique(self.doc[hit], return_index=True)[1]]


def sample_texts(pieces: Pieces, texts: list[bytes], seeds: np.ndarray, k: int) -> list[tuple[int, int, np.ndarray, float, float, float]]:
    """(text, rank, piece ids, log probability, perturbed value, log inclusion) of up to k different segmentations of each text.

    The tree of prefixes is searched best first by perturbed log probability. A node's mass is known
    exactly from the lattice's sums, so the first leaf reached is a text's best, and each further one
    opens the best unopened node; nodes at one step of a path that are still closed are kept as one.
    inclusion is the chance of a value over the best one that was not emitted.
    """
    ids_of: dict[str, int] = defaultdict()
    ids_of.default_factory = ids_of.__len__
    rows = [list(map(ids_of.__getitem__, pieces.chunk.findall(" " + d))) if (d := t.decode("utf-8", "replace")) else [] for t in texts]
    n = np.array([len(r) for r in rows])
    chunk = np.fromiter(chain.from_iterable(rows), np.int64, int(n.sum()))
    doc = np.repeat(np.arange(len(texts)), n)
    first_token = np.cumsum(n) - n
    number = np.arange(len(chunk))
    token = number - np.repeat(first_token, n)
    every = np.arange(len(texts))
    if not len(chunk):
        return [(int(i), 1, np.zeros(0, np.int32), 0.0, 0.0, 0.0) for i in every]
    lattice = Lattice(pieces, list(ids_of))
    seed_of = seeds[doc]
    value = -np.log(-np.log(_uniform(seeds, 0, np.zeros(len(texts), np.int64), np.full(len(texts), 1 << 20))))
    paths: list[Paths] = []
    results: list[list] = []
    frontier = Frontier()
    chosen = every
    path = Paths(*_walk(lattice, seed_of, 0, token, chunk, number, np.zeros(len(chunk), np.int64)))
    fresh = np.ones(len(path.number), bool)  # steps whose closed nodes are not on the frontier yet
    taken: dict[tuple[int, int], list[int]] = {}
    for rank in range(1, k + 1):
        paths.append(path)
        path_doc = doc[path.number]
        starts, ends = np.searchsorted(path_doc, chosen), np.searchsorted(path_doc, chosen, "right")
        sums = np.concatenate(([0.0], np.cumsum(np.log(path.p))))
        results.append([chosen, sums[ends] - sums[starts], value[chosen], starts, ends])
        begun = np.zeros(len(texts))
        begun[chosen] = sums[starts]
        new = np.flatnonzero(fresh & (path.p < 1 - 1e-12))
        of_new, number_new = path_doc[new], path.number[new]
        mass = sums[new] - begun[of_new] + np.log1p(-path.p[new])
        u = _uniform(seed_of[number_new], rank + 1000, token[number_new], path.place[new])
        frontier.add(of_new, _gumbel(mass, value[of_new], u), mass, rank - 1, new)
        if rank == k:
            break
        best = frontier.best()
        if not len(best):
            break
        d, v, m, of, step = (getattr(frontier, name)[best] for name in ("doc", "value", "mass", "path", "step"))
        rest_mass = np.full(len(best), -np.inf)
        heads, turn = [], []
        for j in range(len(best)):
            p, s = paths[of[j]], step[j]
            which = p.number[s]
            at = lattice.row[lattice.start[chunk[which]] + p.place[s]]
            open_ = lattice.share[:, at].copy()
            gone = taken.setdefault((int(of[j]), int(s)), [int(p.length[s]) - 1])
            open_[gone] = 0
            u = _uniform(seeds[d[j : j + 1]], rank + 2000, token[which : which + 1], p.place[s : s + 1])[0]
            whole = open_.sum()
            pick = int(min(np.searchsorted(np.cumsum(open_), u * whole), len(open_) - 1))
            while open_[pick] <= 0:
                pick -= 1
            gone.append(pick)
            if whole - open_[pick] > 1e-15:
                rest_mass[j] = m[j] + np.log((whole - open_[pick]) / whole)
            heads.append((of[j], np.searchsorted(p.number, first_token[d[j]]), s))
            turn.append((which, p.place[s], pick + 1, lattice.edge[pick, at], lattice.share[pick, at]))
        # what stays closed at the opened steps
        u = _uniform(seeds[d], rank + 3000, np.zeros(len(d), np.int64), step)
        rest_value = _gumbel(rest_mass, v, u)
        closed = np.ones(len(frontier.doc), bool)
        closed[best] = False
        frontier.keep(closed)
        for which in np.unique(of):
            here = of == which
            frontier.add(d[here], rest_value[here], rest_mass[here], which, step[here])
        head = [np.concatenate([getattr(paths[o], c)[a:s] for o, a, s in heads]) for c in ("number", "place", "length", "edge", "p")]
        turned = [np.array(c) for c in zip(*turn)]
        after = np.full(len(texts), len(chunk))
        after[d] = turned[0] + 1
        later = number[number >= after[doc]]
        from_place = np.concatenate((turned[1] + turned[2], np.zeros(len(later), np.int64)))
        going = np.concatenate((turned[0], later))
        order = np.argsort(going, kind="stable")
        tail = _walk(lattice, seed_of, rank, token, chunk[going[order]], going[order], from_place[order])
        value = value.copy()
        value[d] = v
        chosen = np.sort(d)
        path = Paths(*[np.concatenate((h, t, r)) for h, t, r in zip(head, turned, tail)])
        # steps of the shared head and the turn itself are on the frontier already
        turn_number, turn_place = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        turn_number[d], turn_place[d] = turned[0], turned[1]
        at_doc = doc[path.number]
        fresh = (path.number > turn_number[at_doc]) | ((path.number == turn_number[at_doc]) & (path.place > turn_place[at_doc]))
    threshold = np.full(len(texts), -np.inf)
    np.maximum.at(threshold, frontier.doc, frontier.value)
    out = []
    for rank, ((which, log_p, v, starts, ends), p) in enumerate(zip(results, paths), 1):
        ids, offsets = _flat_ids(pieces, p.edge)
        for d, lp, g, a, b in zip(which, log_p, v, starts, ends):
            gap = lp - threshold[d]
            log_inclusion = float(gap) if gap < -30 else float(np.log(-np.expm1(-np.exp(min(gap, 700)))))
            out.append((int(d), rank, ids[offsets[a] : offsets[b]], float(lp), float(g), log_inclusion))
    return out


def _flat_ids(pieces: Pieces, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all edges in order, spelled characters as their bytes, and where each edge's begin."""
    spelled = edge >= _BYTE_EDGE
    cp = np.where(spelled, edge - _BYTE_EDGE, 0).astype(np.int64)
    n = np.where(spelled, _utf8_sizes(cp), 1)
    offsets = np.concatenate(([0], np.cumsum(n)))
    ids = np.empty(offsets[-1], np.int32)
    ids[offsets[:-1][~spelled]] = edge[~spelled]
    for i in np.flatnonzero(spelled & (cp >= 0x80)):
        ids[offsets[i] : offsets[i + 1]] = pieces.byte_ids[list(chr(cp[i]).encode("utf-8", "replace").ljust(n[i], b"?"))]
    low = np.flatnonzero(spelled & (cp < 0x80))
    ids[offsets[low]] = pieces.byte_ids[cp[low]]
    return ids, offsets


def sample_segmentations(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, seed: int = SEED, sharpness: float = SHARPNESS) -> DataFrame:
    """(key, rank, n_pieces, pieces, log_prob, perturbed, log_inclusion): up to `samples` different segmentations of every whole text.

    The randomness of a row depends on its key and the seed alone, so repeated rows give the same again
    and retried tasks too. A text with fewer segmentations gives all it has; null and empty texts have
    one, of no pieces. Null keys share a seed. No row meets another.
    """
    source = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{key}`").cast("string"), F.lit(seed)).alias("seed"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(path, sharpness)
        for batch in batches:
            for part, texts in slices(batch, 2, ROWS, SLICE):
                seeds = part.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
                rows = sample_texts(pieces, texts, _mix(seeds), samples)
                if not rows:
                    continue
                which, rank, ids, log_p, value, inclusion = zip(*rows)
                sizes = np.array([len(i) for i in ids])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which)), pa.array(rank, pa.int32()), pa.array(sizes, pa.int32()), lists, pa.array(log_p, pa.float64()), pa.array(value, pa.float64()), pa.array(inclusion, pa.float64())], names=["key", "rank", "n_pieces", "pieces", "log_prob", "perturbed", "log_inclusion"])

    kind = source.schema[0].dataType
    numbers = [("rank", T.IntegerType()), ("n_pieces", T.IntegerType()), ("pieces", T.ArrayType(T.IntegerType())), ("log_prob", T.DoubleType()), ("perturbed", T.DoubleType()), ("log_inclusion", T.DoubleType())]
    schema = T.StructType([T.StructField("key", kind), *[T.StructField(c, t) for c, t in numbers]])
    return source.mapInArrow(trimmed(run), schema).withColumnRenamed("key", key)


def encode_pieces(docs: DataFrame, path: str, text: str = "text", out: str = "pieces") -> DataFrame:
    """Append the library's own segmentation of every whole text as piece ids; a null text gives null, an empty one none.

    An input column named like the new one gives way, whatever its case; repeated rows are encoded each.
    """
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_pieces(path).model
        for batch in batches:
            ids = [None if t is None else model.encode(t) for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(ids, pa.list_(pa.int32()))], names=[*kept, out])

    return source.mapInArrow(run, T.StructType(source.schema.fields[: len(kept)] + [T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode_pieces(rows: DataFrame, path: str, pieces: str = "pieces", out: str = "text") -> DataFrame:
    """Append the text that each row's piece ids spell; null ids give null."""
    kept = [c for c in rows.columns if c.lower() != out.lower()]
    source = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{pieces}`").alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_pieces(path)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, out])

    return source.mapInArrow(run, T.StructType(source.schema.fields[: len(kept)] + [T.StructField(out, T.StringType())]))
