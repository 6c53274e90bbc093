"""Media columns: content-addressed PNG payloads in tar shards, read back by ranges."""

from __future__ import annotations

import hashlib
import io
import math
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polymera.llm.common import new_folder, slices, written

#: Payload bytes come in multiples of UNIT, one 8-bit grey image row of UNIT samples each.
UNIT, FILL = 576, b"\xff"
#: A shard is closed beyond so many bytes; a reading task gets about READ_BYTES of stored bytes.
SHARD_BYTES, READ_BYTES = 256 << 20, 16 << 20
#: zlib's level for the stored form.
LEVEL = 1
#: Bytes of a PNG up to the end of its header chunk: all a header-only read fetches.
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: bytes) -> bytes:
    """Text bytes filled with FILL up to a positive multiple of UNIT."""
    rows = max(1, -(-len(text) // UNIT))
    return text + FILL * (rows * UNIT - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(data: bytes, level: int = LEVEL) -> bytes:
    """An 8-bit grey image of UNIT columns whose samples are data (a positive multiple of UNIT bytes)."""
    rows = len(data) // UNIT
    lines = np.zeros((rows, UNIT + 1), np.uint8)  # each row begins with filter 0
    lines[:, 1:] = np.frombuffer(data, np.uint8).reshape(rows, UNIT)
    head = struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first HEADER bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(stored: bytes) -> bytes:
    """The samples of an image that encode_png made; checks every chunk's CRC."""
    width, height, depth, colour = png_header(stored[:HEADER])
    at, packed = 8, []
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        data = stored[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            packed.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if (depth, colour) != (8, 0) or lines[:, 0].any():
        raise ValueError("not an image of this store")
    return lines[:, 1:].tobytes()


def feature(data: bytes) -> str:
    """Samples' count, mean, entropy in bits and a 64-bit average hash of an 8 x 8 grid of cell sums."""
    a = np.frombuffer(data, np.uint8)
    share = np.bincount(a, minlength=256) / len(a)
    share = share[share > 0]
    cells = np.add.reduceat(a.astype(np.int64), np.arange(64) * len(a) // 64)
    size = np.diff(np.append(np.arange(64) * len(a) // 64, len(a)))
    bits = cells * len(a) > int(a.sum(dtype=np.int64)) * size
    return f"n={len(a)};mean={a.mean():.4f};entropy={-(share * np.log2(share)).sum():.4f};ahash={np.packbits(bits).tobytes().hex()}"


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path of a URI (file, hdfs, s3, ...) or plain path."""
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


class _Shard:
    """A tar file being written, with the places of the payloads in it by digest."""

    def __init__(self, folder: str):
        self.path = f"{folder}/shard-{uuid.uuid4().hex}.tar"
        system, path = _file_system(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.at, self.held = system.open_output_stream(path), 0, {}

    def put(self, data: bytes) -> tuple[bytes, bytes, int, int]:
        """Digest, the stored form's digest, offset and length; equal payloads are stored once."""
        digest = hashlib.sha256(data).digest()
        if digest not in self.held:
            stored = encode_png(data)
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(stored)
            head = info.tobuf(tarfile.PAX_FORMAT)
            self.out.write(head + stored + b"\0" * (-len(stored) % 512))
            self.held[digest] = hashlib.sha256(stored).digest(), self.at + len(head), len(stored)
            self.at += len(head) + len(stored) + -len(stored) % 512
        return digest, *self.held[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def store_media(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write every whole text as a payload into tar shards under folder; one index row per input row.

    Index columns: key, n_bytes, payload_digest, media_digest, shard, offset, length. Members are named
    by the payload's digest and stored once in a shard, so a hot group of copies costs at most one
    member per shard; nothing is shuffled. Null and empty texts are one row of fill bytes. Write the
    index (`written`) before reading: each attempt of a task writes shards of its own, and only the
    committed attempt's rows name theirs, so lost executors leave at worst files that no row names.
    """
    source = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for part, texts in slices(batch, 1):
                shard = shard or _Shard(folder)
                rows = [shard.put(payload(t)) for t in texts]
                digest, media, offset, length = zip(*rows)
                new = [pa.array([len(t) for t in texts], pa.int64()), pa.array(digest, pa.binary()), pa.array(media, pa.binary()), pa.array([shard.path] * len(rows), pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *new], names=[key, "n_bytes", "payload_digest", "media_digest", "shard", "offset", "length"])
                if shard.at > shard_bytes:
                    shard.close()
                    shard = None
        if shard:
            shard.close()

    return source.mapInArrow(run, f"`{key}` {kind}, n_bytes long, payload_digest binary, media_digest binary, shard string, offset long, length long")


class _Reader:
    """Range reads that keep the last shard open."""

    def __init__(self):
        self.path, self.file = None, None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            if self.file:
                self.file.close()
            system, at = _file_system(path)
            self.path, self.file = path, system.open_input_file(at)
        return self.file.read_at(length, offset)


def media_headers(index: DataFrame) -> DataFrame:
    """Append width, height, bit_depth and colour_type, reading only the first HEADER bytes of each member."""
    new = ["width", "height", "bit_depth", "colour_type"]
    base = index.select(*[f"`{c}`" for c in index.columns if c.lower() not in new])
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            places = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length")))
            found = [png_header(reader.read(s, o, min(n, HEADER))) for s, o, n in places]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([f[i] for f in found], pa.int32()) for i in range(4)]], names=[*names, *new])

    return base.mapInArrow(run, T.StructType(base.schema.fields + [T.StructField(c, T.IntegerType()) for c in new]))


def read_media(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read every stored member back by its range and return what it holds, one row per index row.

    Columns: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, width, height, and where the bytes lie: shard, offset (its length is media_bytes). A member whose payload or stored form differs from the index raises.
    Several rows of one member in a batch read it once.
    """
    kept = index.select(F.col(f"`{key}`"), "n_bytes", "payload_digest", "media_digest", "shard", "offset", "length", "width", "height")
    kind = kept.schema[0].dataType.simpleString()
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "shard", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            seen: dict[tuple, tuple] = {}
            rows = []
            digests, medias, shards, offsets, lengths = (batch.column(i).to_pylist() for i in range(2, 7))
            for digest, media, *place in zip(digests, medias, shards, offsets, lengths):
                place = tuple(place)
                if place not in seen:
                    stored = reader.read(*place)
                    data = decode_png(stored)
                    sha, stored_sha = hashlib.sha256(data), hashlib.sha256(stored)
                    if sha.digest() != digest or stored_sha.digest() != media:
                        raise ValueError(f"{place} does not hold what its index says")
                    seen[place] = len(data), sha.hexdigest(), zlib.crc32(data[-32:]), len(stored), stored_sha.hexdigest(), feature(data)
                rows.append(seen[place])
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], batch.column(7), batch.column(8), batch.column(4), batch.column(5)], names=names)

    return kept.mapInArrow(run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, shard string, offset long")


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as a content-addressed payload, then return what header and full range reads find.

    An empty table gives no rows; null keys and repeated rows are kept; equal texts give equal values.
    """
    spark = docs.sparkSession
    index = written(store_media(docs, new_folder(spark, "media"), key, text), "media-index")
    stored = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.repartitionByRange(max(1, math.ceil(stored / READ_BYTES)), "shard", "offset")
    return read_media(media_headers(dealt), key)


def tar_members(data: bytes) -> dict[str, bytes]:
    """A shard's members by name, by the standard library's reader."""
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        return {m.name: t.extractfile(m).read() for m in t}
