"""Identifiers: generators, checks and their parts."""

from __future__ import annotations

import os
import time
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Crockford's base 32 and the alphabet of nanoid.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
NANOID = "_-0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ULID_PATTERN = f"^[0-7][{CROCKFORD}]{{25}}$"
CUID2_PATTERN = "^[a-z][0-9a-z]{23}$"
NANOID_PATTERN = "^[A-Za-z0-9_-]{21}$"


def uuid_v4() -> Column:
    return F.uuid()


def _v7() -> str:
    ms, rand = int(time.time() * 1000), int.from_bytes(os.urandom(10), "big")
    return str(uuid.UUID(int=(ms << 80) | (0x7 << 76) | ((rand >> 62 & 0xFFF) << 64) | (0b10 << 62) | (rand & ((1 << 62) - 1))))


def _ulid() -> str:
    n = (int(time.time() * 1000) << 80) | int.from_bytes(os.urandom(10), "big")
    return "".join(CROCKFORD[n >> 5 * i & 31] for i in range(25, -1, -1))


def _cuid2() -> str:
    raw = os.urandom(24)
    return "abcdefghijklmnopqrstuvwxyz"[raw[0] % 26] + "".join("0123456789abcdefghijklmnopqrstuvwxyz"[b % 36] for b in raw[1:])


def _generated(make) -> Column:
    """A new identifier for each row; not deterministic."""
    run = F.pandas_udf(lambda s: pd.Series([make() for _ in s]), "string").asNondeterministic()
    return run(F.lit(1) + F.rand() * 0)


def uuid_v7() -> Column:
    return _generated(_v7)


def ulid() -> Column:
    return _generated(_ulid)


def cuid2() -> Column:
    return _generated(_cuid2)


def nanoid(size: int = 21) -> Column:
    return _generated(lambda: "".join(NANOID[b & 63] for b in os.urandom(size)))


def is_uuid(s: Column) -> Column:
    return s.rlike(UUID_PATTERN)


def is_ulid(s: Column) -> Column:
    return s.rlike(ULID_PATTERN)


def is_cuid2(s: Column) -> Column:
    return s.rlike(CUID2_PATTERN)


def is_nanoid(s: Column) -> Column:
    return s.rlike(NANOID_PATTERN)


def id_type(s: Column) -> Column:
    return F.when(is_uuid(s), "uuid").when(is_ulid(s), "ulid").when(is_cuid2(s), "cuid2").when(is_nanoid(s), "nanoid").otherwise("unknown")


def uuid_version(s: Column) -> Column:
    return F.when(is_uuid(s), F.conv(F.substring(s, 15, 1), 16, 10).cast("int"))


def ulid_timestamp(s: Column) -> Column:
    """Milliseconds since the epoch in the first ten characters."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: (F.instr(F.lit(CROCKFORD), F.substr(F.upper(s), i, F.lit(1))) - 1).cast("long"))
    return F.when(is_ulid(F.upper(s)), F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: acc * 32 + d))
