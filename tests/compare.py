"""Rows of both engines in one form, in an order of their own."""

import math


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return (0,)
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, int | float):
        return (1, float(v))
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return (2, str(v))


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(duck, sql):
    names = sorted(duck.sql(sql).columns)
    quoted = ", ".join(f'"{n}"' for n in names)
    return names, sorted((tuple(map(plain, r)) for r in duck.sql(f"SELECT {quoted} FROM ({sql})").fetchall()), key=repr)
