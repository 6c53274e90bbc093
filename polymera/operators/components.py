"""Connected components over edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polymera.storage import written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(id, component) of every end of an edge; component is the least id that undirected paths reach.

    In each round every node points at its least neighbour, pointers are followed twice more, and the
    edges are contracted to their ends' pointers, so edges inside a found part are never read again and
    their number falls by at least half a round. Every round is a written table. Minima combine before
    the shuffle, so a hub's edges are never gathered in one task. Edges with a null end are left out; an
    edge from a node to itself is a component of one.
    """
    a_b = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    e = written(a_b.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    for _ in range(max_rounds):
        point = e.unionAll(e.select("b", "a")).groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("to"))
        point = written(point, "pointers")
        for _ in range(2):
            point = point.join(point.select(F.col("id").alias("next_id"), F.col("to").alias("next")), F.col("to") == F.col("next_id")).select("id", F.col("next").alias("to"))
        point = written(point, "pointers")
        if found is None:
            found = point.select("id", F.col("to").alias("component"))
        else:
            found = found.join(point, found["component"] == point["id"], "left").select(found["id"], F.coalesce("to", "component").alias("component"))
            found = written(found, "components")
        to_a, to_b = (point.select(F.col("id").alias(f"id_{c}"), F.col("to").alias(f"to_{c}")) for c in "ab")
        e = e.join(to_a, e["a"] == F.col("id_a")).join(to_b, F.col("b") == F.col("id_b")).where("to_a <> to_b")
        e = written(e.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        if not e.limit(1).count():
            return found
    raise RuntimeError(f"no fixed point in {max_rounds} rounds")
