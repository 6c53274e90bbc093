"""Graph patterns: MATCH compiled to joins of edge and node tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hops that an open range `*` may take.
MOST_HOPS = 10

_NODE = re.compile(r"\(\s*(\w+)?\s*(?::\s*(\w+))?\s*\)")
_EDGE = re.compile(r"(<)?-\s*\[\s*(\w+)?\s*(?::\s*([\w|]+))?\s*(\*\s*(?:\d*\s*(?:\.\.\s*\d*)?)?)?\s*\]\s*-\s*(>)?")


@dataclass
class Hop:
    """One edge of a pattern between two node variables."""

    left: str
    right: str
    name: str | None
    labels: tuple[str, ...]
    least: int
    most: int
    direction: str


def parse(pattern: str) -> tuple[list[Hop], dict[str, str]]:
    """Hops and node labels of patterns like (a:Person)-[:knows*1..2]->(b), (b)<-[x:likes]-(c)."""
    hops, labels, unnamed = [], {}, 0
    at = 0
    text = pattern.strip()
    while at < len(text):
        left = None
        while True:
            node = _NODE.match(text, at)
            if not node:
                raise ValueError(f"expected a node at {text[at:]!r}")
            name = node[1]
            if not name:
                unnamed += 1
                name = f"_n{unnamed}"
            if node[2]:
                labels[name] = node[2]
            at = node.end()
            if left is not None:
                hops.append(Hop(left, name, *edge_parts))
            while at < len(text) and text[at].isspace():
                at += 1
            edge = _EDGE.match(text, at)
            if not edge:
                break
            least = most = 1
            if edge[4]:
                span = edge[4].replace(" ", "")[1:]
                low, dots, high = span.partition("..")
                least = int(low) if low else 1
                most = int(high) if high else (MOST_HOPS if dots or not low else least)
            direction = "in" if edge[1] else "out" if edge[5] else "both"
            edge_parts = (edge[2], tuple(edge[3].split("|")) if edge[3] else (), least, most, direction)
            at, left = edge.end(), name
            while at < len(text) and text[at].isspace():
                at += 1
        if at < len(text):
            if text[at] != ",":
                raise ValueError(f"cannot read {text[at:]!r}")
            at += 1
            while at < len(text) and text[at].isspace():
                at += 1
    return hops, labels


def _hop_table(edges: DataFrame, hop: Hop) -> DataFrame:
    """(left, right[, edge label]) of a hop; ranges are unions of joins without repeated pairs."""
    e = edges.where(F.col("label").isin(*hop.labels)) if hop.labels else edges
    forward = e.select(F.col("src").alias("l"), F.col("dst").alias("r"), "label")
    back = e.select(F.col("dst").alias("l"), F.col("src").alias("r"), "label")
    one = {"out": forward, "in": back, "both": forward.unionAll(back)}[hop.direction]
    if (hop.least, hop.most) == (1, 1):
        return one
    pairs = one.select("l", "r").distinct()
    reach, total = pairs, None
    for n in range(1, hop.most + 1):
        if n > 1:
            reach = reach.select("l", F.col("r").alias("m")).join(pairs.select(F.col("l").alias("m"), "r"), "m").select("l", "r").distinct()
        if n >= hop.least:
            total = reach if total is None else total.unionAll(reach)
    if hop.least == 0:
        ends = e.select(F.explode(F.array("src", "dst")).alias("l")).distinct()
        total = ends.select("l", F.col("l").alias("r")) if total is None else total.unionAll(ends.select("l", F.col("l").alias("r")))
    return total.distinct().withColumn("label", F.lit(None).cast("string"))


def match(nodes: DataFrame, edges: DataFrame, pattern: str, optional: str | None = None, node_label: str = "label") -> DataFrame:
    """Rows of node ids, one column for each variable (edge variables hold the edge's label).

    nodes is (id[, label, ...]), edges (src, dst, label). Patterns separated by commas share variables.
    optional patterns keep rows they do not extend, with nulls.
    """
    rows = _join(None, *parse(pattern), nodes, edges, node_label, "inner")
    return rows if optional is None else _join(rows, *parse(optional), nodes, edges, node_label, "left")


def _join(rows, hops, labels, nodes, edges, node_label, how):
    chain = None
    for hop in hops:
        t = _hop_table(edges, hop).withColumnsRenamed({"l": hop.left, "r": hop.right})
        if hop.left == hop.right:
            raise ValueError("a hop from a node to itself needs two variables")
        t = t.withColumnRenamed("label", hop.name) if hop.name else t.drop("label")
        shared = [c for c in (hop.left, hop.right) if chain is not None and c in chain.columns]
        chain = t if chain is None else chain.join(t, shared) if shared else chain.crossJoin(t)
    if chain is None:
        (name,) = labels or {"n": None}
        chain = nodes.select(F.col("id").alias(name))
    for name, label in labels.items():
        if name in chain.columns:
            chain = chain.join(nodes.where(F.col(node_label) == label).select(F.col("id").alias(name)), name, "left_semi")
    if rows is None:
        return chain
    shared = [c for c in chain.columns if c in rows.columns]
    return rows.join(chain, shared, how) if shared else rows.crossJoin(chain)
