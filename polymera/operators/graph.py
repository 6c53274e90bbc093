"""Graph operators over edge tables (src, dst[, label][, weight]): iterative joins with written rounds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polymera.operators.components import connected_components
from polymera.storage import forget, written


#: Rounds of power iteration between two written tables.
ROUNDS_A_WRITE = 3

#: Nodes of at most so many neighbours are compared for equal ones; only speed depends on it.
TWIN_DEGREE = 16

#: Rows that a batch of sources may hold, 64 sources of a node in each; only speed depends on it.
CELLS = 4_000_000


def vertices(edges: DataFrame) -> DataFrame:
    """Every end of an edge, as id."""
    return edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).distinct()


def undirected(edges: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Different pairs in both directions, without loops."""
    both = edges.select("src", "dst", *columns).unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *columns))
    return both.where("src <> dst").dropDuplicates(["src", "dst"])


def _degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-7, max_iterations: int = 100, personalization: DataFrame | None = None) -> DataFrame:
    """(node_id, rank): power iteration until ranks change by less than tolerance in sum; they sum to 1.

    Parallel edges count once each. Ranks of nodes without out-edges go to all, or to the personalization
    (id, weight) if one is given. Contributions are summed before the shuffle, so a hub is no single task's burden.
    """
    nodes = written(vertices(edges), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select(F.col("id").alias("node_id"), F.lit(0.0).alias("rank"))
    if personalization is None:
        base = nodes.withColumn("base", F.lit(1.0 / n))
    else:
        whole = personalization.agg(F.sum("weight")).first()[0]
        base = nodes.join(personalization, "id", "left").select("id", (F.coalesce("weight", F.lit(0.0)) / whole).alias("base"))
    out = _degrees(edges).withColumnRenamed("src", "id")
    links = written(edges.select("src", "dst"), "links")
    ranks = written(base.join(out, "id", "left").select("id", "base", "degree", F.col("base").alias("rank")), "ranks")
    for i in range(1, max_iterations + 1):
        loose = ranks.where("degree IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        given = links.join(ranks, links["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("given"))
        new = ranks.join(given, ranks["id"] == given["dst"], "left").crossJoin(F.broadcast(loose))  # one row
        new = new.select("id", "base", "degree", F.col("rank").alias("old"), ((1 - damping + damping * F.col("loose")) * F.col("base") + damping * F.coalesce("given", F.lit(0.0))).alias("rank"))
        if i % ROUNDS_A_WRITE and i < max_iterations:
            ranks = new.drop("old")
            continue
        new = written(new, "ranks")
        change = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new.drop("old")
        if change < tolerance:
            break
    return ranks.select(F.col("id").alias("node_id"), "rank")


def wcc(edges: DataFrame) -> DataFrame:
    """(node_id, component_id): weakly connected components by their least node."""
    return connected_components(edges).select(F.col("id").alias("node_id"), F.col("component").alias("component_id"))


def label_propagation(edges: DataFrame, max_iterations: int = 10, seed: int = 0) -> DataFrame:
    """(node_id, community_id): every node takes its neighbours' most frequent label, ties to the smallest.

    A round has two halves: nodes of one colour (a seeded hash of the node and round) hear the others as they
    are, then those of the other colour hear the new labels. So neighbours do not swap labels for ever, as
    they would if all moved at once. Ends when a round changes nothing, or after max_iterations.
    """
    links = written(undirected(edges), "links")
    labels = written(vertices(edges).select("id", F.col("id").alias("label")), "labels")
    for i in range(max_iterations):
        changed = 0
        for half in (0, 1):
            turn = F.pmod(F.xxhash64("src", F.lit(seed + i)), F.lit(2)) == half
            votes = links.where(turn).join(labels, links["dst"] == labels["id"]).groupBy("src", "label").agg(F.count("*").alias("n"))
            heard = votes.groupBy("src").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("new"))
            new = labels.join(heard, labels["id"] == heard["src"], "left").select("id", F.col("label").alias("old"), F.coalesce("new", "label").alias("label"))
            new = written(new, "labels")
            changed += new.where("old <> label").limit(1).count()
            labels = new.select("id", "label")
        if not changed:
            break
    return labels.select(F.col("id").alias("node_id"), F.col("label").alias("community_id"))


def _oriented(edges: DataFrame) -> DataFrame:
    """Each undirected pair once, from the end of lower degree to the other, so that no node has many."""
    both = written(undirected(edges), "links")
    d = _degrees(both)
    a = both.join(d.withColumnRenamed("degree", "da"), "src").join(d.select(F.col("src").alias("dst"), F.col("degree").alias("db")), "dst")
    return written(a.where("da < db OR (da = db AND src < dst)").select("src", "dst"), "oriented")


def _triangle_rows(edges: DataFrame) -> DataFrame:
    o = _oriented(edges)
    first, second = o.select(F.col("src").alias("a"), F.col("dst").alias("b")), o.select(F.col("src").alias("a"), F.col("dst").alias("c"))
    wedge = first.join(second, "a").where("b <> c")
    return wedge.join(o.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])


def triangles(edges: DataFrame, per_node: bool = True) -> DataFrame:
    """(node_id, triangles), 0 included, or one row (triangles) for the whole graph. Directions and parallel edges do not matter."""
    rows = _triangle_rows(edges)
    if not per_node:
        return rows.agg(F.count("*").alias("triangles"))
    counts = rows.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return vertices(edges).join(counts, "id", "left").select(F.col("id").alias("node_id"), F.coalesce("n", F.lit(0)).alias("triangles"))


def lcc(edges: DataFrame) -> DataFrame:
    """(node_id, coefficient): share of a node's neighbour pairs that are linked; 0 under two neighbours."""
    t = triangles(edges)
    d = _degrees(undirected(edges))
    j = t.join(d, t["node_id"] == d["src"], "left")
    return j.select("node_id", F.when(F.col("degree") >= 2, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("coefficient"))


def degree(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(node_id, centrality): edges out, in or both, over n - 1."""
    ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    nodes = vertices(edges)
    n = nodes.count()
    hits = edges.select(F.explode(F.array(*ends)).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    return nodes.join(hits, "id", "left").select(F.col("id").alias("node_id"), (F.coalesce("d", F.lit(0)) / max(1, n - 1)).alias("centrality"))


def sssp(edges: DataFrame, source, max_iterations: int = 1000) -> DataFrame:
    """(node_id, distance) of the nodes that a source reaches, by rounds of relaxation from the nodes that changed.

    Weights default to 1 and must not be negative. Paths of more edges than max_iterations raise.
    """
    w = F.coalesce("weight", F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    links = written(edges.select("src", "dst", w.cast("double").alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w")), "links")
    if links.where("w < 0").limit(1).count():
        raise ValueError("negative weight")
    best = written(vertices(edges).where(F.col("id") == source).select("id", F.lit(0.0).alias("distance"), F.lit(True).alias("fresh")), "distances")
    for _ in range(max_iterations):
        reached = links.join(best.where("fresh"), links["src"] == best["id"]).groupBy("dst").agg(F.min(F.col("distance") + F.col("w")).alias("offer"))
        j = best.drop("fresh").join(reached, best["id"] == reached["dst"], "full_outer")
        better = F.col("offer").isNotNull() & (F.col("distance").isNull() | (F.col("offer") < F.col("distance")))
        best = written(j.select(F.coalesce("id", "dst").alias("id"), F.when(better, F.col("offer")).otherwise(F.col("distance")).alias("distance"), better.alias("fresh")), "distances")
        if not best.where("fresh").limit(1).count():
            break
    else:
        raise RuntimeError(f"paths of more than {max_iterations} edges; raise max_iterations")
    return best.select(F.col("id").alias("node_id"), "distance")


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int = 10, direction: str = "out", label: str | None = None, max_nodes: int | None = None) -> DataFrame:
    """(id, depth) of the nodes within max_depth hops of seeds (id); 'out', 'in' or 'both' ways.

    max_nodes refuses a traversal that grows beyond it rather than cut it short.
    """
    e = edges if label is None else edges.where(F.col("label") == label)
    ways = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    links = None
    for a, b in ways:
        part = e.select(F.col(a).alias("a"), F.col(b).alias("b"))
        links = part if links is None else links.unionAll(part)
    links = written(links.distinct(), "links")
    seen = written(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "seen")
    for depth in range(1, max_depth + 1):
        front = links.join(seen.where(F.col("depth") == depth - 1), links["a"] == seen["id"]).select(F.col("b").alias("id")).distinct()
        new = written(front.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "front")
        n = new.limit(1).count()
        if not n:
            break
        seen = seen.unionByName(new)
        if max_nodes is not None and seen.count() > max_nodes:
            raise ValueError(f"more than {max_nodes} nodes")
    return seen


def neighbors(edges: DataFrame, node, direction: str = "out", label: str | None = None) -> DataFrame:
    """One hop from a node."""
    e = edges if label is None else edges.where(F.col("label") == label)
    out, into = e.where(F.col("src") == node).select(F.col("dst").alias("id")), e.where(F.col("dst") == node).select(F.col("src").alias("id"))
    return {"out": out, "in": into, "both": out.unionAll(into)}[direction].distinct()


def shortest_path(edges: DataFrame, source, target, max_depth: int = 20) -> list:
    """Nodes of a path of fewest hops, least nodes first among equals; [] if there is none within max_depth."""
    if source == target:
        return [source]
    kind = edges.schema["src"].dataType
    links = written(edges.select("src", "dst").distinct(), "links")
    seen = links.where(F.col("src") == source).select(F.col("src").alias("id"), F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("depth")).limit(1)
    seen = written(seen, "seen")
    for depth in range(1, max_depth + 1):
        front = links.join(seen.where(F.col("depth") == depth - 1), links["src"] == seen["id"]).groupBy("dst").agg(F.min("src").alias("parent"))
        new = written(front.select(F.col("dst").alias("id"), "parent", F.lit(depth).alias("depth")).join(seen.select("id"), "id", "left_anti"), "front")
        if not new.limit(1).count():
            return []
        seen = seen.unionByName(new)
        if new.where(F.col("id") == target).limit(1).count():
            path = [target]
            while path[-1] != source:
                path.append(seen.where(F.col("id") == path[-1]).select("parent").first()[0])
            return path[::-1]
    return []


def _distances(edges: DataFrame, sources: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(source, id, depth) from each source along edges, itself at 0."""
    links = written(edges.select("src", "dst").distinct(), "links")
    seen = written(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("depth")), "seen")
    front = seen
    for depth in range(1, max_depth + 1):
        step = links.join(front, links["src"] == front["id"]).select("source", F.col("dst").alias("id")).distinct()
        front = written(step.join(seen.select("source", "id"), ["source", "id"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        if not front.limit(1).count():
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError(f"paths of more than {max_depth} edges; raise max_depth")


def _sampled(nodes: DataFrame, sample_size: int | None) -> DataFrame:
    return nodes if sample_size is None else nodes.orderBy(F.xxhash64("id"), "id").limit(sample_size)


def closeness(edges: DataFrame, sample_size: int | None = None) -> DataFrame:
    """(node_id, centrality) after Wasserman and Faust: ((r - 1) / (n - 1)) * ((r - 1) / sum of distances), r nodes reached.

    Exact for all nodes, or for a sample of them: all pairs of reachable nodes are visited.
    """
    nodes = vertices(edges)
    n = nodes.count()
    d = _distances(edges, _sampled(nodes, sample_size)).groupBy("source").agg((F.count("*") - 1).alias("r"), F.sum("depth").alias("s"))
    return d.select(F.col("source").alias("node_id"), F.when(F.col("s") > 0, F.col("r") / (n - 1) * F.col("r") / F.col("s")).otherwise(0.0).alias("centrality"))


def harmonic(edges: DataFrame, sample_size: int | None = None) -> DataFrame:
    """(node_id, centrality): sum of 1 / distance over n - 1."""
    nodes = vertices(edges)
    n = nodes.count()
    d = _distances(edges, _sampled(nodes, sample_size)).groupBy("source").agg(F.sum(F.when(F.col("depth") > 0, 1 / F.col("depth")).otherwise(0.0)).alias("s"))
    return d.select(F.col("source").alias("node_id"), (F.col("s") / max(1, n - 1)).alias("centrality"))


def _without_twins(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Undirected links, and nodes (id, degree, low), of which one stands for all that have the same neighbours.

    Such nodes are two apart and equally far from every other, so distances of those that stay do not
    change. low is what is known of an eccentricity: 2 for one that has a twin, else 1.
    """
    degrees = written(_degrees(links), "degrees")
    few = links.join(degrees.where(F.col("degree") <= TWIN_DEGREE), "src").groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("near"))
    kept = few.groupBy("near").agg(F.min("src").alias("id"), F.size("near").cast("long").alias("degree"), F.when(F.count("*") > 1, 2).otherwise(1).alias("low")).drop("near")
    kept = written(kept.unionByName(degrees.where(F.col("degree") > TWIN_DEGREE).select(F.col("src").alias("id"), "degree", F.lit(1).alias("low"))), "nodes")
    rest = links.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    return written(rest.select("src", "dst"), "links"), kept


def _rounds(links: DataFrame, sources: DataFrame, max_depth: int) -> Iterator[DataFrame]:
    """Written tables (id, part, block, seen, fresh, last), one for each depth from 1 that any node meets a source at.

    Sources are (id, part, block, bit) and seen holds the bits of those met, fresh of those met at this depth, of
    64 sources of a block; last is the depth of the last one. Sources of different parts may share a bit, as no
    path leads between them. The table before is read until the next one is taken.
    """
    state = written(sources.select("id", "part", "block", F.col("bit").alias("seen"), F.col("bit").alias("fresh"), F.lit(0).alias("last")), "met")
    for depth in range(1, max_depth + 1):
        before = state
        step = links.join(before.where("fresh <> 0"), links["src"] == before["id"]).select(F.col("dst").alias("id"), "part", "block", F.expr("0L AS seen"), F.col("fresh").alias("offer"), F.lit(0).alias("last"))
        both = before.select("id", "part", "block", "seen", F.expr("0L AS offer"), "last").unionAll(step)
        both = both.groupBy("id", "part", "block").agg(F.bit_or("seen").alias("seen"), F.bit_or("offer").alias("offer"), F.max("last").alias("last"))
        both = both.select("id", "part", "block", F.expr("seen | offer").alias("seen"), F.expr("offer & ~seen").alias("fresh"), "last")
        state = written(both.withColumn("last", F.when(F.col("fresh") != 0, F.lit(depth)).otherwise(F.col("last"))), "met")
        if not state.where("fresh <> 0").limit(1).count():
            forget(state)
            return
        yield state
    raise RuntimeError(f"paths of more than {max_depth} edges; raise max_depth")


def _slots(nodes: DataFrame) -> DataFrame:
    """Nodes with a bit of a block of 64, different within a part."""
    slots = nodes.withColumn("slot", F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1)
    return slots.withColumns({"block": F.expr("slot div 64"), "bit": F.expr("shiftleft(1L, slot % 64)")}).drop("slot")


def _picked(undecided: DataFrame, most: int) -> DataFrame:
    """Of each part at most so many sources, half those that may be farthest out, half those that may be most central."""
    orders = [(F.desc_nulls_first("high"), F.desc("degree"), F.col("id")), (F.asc("low"), F.desc("degree"), F.col("id"))]
    halves = [undecided.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*o))).where(F.col("rank") <= most // 2) for o in orders]
    return halves[0].unionByName(halves[1]).select("id", "part", "low").distinct()


def _all_distances_bounded(links: DataFrame, nodes: DataFrame, max_depth: int) -> DataFrame:
    """(low, high) of each node, both its eccentricity: every node is a source, so the last source met is the farthest node."""
    sources = written(_slots(nodes.withColumn("part", F.lit(0))), "sources")
    last = sources.select("id", F.lit(0).alias("last"))
    table = None
    for state in _rounds(links, sources, max_depth):
        if table is not None:
            forget(table)
        table, last = state, state.select("id", "last")
    far = nodes.join(last.groupBy("id").agg(F.max("last").alias("last")), "id").select(F.greatest("low", "last").alias("low"))
    return far.withColumn("high", F.col("low"))


def _batches_bounded(links: DataFrame, nodes: DataFrame, max_depth: int, cells: int) -> DataFrame:
    """(low, high) around each node's eccentricity, near enough to tell the greatest low and the least high are the greatest and least of all."""
    most = max(2, 64 * cells // nodes.count())
    size = min(64, most)
    parts = connected_components(links).withColumnRenamed("component", "part")
    bounds = written(nodes.join(parts, "id").withColumn("high", F.lit(None).cast("int")), "bounds")
    while True:
        top, least = bounds.agg(F.max("low"), F.min("high")).first()
        undecided = bounds.where("high IS NULL")
        if least is not None:
            undecided = bounds.where(F.col("high").isNull() | (F.col("low") < F.col("high")) & ((F.col("high") > top) | (F.col("low") < least)))
        if not undecided.limit(1).count():
            return bounds
        sources = written(_slots(_picked(undecided, size)), "sources")
        met, done = None, [bounds, sources]
        for depth, state in enumerate(_rounds(links, sources, max_depth), 1):
            new = state.where("fresh <> 0").select("id", "part", "block", "fresh", F.lit(depth).alias("depth"))
            met = new if met is None else met.unionByName(new)
            done.append(state)
            if depth % 16 == 0:
                met = written(met, "met")
                done.append(met)
        ends = met.groupBy("part", "block", "depth").agg(F.bit_or("fresh").alias("fresh"))
        far = sources.join(ends, ["part", "block"]).where("(fresh & bit) <> 0")
        far = written(far.groupBy("id", "part", "block", "bit", "low").agg(F.max("depth").alias("far")).withColumn("far", F.greatest("far", "low")), "far")
        alike = far.groupBy("part", "block", "far").agg(F.bit_or("bit").alias("bits"))
        offers = met.join(alike, ["part", "block"]).where("(fresh & bits) <> 0").select("id", F.greatest(F.col("depth"), F.col("far") - F.col("depth")).alias("l"), (F.col("far") + F.col("depth")).alias("h"))
        offers = offers.unionAll(far.select("id", "far", "far")).groupBy("id").agg(F.max("l").alias("l"), F.min("h").alias("h"))
        bounds = written(bounds.join(offers, "id", "left").select("id", "part", "degree", F.greatest("low", "l").alias("low"), F.least("high", "h").alias("high")), "bounds")
        if 8 * met.count() <= cells:
            size = min(most, 8 * size)
        for table in (far, *done):
            forget(table)


def diameter(edges: DataFrame, max_depth: int = 1000, cells: int = CELLS) -> DataFrame:
    """One row (diameter, radius): greatest and least eccentricity over undirected paths within components.

    Nodes without neighbours take no part; if no node has any, both are null. Of nodes with the same neighbours
    one is visited. If all that stay fit as sources, 64 to a row of a node, in that many cells, they are. Else a batch of
    each component's is, after which a node's eccentricity lies between max(d, e - d) and e + d for a source
    at distance d with eccentricity e, and nodes come next until these bounds decide both figures. Both ways are
    exact; on graphs whose bounds stay apart every node becomes a source. Paths of max_depth edges raise.
    """
    links, nodes = _without_twins(written(undirected(edges), "links"))
    if nodes.count() ** 2 <= 64 * cells:
        bounds = _all_distances_bounded(links, nodes, max_depth)
    else:
        bounds = _batches_bounded(links, nodes, max_depth, cells)
    return bounds.agg(F.max("low").alias("diameter"), F.min("high").alias("radius"))


def betweenness(edges: DataFrame, sample_size: int | None = 1_000, normalized: bool = True, max_edges: int = 5_000_000) -> DataFrame:
    """(node_id, centrality) by Brandes over directed unit edges, from all nodes or a scaled-up sample of sources.

    The adjacency is broadcast, so graphs of more than max_edges different edges are refused.
    """
    links = edges.select("src", "dst").where("src <> dst").distinct()
    pairs = links.limit(max_edges + 1).toPandas()
    if len(pairs) > max_edges:
        raise ValueError(f"more than {max_edges} edges; sample the graph first")
    nodes = vertices(edges)
    n = nodes.count()
    sources = _sampled(nodes, sample_size)
    used = n if sample_size is None else min(n, sample_size)
    send = edges.sparkSession.sparkContext.broadcast(pairs.groupby("src")["dst"].apply(list).to_dict())

    def run(batches):
        adjacency = send.value
        for pdf in batches:
            total: dict = {}
            for s in pdf["id"]:
                order, paths, dist, parents = [], {s: 1.0}, {s: 0}, {s: []}
                queue = [s]
                for v in queue:
                    order.append(v)
                    for w in adjacency.get(v, ()):
                        if w not in dist:
                            dist[w], paths[w], parents[w] = dist[v] + 1, 0.0, []
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            paths[w] += paths[v]
                            parents[w].append(v)
                part = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in parents[w]:
                        part[v] += paths[v] / paths[w] * (1 + part[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + part[w]
            yield pd.DataFrame({"id": list(total), "part": list(total.values())})

    kind = nodes.schema["id"].dataType.simpleString()
    parts = sources.mapInPandas(run, f"id {kind}, part double").groupBy("id").agg(F.sum("part").alias("part"))
    scale = n / max(1, used) / (((n - 1) * (n - 2)) if normalized and n > 2 else 1)
    return nodes.join(parts, "id", "left").select(F.col("id").alias("node_id"), (F.coalesce("part", F.lit(0.0)) * scale).alias("centrality"))


def k_core(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node_id, coreness) by peeling: in each round all nodes of at most k edges left go, with coreness k.

    Each round is written, and what went is folded into one table every few rounds, so plans stay short. A
    peeling longer than max_rounds raises.
    """
    links = written(undirected(edges), "links")
    nodes = written(vertices(edges), "nodes")
    done = nodes.join(links.select(F.col("src").alias("id")).distinct(), "id", "left_anti").withColumn("coreness", F.lit(0))
    k = 1
    for i in range(max_rounds):
        degrees = written(_degrees(links), "degrees")
        least = degrees.agg(F.min("degree")).first()[0]
        if least is None:
            return done.select(F.col("id").alias("node_id"), "coreness")
        k = max(k, least)
        low = degrees.where(F.col("degree") <= k).select("src")
        done = done.unionByName(low.select(F.col("src").alias("id"), F.lit(k).alias("coreness")))
        rest = written(links.join(low, "src", "left_anti").join(low.select(F.col("src").alias("dst")), "dst", "left_anti").select("src", "dst"), "links")
        # whoever lost all links without being low itself had only low neighbours left
        alone = degrees.where(F.col("degree") > k).select("src").join(rest.select("src").distinct(), "src", "left_anti")
        done = done.unionByName(alone.select(F.col("src").alias("id"), F.lit(k).alias("coreness")))
        links = rest
        if i % 8 == 7:
            done = written(done, "peeled")
    raise RuntimeError(f"more than {max_rounds} rounds of peeling; raise max_rounds")


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of (id, community) over undirected weighted edges."""
    w = F.coalesce("weight", F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w"))
    m = e.agg(F.sum("w")).first()[0] or 1.0
    c = communities
    j = e.join(c.select(F.col("id").alias("src"), F.col("community").alias("ca")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("cb")), "dst")
    inside = j.where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    strength = j.select(F.explode(F.array("ca", "cb")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("s"))
    return inside / m - resolution * strength.agg(F.sum(F.pow(F.col("s") / (2 * m), 2))).first()[0]


def louvain(edges: DataFrame, resolution: float = 1.0, rounds: int = 8, levels: int = 5) -> DataFrame:
    """(node_id, community_id, modularity): nodes move to the neighbouring community of greatest gain, then communities become nodes.

    Half of the nodes (by hash and round) may move at once, which keeps neighbours from trading places;
    a level ends when none moves. communities are named by their least node.
    """
    w = F.coalesce("weight", F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    base = written(edges.select("src", "dst", w.cast("double").alias("weight")), "links")
    nodes = vertices(base)
    m = base.agg(F.sum("weight")).first()[0] or 1.0
    member = written(nodes.select("id", F.col("id").alias("community")), "members")
    graph = base
    for level in range(levels):
        both = written(graph.unionAll(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "links")
        strength = written(both.groupBy("src").agg(F.sum("weight").alias("s")).withColumnRenamed("src", "id"), "strengths")
        at = written(strength.select("id", "s", F.col("id").alias("c")), "at")
        moved_any = False
        for round_no in range(rounds):
            whole = at.groupBy("c").agg(F.sum("s").alias("total"))
            near = both.where("src <> dst").join(at.select(F.col("id").alias("dst"), "c"), "dst").groupBy("src", "c").agg(F.sum("weight").alias("k"))
            own = at.select(F.col("id").alias("src"), F.col("c").alias("own"), "s")
            options = near.join(own, "src").join(whole, "c")
            gain = F.col("k") - resolution * F.col("s") * (F.col("total") - F.when(F.col("c") == F.col("own"), F.col("s")).otherwise(0.0)) / (2 * m)
            options = options.withColumn("gain", F.round(gain, 9))
            best = options.groupBy("src").agg(F.min_by("c", F.struct(-F.col("gain"), F.col("c"))).alias("to"), F.max("gain").alias("gain"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"))
            lone = at.join(whole, "c").select("id", (-resolution * F.col("s") * (F.col("total") - F.col("s")) / (2 * m)).alias("lone"))
            best = best.join(lone, best["src"] == lone["id"]).drop("id").withColumn("stay", F.coalesce("stay", F.round("lone", 9)))
            turn = F.pmod(F.xxhash64("src", F.lit(round_no)), F.lit(2)) == 0
            moves = best.where((F.col("gain") > F.col("stay") + 1e-9) & turn).select("src", "to")
            new = written(at.join(moves, at["id"] == moves["src"], "left").select("id", "s", F.coalesce("to", "c").alias("c"), F.col("c").alias("old")), "at")
            moved = new.where("c <> old").limit(1).count()
            at = new.drop("old")
            moved_any = moved_any or bool(moved)
            if not moved and round_no % 2:
                break
        if not moved_any:
            break
        names = at.groupBy("c").agg(F.min("id").alias("name"))
        at = written(at.join(names, "c").select("id", F.col("name").alias("c")), "named")
        member = written(member.join(at, member["community"] == at["id"]).select(member["id"], F.col("c").alias("community")), "members")
        graph = written(graph.join(at.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(at.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")), "links")
    q = modularity(base, member, resolution)
    least = member.groupBy("community").agg(F.min("id").alias("community_id"))
    return member.join(least, "community").select(F.col("id").alias("node_id"), "community_id", F.lit(q).alias("modularity"))


def statistics(edges: DataFrame) -> DataFrame:
    """(label, edges, sources, targets, max_out_degree) for each edge label."""
    out = edges.groupBy("label", "src").agg(F.count("*").alias("d"))
    a = edges.groupBy("label").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))
    return a.join(out.groupBy("label").agg(F.max("d").alias("max_out_degree")), "label")


ALGORITHMS = {f.__name__: f for f in (pagerank, wcc, label_propagation, lcc, sssp, betweenness, closeness, harmonic, degree, louvain, triangles, diameter, k_core)}
