"""graph.diameter against plain breadth-first search, and how many rows it writes."""

import random

import pytest

from polymera.operators import graph


def plainly(pairs):
    near = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    far = []
    for node in near:
        depth, seen, front = 0, {node}, {b for b in near[node]}
        while front:
            depth, seen = depth + 1, seen | front
            front = {c for b in front for c in near[b]} - seen
        far.append(depth)
    return (max(far, default=None), min(far, default=None))


def found(spark, pairs, **more):
    return tuple(graph.diameter(spark.createDataFrame(pairs, "src long, dst long"), **more).first())


@pytest.fixture
def most_rows(monkeypatch):
    """Rows of each table that graph operators write."""
    counts, write = [], graph.written

    def counted(df, *more):
        out = write(df, *more)
        counts.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    return counts


def test_pairs_are_not_written(spark, most_rows):
    rng = random.Random(1)
    stars = [(10 + i, rng.randrange(6)) for i in range(400)] + [(10 + i, rng.randrange(6)) for i in range(400)]
    tree = [(i, rng.randrange(max(0, i // 5), i // 2 + 1)) for i in range(1, 300)]
    for pairs in (stars, tree):
        most_rows.clear()
        assert found(spark, pairs) == plainly(pairs)
        assert max(most_rows) < 8 * len(pairs)


def test_nodes_without_neighbours_take_no_part(spark):
    assert found(spark, [(1, 2), (2, 3), (7, 7), (9, None), (None, 9)]) == (2, 1)
    assert found(spark, [(7, 7)]) == found(spark, []) == (None, None)


def test_large_graphs_go_by_batches(spark):
    rng = random.Random(2)
    sparse = [(rng.randrange(50), rng.randrange(50)) for _ in range(70)] + [(100, 101), (102, 103), (103, 104), (104, 105)]
    grid = [(10 * x + y, 10 * x + y + s) for x in range(3) for y in range(4) for s in (1, 10)]
    for pairs, cells in ((sparse, 12), (grid, 2)):
        assert found(spark, pairs, cells=cells) == plainly(pairs)


def test_more_sources_than_one_row_holds_and_long_paths(spark):
    ring = [(i, (i + 1) % 150) for i in range(150)]
    assert found(spark, ring[:18]) == (18, 9)
    rungs = [(i, j) for i in range(75) for j in (i + 75, (i + 7) % 75, 75 + (i + 11) % 75)]
    assert found(spark, rungs) == plainly(rungs)
    with pytest.raises(RuntimeError):
        found(spark, ring[:6], max_depth=3)
