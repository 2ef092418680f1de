from layerlake.operators import graph


def test_deep_lineage_is_whole(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, 19)], "child long, parent long")
    got = graph.ancestors(edges, spark.createDataFrame([(0,)], "node long")).collect()
    assert sorted((r.ancestor, r.depth) for r in got) == [(i, i) for i in range(21)]


def walked(edges, start):
    """Ancestors with their depths, breadth first."""
    depth, now = {start: 0}, [start]
    while now:
        now = sorted({p for c, p in edges if c in now} - set(depth))
        depth.update({p: max(depth.values()) + 1 for p in now})
    return depth


def test_a_thousand_levels_take_few_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1000)], "child long, parent long")
    got, rounds = graph.closure(edges, spark.createDataFrame([(0,), (990,)], "node long"))
    assert {(r.node, r.ancestor, r.depth) for r in got.collect()} == {(0, i, i) for i in range(1001)} | {(990, i, i - 990) for i in range(990, 1001)}
    assert rounds <= 12


def test_diamonds_cycles_and_missing_nodes(spark):
    import random

    r = random.Random(2)
    pairs = [(r.randint(0, 40), r.randint(0, 40)) for _ in range(70)] + [(1, 1), (3, 4), (4, 3), (3, 4)]
    got = graph.ancestors(spark.createDataFrame(pairs, "child long, parent long"), spark.createDataFrame([(i,) for i in range(0, 60, 3)] * 2, "node long"))
    rows = [(x.node, x.ancestor, x.depth) for x in got.collect()]
    assert len(set(rows)) == len(rows)
    assert set(rows) == {(n, a, d) for n in range(0, 60, 3) for a, d in walked(pairs, n).items()}
    assert graph.ancestors(spark.createDataFrame([], "child long, parent long"), spark.createDataFrame([(1,)], "node long")).collect() == [(1, 1, 0)]
