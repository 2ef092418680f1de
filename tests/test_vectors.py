import numpy as np
import pytest
from pyspark.sql import functions as F

from layerlake.operators import search, vectors


def table(spark, seed=1, n=500, size=6):
    r = np.random.default_rng(seed)
    m = np.concatenate([r.normal(c, 0.05, (n // 5, size)) for c in r.normal(0, 1, (5, size))])
    rows = [(i, [float(x) for x in v], int(i % 7)) for i, v in enumerate(m)]
    rows += [(n + i, rows[0][1], 3) for i in range(40)]  # copies
    rows += [(n + 50, [0.0] * size, 1), (n + 51, None, 2)]
    return spark.createDataFrame(rows, "id long, v array<float>, level int")


def cosines(df, asked):
    rows = [(r.id, np.array(r.v, float), r.level) for r in df.collect() if r.v]
    out = {}
    for q in asked.collect():
        x = np.array(q.v, float)
        norm = lambda a: np.sqrt((a * a).sum())
        out[q.id] = [(i, 0.0 if norm(x) * norm(v) == 0 else float(x @ v / (norm(x) * norm(v))), level) for i, v, level in rows]
    return out


@pytest.mark.parametrize("k,least,cells,rows", [(3, 0.35, None, 4096), (45, 0.2, 9, 7), (1000, 0.9, 2, 64), (5, -1.0, 4, 100)])
def test_equal_to_comparing_all(spark, monkeypatch, k, least, cells, rows):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", rows)
    monkeypatch.setattr(vectors, "CHUNK_QUERIES", 5)
    df = table(spark)
    asked = df.where("id % 50 = 0 or id > 545")
    got = {}
    for r in vectors.Cells(df, "id", "v", cells).top(asked, "id", "v", k, least).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.label, r.score))
    for q, rows_ in cosines(df, asked.where("v is not null")).items():
        best = sorted(((-round(s, 6), i) for i, s, _ in rows_ if s >= least))[:k]
        mine = sorted(got.get(q, []))
        assert [(i, pytest.approx(-s, abs=2e-6)) for s, i in best] == [(i, s) for _, i, s in mine]


def test_far_cells_are_skipped(spark):
    df = table(spark)
    c = vectors.Cells(df, "id", "v", 8)
    asked = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").cast("array<double>").alias("q"))
    pairs = c._pairs(asked, None, 0.95, False)
    assert pairs.count() < asked.count() * int(c.parts.sum()) / 2


def test_layered_and_fused(spark):
    df = table(spark)
    asked = df.where("id in (0, 100, 300)")
    cells = vectors.Cells(df, "id", "v")
    got = {}
    for r in vectors.layered_all(cells, df, "id", "level", asked, "id", "v", 6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.label, r.score))
    for q, rows in cosines(df, asked).items():
        best = sorted((-round(s * (1 + level / 6), 6), i) for i, s, level in rows if s >= 0.35)[:6]
        assert [(i, pytest.approx(-s, abs=2e-6)) for s, i in best] == [(i, s) for _, i, s in sorted(got[q])]
    words = spark.createDataFrame([(i, n + 1) for n, i in enumerate([7, 0, 499, 3, 100, 12, 300])], "label long, rank long")
    near = cells.top(asked, "id", "v", 4).select("query_id", "label", "rank")
    fused = {(r.query_id, r["rank"]): r.label for r in vectors.fuse_all(words, near, 5).collect()}
    for q in (0, 100, 300):
        one = search.top(search.fuse(words, near.where(F.col("query_id") == q)), "score", 5).collect()
        assert [fused[q, r["rank"]] for r in one] == [r.label for r in one]


def test_empty_and_one_query_row(spark):
    df = table(spark)
    assert vectors.Cells(df.limit(0), "id", "v").top(df.limit(3), "id", "v", 2).collect() == []
    assert vectors.Cells(df, "id", "v").top(df.limit(0), "id", "v", 2).collect() == []
    with pytest.raises(Exception, match="one query row"):
        search.semantic(df, "id", "v", df.limit(3)).collect()
    words = spark.createDataFrame([(1, "cat")], "label long, text string")
    v = df.select(F.col("id").alias("label"), F.col("v").alias("embedding"), "level")
    assert search.run(words, "label", "text", "cat", "layered", 3, v.limit(0), v.limit(1)).collect() == []
