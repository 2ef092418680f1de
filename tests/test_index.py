import random

import pytest
from pyspark.sql import functions as F

from layerlake.operators import index, search

WORDS = ["alpha", "beta", "Gamma", "delta-ray", "ÉTÉ", "zeta", "the", "of", "eta", "theta", "rare"]


def docs(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        k = r.choice([0, 1, 3, 10, 40, 200])
        rows.append((i, " ".join(r.choices(WORDS, weights=[30, 20, 9, 5, 3, 3, 40, 20, 2, 1, 0.05], k=k)), r.choice(["alpha x", "beta y", None])))
    rows += [(n, None, "x"), (n + 1, "?!", ""), (n + 2, "rare " * 500, "alpha")]
    return spark.createDataFrame(rows, "id long, text string, more string")


ASKED = ["alpha", "the of", "rare theta", "delta-ray", "the delta-ray beta zeta", "gamma beta eta theta rare unknown", "?", "", None, "unknown words here not", "ete", "alpha alpha beta the of", "x alpha beta gamma zeta"]


def queries(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "qid int, ask string")


def by_scan(df, ask, k, columns):
    rows = search.top(search.bm25(df, "id", columns, ask or ""), "keyword_score", k).collect()
    return [(r.label, round(r.keyword_score, 5), r["rank"]) for r in rows]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    df = docs(spark).repartition(3).checkpoint()
    index.build(df, "id", ["text", "more"], path)
    return df, path


@pytest.mark.parametrize("k,few", [(1, 50_000), (7, 0), (1000, 50_000)])
def test_many_queries_equal_a_scan_for_each(spark, built, monkeypatch, k, few):
    monkeypatch.setattr(index, "FEW_ROWS", few)
    df, path = built
    got = {}
    for r in index.search_many(spark, path, queries(spark), "qid", "ask", k).collect():
        got.setdefault(r.query_id, []).append((r.label, round(r.score, 5), r["rank"]))
    for i, ask in enumerate(ASKED):
        assert sorted(got.get(i, []), key=lambda x: x[2]) == by_scan(df, ask, k, ["text", "more"]), ask


def test_all_matches_of_many_queries(spark, built):
    df, path = built
    got = {}
    for r in index.match_many(spark, path, queries(spark), "qid", "ask").collect():
        got.setdefault(r.query_id, set()).add(r.label)
    for i, ask in enumerate(ASKED):
        assert got.get(i, set()) == {x[0] for x in by_scan(df, ask, 10_000, ["text", "more"])}, ask


def test_rounds_and_whole_lists(spark, built, monkeypatch):
    df, path = built
    monkeypatch.setattr(index, "ROUND_TERMS", 4)
    monkeypatch.setattr(index, "FEW_ROWS", 3)
    got = index.search_many(spark, path, queries(spark), "qid", "ask", 3)
    assert got.groupBy("query_id").count().count() == sum(1 for a in ASKED if by_scan(df, a, 1, ["text", "more"]))
    for ask in ASKED[:6]:
        rows = index.search_all(spark, path, ask).collect()
        assert sorted((r.label, round(r.keyword_score, 5)) for r in rows) == sorted(x[:2] for x in by_scan(df, ask, 10_000, ["text", "more"]))


def test_blocks_under_the_threshold_are_not_read(spark, tmp_path):
    """Frequent words: the ten best of 12,000 rows need under a fifth of the postings."""
    path = str(tmp_path / "i")
    rows = spark.range(12_000).select("id", F.expr("concat_ws(' ', repeat('the ', cast(pmod(xxhash64(id), 97) as int)), repeat('filler ', cast(pmod(xxhash64(id, 1), 50) as int)), if(id % 3 = 0, 'odd', 'even'))").alias("text"))
    index.build(rows, "id", ["text"], path)
    live = index.rows_of(spark, path)
    n, avgdl = index.statistics(spark, path)
    s = index.Search(live, [(True, [("the",), ("odd",)])], n, avgdl, 10)
    every = s.rows.agg(F.sum("n")).first()[0]
    read = s.rows.join(s.needed_blocks(s.thresholds()), "block", "left_semi").agg(F.sum("n")).first()[0]
    assert 5 * read <= every
    got = [(r.label, round(r.score, 5), r["rank"]) for r in s.hits().orderBy("rank").collect()]
    assert got == by_scan(rows, "the odd", 10, ["text"])


def postings(spark, path):
    """token, label, frequency, length, places of all that is live."""
    rows = index.rows_of(spark, path).where("token is not null")
    each = rows.select("token", F.explode(F.arrays_zip("labels", "tfs", "dls", "at")).alias("x")).select("token", "x.*")
    return sorted((r.token, r.labels, r.tfs, r.dls, tuple(r["at"])) for r in each.collect())


def test_updates_equal_a_fresh_index(spark, tmp_path):
    path, fresh = str(tmp_path / "a"), str(tmp_path / "b")
    df = docs(spark, 300, 2)
    versions = [df.where("id % 4 <> 1"), df.withColumn("text", F.when(F.col("id") % 5 == 0, F.concat("text", F.lit(" added"))).otherwise(F.col("text"))), df.where("id > 30")]
    for d in versions:
        index.update(d, "id", ["text", "more"], path, most=1)
        index.build(d, "id", ["text", "more"], fresh)
        assert postings(spark, path) == postings(spark, fresh)
        assert index.statistics(spark, path) == pytest.approx(index.statistics(spark, fresh))
    got = index.search_many(spark, path, queries(spark), "qid", "ask", 5).orderBy("query_id", "rank").collect()
    assert got == index.search_many(spark, fresh, queries(spark), "qid", "ask", 5).orderBy("query_id", "rank").collect()
    assert sum(r.kind == "segment" for r in index.manifest(spark, path)) <= 2
    before = postings(spark, path)
    assert index.vacuum(spark, path)
    assert postings(spark, path) == before and index.vacuum(spark, path) == []
    index.update(versions[-1], "id", ["text", "more"], path)  # nothing changed
    assert index.vacuum(spark, path) == []


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    df = docs(spark, 60, 3)
    index.build(df, "id", ["text"], path)
    before, at = postings(spark, path), index.version(spark, path)

    def died(*_):
        raise RuntimeError("lost")

    for name in ("_write_segment", "_commit"):
        with monkeypatch.context() as m:
            m.setattr(index, name, died)
            with pytest.raises(RuntimeError):
                index.update(df.withColumn("text", F.concat("text", F.lit(" new"))), "id", ["text"], path)
        assert index.version(spark, path) == at and postings(spark, path) == before
    spark.createDataFrame([("segment", "nowhere", 1, 1)], "kind string, name string, n long, dl long").write.parquet(f"{path}/manifests/{at + 1:08d}")
    import os

    os.remove(f"{path}/manifests/{at + 1:08d}/_SUCCESS")  # a manifest that was not finished
    assert index.version(spark, path) == at and postings(spark, path) == before


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "d")
    index.build(docs(spark, 5).limit(0), "id", ["text"], path)
    assert index.search_many(spark, path, queries(spark), "qid", "ask").collect() == []
    assert index.search_all(spark, path, "alpha").collect() == []
    index.update(docs(spark, 5), "id", ["text"], path)
    assert index.statistics(spark, path)[0] == 8


def test_blocks_stay_whole_where_their_rows_lie_in_many_files(spark, built):
    """A join by block that becomes a broadcast join must not leave a block's rows where they were read."""
    df, path = built
    want = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "10000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    had = {k: spark.conf.get(k) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        ask = "alpha beta the of zeta"
        got = sorted((r["rank"], r.label, round(r.score, 5)) for r in index.search_many(spark, path, spark.createDataFrame([(0, ask)], "qid int, ask string"), "qid", "ask", 7).collect())
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)
    assert [(label, score, rank) for rank, label, score in got] == by_scan(df, ask, 7, ["text", "more"])


def test_a_large_bucket_is_sorted_by_several_tasks_and_rows_are_flat(spark, tmp_path):
    """What one task sorts does not grow with the table, whatever the number of shuffle partitions."""
    had = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
    try:
        index.build(docs(spark).repartition(8).checkpoint(), "id", ["text"], str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", had)
    files = [x for x in tmp_path.glob("segments/*/bucket=*/*.parquet")]
    assert max(sum(x.parent == y.parent for x in files) for y in files) > 1
    flat = index._live(spark, str(tmp_path)).where("token is not null")
    assert not flat.where(F.size("at") != F.aggregate("tfs", F.lit(0), lambda a, x: a + x)).count()
    whole = index.rows_of(spark, str(tmp_path)).where("token is not null")
    assert not whole.where(F.size("at") != F.size("labels")).count()
