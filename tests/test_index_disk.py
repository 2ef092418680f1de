"""What the keyword index and its searches shuffle."""

import random

from pyspark.sql import functions as F

from layerlake.operators import index, validate


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()


def table(spark, n=400):
    r = random.Random(4)
    rows = [(i, " ".join(f"{r.choice('abcdefgh')}{r.randrange(400)}" for _ in range(300)) + " common-word of all") for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, text string").repartition(4).checkpoint()


def test_a_segment_is_written_without_a_shuffle_and_matches_move_few_rows(spark, tmp_path):
    rows, df = table(spark)
    before = shuffled(spark)
    index.build(df, "id", ["text"], str(tmp_path))
    assert shuffled(spark) - before < 10_000
    asked = spark.createDataFrame([("common",), ("a1 b2 no such",), ("common-word",)], "q string")
    before = shuffled(spark)
    got = index.match_many(spark, str(tmp_path), asked, "q", "q").groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got}["common"] == len(rows)
    assert shuffled(spark) - before < 100_000


def test_rounds_of_many_tokens_share_one_shuffle(spark, tmp_path, monkeypatch):
    """Eight rounds of searches move little more than one, and find what a search of few tokens at a time finds."""
    rows, df = table(spark)
    path = str(tmp_path)
    index.build(df, "id", ["text"], path)
    asked = spark.createDataFrame([(i, t[:80] + " common-word") for i, t in rows[:80]], "qid long, ask string")
    monkeypatch.setattr(index, "FEW_TOKENS", 50)
    moved, found = [], []
    for terms in (100_000, 200):
        monkeypatch.setattr(index, "ROUND_TERMS", terms)
        before = shuffled(spark)
        found.append(sorted(tuple(r) for r in index.search_many(spark, path, asked, "qid", "ask", 3).collect()))
        moved.append(shuffled(spark) - before)
    assert found[0] == found[1] and len(found[0]) == 240
    assert moved[1] < 2 * moved[0]
    monkeypatch.setattr(index, "FEW_TOKENS", 100_000)
    assert sorted(tuple(r) for r in index.search_many(spark, path, asked, "qid", "ask", 3).collect()) == found[0]


def test_contexts_move_only_what_is_shown(spark, tmp_path):
    import hashlib

    rows = [(i, f"w{i} same " + "".join(hashlib.sha256(f"{i}-{j}".encode()).hexdigest() for j in range(300))) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, text string").checkpoint()
    index.build(df.select("id", F.substring("text", 1, 8).alias("text")), "id", ["text"], str(tmp_path))
    before = shuffled(spark)
    got = validate.search_context(str(tmp_path), df.select(F.col("id").alias("label"), F.substring("text", 1, 8).alias("query")), df.select(F.col("id").alias("label"), F.col("text").alias("content")), 1, 50, any_word=True)
    assert got.count() == 100 and shuffled(spark) - before < 300_000


def test_a_release_moves_little(spark, tmp_path, monkeypatch):
    from layerlake.operators import release

    monkeypatch.setattr(index, "FEW_TOKENS", 50)
    rows, df = table(spark)
    edges = df.select(F.col("id").alias("child"), (F.col("id") % 7 + 1000).alias("parent"))
    asked = spark.createDataFrame([(i, t[:200]) for i, t in rows[:40]], "qid long, ask string")
    before = shuffled(spark)
    release.write_release(df, "id", ["text"], edges, str(tmp_path))
    got = release.search_release(spark, str(tmp_path), asked, "qid", "ask", 2).collect()
    assert len(got) == 40 * 2 * 2 and {r.label for r in got if r["rank"] == 1 and r.query_id == 5} == {5}
    assert shuffled(spark) - before < 700_000
