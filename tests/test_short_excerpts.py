"""Contexts of short texts: one word of an excerpt is enough, as in the SQL of fix_with_context."""

import duckdb
from pyspark.sql import functions as F

from layerlake import oracle, queries
from layerlake.operators import index


def test_short_texts_get_the_context_that_the_sql_gives(spark, tmp_path):
    rows = [(0, "alpha beta.", "en"), (9, "The gamma", "de"), (18, "of the", "en"), (27, "", "en"), (36, None, "de"), (4, "alpha gamma delta epsilon", "en"), (5, "beta beta of", "fr"), (7, "gamma the zeta eta theta", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(c.execute(oracle.ORACLES["fix_with_context"]).fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES["fix_with_context"](spark, str(tmp_path)).select("label", "n_fixed", "h").collect()) == want


def test_any_word(spark, tmp_path):
    index.build(spark.createDataFrame([(1, "alpha x"), (2, "beta y"), (3, "alpha beta"), (4, "z")], "id long, text string"), "id", ["text"], str(tmp_path))
    asked = spark.createDataFrame([(0, "alpha beta")], "qid int, ask string")
    found = lambda **kw: {r.label for r in index.search_many(spark, str(tmp_path), asked, "qid", "ask", **kw).collect()}
    assert found() == {3} and found(any_word=True) == {1, 2, 3}
