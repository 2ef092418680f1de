import html
import time

import pytest
from pyspark.sql import functions as F

from layerlake.operators import checks, completer, graph, merge, search, transforms
from layerlake.sources.tail import TailSource
from layerlake.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_snippet(spark):
    text = "a" * 300 + " <b> Cat & catalog " + "z" * 300
    got = one(spark, search.snippet(F.lit(text), "cat catalog", 40))
    at = text.lower().index("cat")
    window = html.escape(text[at - 20 : at + 20])
    assert got == window.replace("Cat", "<mark>Cat</mark>").replace("catalog", "<mark>catalog</mark>")
    assert one(spark, search.snippet(F.lit("<none>"), "cat", 4)) == html.escape("<non")
    assert one(spark, search.snippet(F.lit("a cat"), "cat", 200)) == "a <mark>cat</mark>"


def test_modes(spark):
    docs = spark.createDataFrame([(i, "red cat" if i % 2 else "red dog dog") for i in range(6)], "label long, text string")
    vectors = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(6)], "label long, embedding array<double>")
    asked = vectors.where("label = 0")
    assert [r.label for r in search.run(docs, "label", "text", "cat", k=2).orderBy("rank").collect()] == [1, 3]
    assert search.run(docs, "label", "text", "cat", "hybrid", 2).count() == 2
    assert [r.label for r in search.run(docs, "label", "text", "cat", "hybrid", 2, vectors, asked).orderBy("rank").collect()] == [1, 3]
    with pytest.raises(ValueError):
        search.run(docs, "label", "text", "cat", "semantic")


def test_merge_veto_and_names(spark):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words, "a"), (2, words + " more", "a"), (3, words, "b"), (4, words + " other", None), (5, "alone", None)]
    docs = spark.createDataFrame(rows, "id long, text string, who string")
    pairs = merge.jaccard_pairs(merge.token_sets(docs, "id", "text", "who"))
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 2), (1, 4), (2, 4), (3, 4)}
    member = merge.clusters(docs, "id", "text", veto="who").checkpoint()
    assert {r.label: r.cluster for r in member.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    assert merge.group_keys(docs, member, "id", "text").first().group_key == "word0_word1_word2"
    assert merge.constrained_field("never merge Different customer_id") == "customer_id"


def test_completer(spark):
    df = spark.createDataFrame([(1, "p "), (2, "p"), (3, "q"), (4, "bad")], "label long, text string")
    reqs = completer.requests(df, "label", F.col("text"))
    assert reqs.select("request_id").distinct().count() == 3
    seen = completer.extractive(reqs.where("label < 3"))
    assert {r.prompt for r in completer.pending(reqs, seen).collect()} == {"q", "bad"}
    assert {(r.content, r.error) for r in completer.replay(reqs, seen).collect()} >= {(None, "no recorded answer")}

    def send(prompt):
        if prompt == "bad":
            raise ValueError("Maximum context tokens")
        return prompt.strip() + "!"

    good, bad = completer.answers(reqs, completer.call(reqs, send))
    assert {tuple(r) for r in good.collect()} == {(1, "p!"), (2, "p!"), (3, "q!")}
    assert [tuple(r) for r in bad.collect()] == [(4, "Maximum context tokens", "dlq")]
    said = ["Unauthorized", "content_filter", "boom", None]
    rows = spark.createDataFrame([(x,) for x in said], "e string").select(completer.verdict(F.col("e")).alias("v"))
    assert [r.v for r in rows.collect()] == ["fatal", "dlq", "fatal", None]


def test_checks(spark):
    red = {"credit_card": "4111 1111 1111 1234", "ssn": "123-45-6789", "email": "jane@x.org", "phone": "555-123-4567"}
    want = {"credit_card": "4111****34", "ssn": "***-**-6789", "email": "ja***@x.org", "phone": "***-***-4567"}
    assert {k: one(spark, checks.redact(F.lit(k), F.lit(v))) for k, v in red.items()} == want
    a = one(spark, checks.violation_id(F.lit("t"), F.lit("l"), F.lit("B "), F.lit("a")))
    assert a == one(spark, checks.violation_id(F.lit("t"), F.lit("l"), F.lit("A"), F.lit("b")))
    assert one(spark, checks.explain(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3), F.lit("c"), F.lit(1)))) == ["a", "b", "c"]
    log = [("v1", 1, "seen", "h"), ("v1", 2, "ignored", "h"), ("v1", 3, "seen", "h"), ("v2", 1, "ignored", "h"), ("v2", 2, "seen", "i"),
           ("v3", 1, "seen", "h"), ("v3", 2, "resolved", "h"), ("v4", 1, "seen", "gone")]
    states = checks.violation_states(spark.createDataFrame(log, "violation_id string, at long, event string, content_hash string"))
    now = checks.expire(states, spark.createDataFrame([("h",), ("i",)], "content_hash string"))
    assert {r.violation_id: r.status for r in now.collect()} == {"v1": "ignored", "v2": "active", "v3": "resolved", "v4": "expired"}
    arts = spark.createDataFrame([("a", "x"), ("b", " ")], "label string, content string").withColumn("artifact_id", F.concat(F.lit("sha256:"), F.sha2("content", 256)))
    edges = spark.createDataFrame([("b", "a"), ("b", "z")], "child string, parent string")
    assert {r.check: r.failed for r in checks.verify(arts, edges).collect()} == {"content_hashes": 0, "contents": 1, "labels": 0, "provenance": 1}
    closure = graph.ancestors(edges, spark.createDataFrame([("b",)], "node string"))
    assert {(r.ancestor, r.value) for r in graph.field_origin(closure, arts, "label", "content").collect()} == {("a", "x"), ("b", " ")}


def test_fold_resume(spark):
    def rows(xs):
        return spark.createDataFrame(xs, "k string, label string, artifact_id string, at long")

    seen = rows([(k, x, x, i) for k in "abcd" for i, x in enumerate("pq", 1)])
    inputs = rows([("a", "p", "p", 1), ("a", "q", "q", 2), ("a", "r", "r", 3), ("b", "p", "p", 1), ("b", "q", "q", 2),
                   ("c", "p", "P", 1), ("c", "q", "q", 2), ("d", "p", "p", 1), ("d", "q", "q", 3), ("d", "s", "s", 2), ("e", "p", "p", 1)])
    done = spark.createDataFrame([(k, True) for k in "abcd"], "k string, fresh boolean")
    states = transforms.fold_states(inputs, seen, done, "k")
    assert {r.k: r.state for r in states.collect()} == {"a": "resume", "b": "unchanged", "c": "recompute", "d": "recompute", "e": "recompute"}
    rest = transforms.fold_rest(inputs, seen, states, "k")
    assert sorted((r.k, r.label) for r in rest.collect()) == [("a", "r"), ("c", "p"), ("c", "q"), ("d", "p"), ("d", "q"), ("d", "s"), ("e", "p")]


def test_reduce_tree(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("label"), F.concat(F.lit("c"), "id").alias("content"))

    def count(prompts):
        n = F.regexp_count("prompt", F.lit(r"(?m)^(c\d+|=)"))
        return prompts.select("label", F.concat(F.lit("n"), F.col("input_count")).alias("content"))

    (r,) = transforms.reduce_tree(df, count, 10).collect()
    assert r.content in {f"n{i}" for i in range(1, 6)}
    small = transforms.reduce_tree(df.limit(3), lambda p: p.select("label", F.col("prompt").alias("content")), 10).first()
    assert small.content.count("### ") == 3
    both = transforms.with_reference(df.limit(2), df.limit(2), "all", F.col("content"))
    assert both.select("all").distinct().count() == 1


def test_upsert(spark):
    def rows(xs):
        return spark.createDataFrame(xs, "id string, seq int, digest string, at long, processed boolean")

    table = rows([("a", 0, "x", 1, True), ("b", 0, "y", 1, True)])
    got = ingest.upsert(table, rows([("a", 0, "z", 2, True), ("b", 0, "y", 2, True), ("c", 0, "x", 2, True), ("d", 0, "w", 2, True)]), ["id", "seq"], "digest", "at")
    assert {(r.id, r.digest, r.processed) for r in got.collect()} == {("a", "z", False), ("b", "y", True), ("d", "w", False)}


def test_tail(spark, tmp_path):
    spark.dataSource.register(TailSource)
    f = tmp_path / "a.jsonl"
    f.write_text("one\ntwo\npart")
    q = (
        spark.readStream.format("tail").option("path", str(tmp_path / "*.jsonl")).load()
        .writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        q.processAllAvailable()
        with f.open("a") as out:
            out.write("ial\nthree\n")
        (tmp_path / "b.jsonl").write_text("other\n")
        q.processAllAvailable()
        f.write_text("new\n")  # truncated
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r.line for r in spark.table("tail").collect()) == ["new", "one", "other", "partial", "three", "two"]


def test_debounce(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a",), ("a",), ("b",)], "k string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string").parquet(str(tmp_path / "in"))
    q = (
        ingest.debounce(stream, "k", 1, 5).writeStream.format("memory").queryName("due").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    )
    try:
        stop = time.time() + 40
        while time.time() < stop and spark.table("due").count() < 2:
            time.sleep(0.5)
        assert q.exception() is None
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {(r.k, r.n_events, r.why) for r in spark.table("due").collect()} == {("a", 2, "quiet"), ("b", 1, "quiet")}
