"""Operators of round two in small cases."""

import time

import pytest
from pyspark.sql import functions as F

from layerlake.operators import catalog, index, checks, merge, prompts, search, transforms, validate
from layerlake.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_queries_are_folded_like_texts():
    assert search.parse_query("Café foo_bar") == ([["cafe"], ["foo", "bar"]], True)
    assert search.parse_query("what is the big red dog?") == ([["big"], ["red"], ["dog"]], False)
    assert search.parse_query("is it the what") == ([["is"], ["it"], ["the"], ["what"]], True)
    assert search.parse_query('? _ "" !') == ([], True)


def test_index_and_scan_agree(spark, tmp_path):
    rows = [(1, "Café au lait, foo_bar", "x"), (2, "foo bar cafe", None), (3, "bar foo", "cafe"), (4, None, "foo"), (5, "foo foo bar bar", ""), (6, "lait foo", "bar")]
    df = spark.createDataFrame(rows, "id long, text string, more string")
    path = str(tmp_path / "index")
    index.build(df, "id", ["text", "more"], path)
    hits = {"café": {1, 2, 3}, "foo_bar": {1, 2, 5}, "foo-bar lait": {1}, "a b lait and foo_bar": {1, 2, 5, 6}, "?": set(), "nothing": set()}
    for ask, want in hits.items():
        scan = {r.label: r.keyword_score for r in search.bm25(df, "id", ["text", "more"], ask).collect()}
        found = {r.label: r.keyword_score for r in index.search_all(spark, path, ask).collect()}
        assert set(scan) == want and found == pytest.approx(scan)


def test_layered_level_of_all_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 0), (3, [0.0, 1.0], 4)], "label long, embedding array<double>, level int")
    docs = spark.createDataFrame([(1, "cat"), (2, "dog"), (3, "cat")], "label long, text string")
    got = {r.label: r.score for r in search.layered(v, "label", "embedding", "level", v.where("label = 1")).collect()}
    assert got[1] == 1.25 and set(got) == {1, 2}
    assert search.run(docs, "label", "text", "cat", "layered", 3, v, v.where("label = 1")).count() == 3
    assert search.run(docs, "label", "text", "cat", "layered", 3).count() == 2
    with pytest.raises(ValueError):
        search.surface({"a": docs}, ["a", "b"])
    assert search.surface({"a": docs, "b": docs}, ["a"]).count() == 3


def slow_lines(content, query, head=4, around=2):
    import re

    words, lines = query.lower().split(), content.splitlines()
    keep = set(range(min(head, len(lines)))) | {j for i, x in enumerate(lines) if any(w in x.lower() for w in words) for j in range(max(0, i - around), min(len(lines), i + around + 1))}
    keep |= {i for i in range(len(lines)) if i - 1 in keep and i + 1 in keep}
    out, last = [], -1
    for i in sorted(keep):
        if last >= 0 and i > last + 1:
            out.append("...")
        x = lines[i]
        for w in words:
            x = re.sub("(?i)" + re.escape(w), lambda m: f"**{m[0]}**", x)
        out.append(x)
        last = i
    return "\n".join(out + (["..."] if last < len(lines) - 1 else []))


def test_line_snippet(spark):
    text = "\n".join(f"line {i}" + (" Cat here" if i in (9, 14, 30) else "") for i in range(40))
    for t, q in ((text, "cat"), (text, "cat line"), ("one\ntwo", "zzz"), ("a\nb\nc\nd\ne\nf cat", "cat"), (text + "\n", "30")):
        assert one(spark, search.line_snippet(F.lit(t), q)) == slow_lines(t, q)


def test_embeddings_are_cached(spark):
    df = spark.createDataFrame([("a b",), ("c",), ("c",), (None,)], "text string")
    first = search.embed(df.where("text = 'c'"), "text", search.hash_vectors).checkpoint()

    def only_new(texts):
        assert "c" not in texts
        return search.hash_vectors(texts)

    got = search.embed(df, "text", only_new, cache=first)
    assert got.count() == 3 and got.join(first, "content_hash").count() == 1
    assert search.embed(df, "text", search.hash_vectors, model="other", cache=first).count() == 3


def test_merge_keeps_null_texts_and_long_chains(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None), (3, "x y", "b")], "id long, text string, who string")
    got = {r.label: (r.cluster, r["size"]) for r in merge.clusters(docs, "id", "text").collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1)}
    nodes = spark.range(200).selectExpr("id AS node")
    pairs = spark.range(199).selectExpr("id AS a", "id + 1 AS b")
    assert merge.components(nodes, pairs).where("root <> 0").count() == 0
    member = merge.clusters(docs, "id", "text").checkpoint()
    assert merge.merged_sections(docs, member, "id", "text", "who").first().content == "--- Source: 1 (customer: a) ---\n\n\n--- Source: 2 ---\n"
    parts = merge.merged_sections(docs, member, "id", "text", "who", part_chars=10).orderBy("part").collect()
    assert [p.part for p in parts] == [0, 3]


def test_missing_group_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, k string")
    assert {r.group_key for r in transforms.group_key(df, F.col("k")).collect()} == {"a", "_ungrouped"}
    assert transforms.group_key(df, F.col("k"), "skip").count() == 1
    with pytest.raises(Exception, match="without a group key"):
        transforms.group_key(df, F.col("k"), "error").collect()


def test_prefixes(spark):
    a = spark.createDataFrame([("abc", "sha256:11aa"), ("abd", "sha256:11bb"), ("ab", "sha256:22cc"), ("x", "sha256:ab00")], "label string, artifact_id string")
    asked = spark.createDataFrame([("ab",), ("abc",), ("a",), ("22",), ("sha256:11",), ("zz",)], "prefix string")
    got = {r.prefix: (r.label, r.state) for r in catalog.resolve_prefix(a, asked).collect()}
    assert got == {"ab": ("ab", "found"), "abc": ("abc", "found"), "a": (None, "ambiguous"), "22": ("ab", "found"), "sha256:11": (None, "ambiguous"), "zz": (None, "absent")}


def test_scope_and_order(spark):
    rows = spark.createDataFrame([("ep-1", "episode", "i1", "l1"), ("x", "ep", "i2", "l2"), ("y", "z", "i3", "l2")], "label string, artifact_type string, artifact_id string, layer string")
    assert [validate.in_scope(rows, **k).count() for k in ({}, {"scope": "ep"}, {"layers": ["l2"], "scope": "ep"}, {"ids": ["i1"], "layers": ["l2"]})] == [3, 2, 2, 1]
    v = spark.createDataFrame([("b", "t", "f", "m", {"claim": "z"}), ("b", "t", "f", "m", {"claim_b": "a", "claim_a": "c"}), ("a", "t", "f", "m", {})], "label string, violation_type string, field string, message string, metadata map<string,string>")
    assert [(r.label, r.metadata.get("claim")) for r in v.orderBy(*validate.sort_key()).collect()] == [("a", None), ("b", None), ("b", "z")]


def test_diff_texts(spark):
    import difflib

    a = spark.createDataFrame([("d", "one\ntwo\n"), ("e", "same")], "label string, text string")
    b = spark.createDataFrame([("d", "one\nthree\n"), ("e", "same")], "label string, text string")
    want = "".join(difflib.unified_diff(["one\n", "two\n"], ["one\n", "three\n"], "a/d", "b/d", lineterm=""))
    assert [tuple(r) for r in checks.unified_diff(a, b, "label", "text").collect()] == [("d", want)]


def test_retrieved_context_and_fix(spark):
    hits = spark.createDataFrame([("a", i, f"hit {i}") for i in range(1, 8)], "label string, rank long, content string")
    ctx = validate.retrieved(hits)
    assert ctx.first().context == "\n\n".join(f"hit {i}" for i in range(1, 6))
    arts = spark.createDataFrame([("a", "text"), ("b", "other")], "label string, content string")
    found = validate.violations(arts, "k", F.col("label"), F.lit("bad"), F.lit("error"))
    fixed = validate.fix(arts, found, ["k"], "{content}|{violations}|{context}", lambda q: q.select("label", F.col("prompt").alias("content")), ctx)
    assert {r.label: r.content for r in fixed.collect()} == {"a": "text|- bad|" + ctx.first().context, "b": "other|- bad|"}


def test_reserved_metadata(spark):
    df = spark.createDataFrame([("s", "abcdef", {"k": "1"})], "label string, content string, metadata map<string,string>")
    c = transforms.chunk_metadata(transforms.chunk_fixed(df, "content", 4, 1), "label", F.create_map(F.lit("chunk_index"), F.lit("x"), F.lit("k"), F.lit("2")))
    assert [r.metadata["k"] + r.metadata["chunk_index"] + r.metadata["chunk_total"] for r in c.collect()] == ["202", "212"]
    assert one(spark, prompts.overlay(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2")))) == {"a": "2"}


def test_count_windows_stream(spark, tmp_path):
    """Parts are flushed at two user turns, and the rest when no row comes any more."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = str(tmp_path / "in")
    rows = [("s1", u) for u in (True, False, True, True)] + [("s2", True)]
    spark.createDataFrame(rows, "session string, user boolean").coalesce(1).write.json(src)
    stream = spark.readStream.schema("session string, user boolean").json(src)
    q = ingest.count_windows_stream(stream, "session", "user", 2, 2).writeStream.format("memory").queryName("parts").outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            got = {(r.session, r.part, r.n_rows, r.n_turns, r.why) for r in spark.table("parts").collect()}
            if len(got) >= 3:
                break
    finally:
        q.stop()
    assert got == {("s1", 0, 3, 2, "turns"), ("s1", 1, 1, 1, "idle"), ("s2", 0, 1, 1, "idle")}


def test_claims_are_idempotent(spark, tmp_path):
    """Batches of the stream writer come with an id; all that arrived is in one."""
    src = str(tmp_path / "in")
    spark.range(5).write.parquet(src)
    seen = {}
    q = ingest.claim_batches_stream(spark.readStream.schema("id long").parquet(src), lambda df, n: seen.setdefault(n, df.count()), 1).start()
    try:
        for _ in range(30):
            time.sleep(0.5)
            if sum(seen.values()) == 5:
                break
    finally:
        q.stop()
    assert sum(seen.values()) == 5
