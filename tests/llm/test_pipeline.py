import zlib
from array import array

from test_filters import slow_components, slow_words
from test_suffixes import slow_passages
from tokenizers import Tokenizer

import corpus_pipeline as cp
from layerlake.llm import rules
from layerlake.llm.encode import vocabulary

SF = "/root/testdata/sf0.001"


def shingles(text, n=5):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(spark.createDataFrame([(10**6, None, None, None, None), (None, "w " * 30 + "no id, but words enough to count as one", "en", "s", 1)], docs.schema))
    rows = {r.doc_id: r for r in docs.collect()}

    kept = spark.createDataFrame(cp.quality_rules(spark, docs, SF).collect(), docs.schema)
    assert kept.columns == cp.COLUMNS
    verdict = {r.doc_id: r.kept for r in rules.apply_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, k in verdict.items() if k}

    one = cp.simhash_near_dedup(spark, kept, SF).collect()
    before = kept.collect()
    roots = slow_components([r.doc_id for r in before], [shingles(r.text) for r in before], similar)
    assert sorted((r.doc_id for r in one), key=str) == sorted({d for r, d in zip(before, roots) if r.doc_id == d}, key=str)
    assert all(rows[r.doc_id] == r for r in one)

    one_df = spark.createDataFrame(one, docs.schema)
    cut = cp.suffix_array_dedup(spark, one_df, SF).collect()
    want = {r.doc_id: [w.decode() for w in left] for r, (_, left) in zip(one, slow_passages([r.text for r in one]))}
    assert {r.doc_id: r.text.split() for r in cut} == want
    assert all(r.n_chars == len(r.text) and r.lang == rows[r.doc_id].lang for r in cut)

    cut_df = spark.createDataFrame(cut, docs.schema)
    clean = cp.benchmark_decontamination(spark, cut_df, SF).collect()
    windows = set()
    for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = slow_words(b.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    words_left = {}
    for r in cut:
        w, hit = slow_words(r.text), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        words_left[r.doc_id] = [x for i, x in enumerate(w) if i not in hit]
    assert {r.doc_id: slow_words(r.text) for r in clean} == words_left

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    pieces = cp.curve_packing(spark, spark.createDataFrame(clean, docs.schema), SF).collect()
    ids = {r.doc_id: [*tok.encode(r.text, add_special_tokens=False).ids, 1] for r in clean}
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(array("I", ids[p.doc_id][p.start : p.start + p.length]).tobytes())


def test_odd_tables(spark):
    """Every stage on an empty table, and on nulls, ties, repeated rows, a long text and extra columns of any name."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    long = " ".join(f"w{i % 7919}x{i % 13}" for i in range(60_000))
    text = "some words that make a document of more than ten words and end here"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, long, "en", "s", 1), (3, text, None, "s", 1), (3, text, None, "s", 1), (3, text + " or there", "en", None, 1), (None, text, "en", "s", 1)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for k in ("h", "c", "_id", "k1", "k2", "spans", "items", "n_words", "start", "fp", "root", "kept"):
            docs = docs.withColumn(k, docs.doc_id % 2)
        for name, stage in cp.STAGES:
            out = stage(spark, docs, SF)
            got = out.collect()
            assert len(got) <= 10**6 and (data or not got)
            if name != "curve_packing":
                assert out.columns == cp.COLUMNS
                docs = spark.createDataFrame(got, schema)
        if data:
            assert {r.doc_id for r in docs.collect()} == {2, None} or {r.doc_id for r in docs.collect()} == {2, 3}


def test_run(spark):
    assert cp.run(spark, SF).count() > 0
