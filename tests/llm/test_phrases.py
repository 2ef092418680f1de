import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from layerlake.llm import phrases, queries

SF = "/root/testdata/sf0.001"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counts(rows, max_n=3):
    """(lang, words) -> occurrences, and words of each lang, from rows (lang, text)."""
    found, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text or "")):
            ws = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for i in range(len(ws)):
                for k in range(1, max_n + 1):
                    if i + k <= len(ws):
                        found[lang, tuple(ws[i : i + k])] += 1
    return found, total


def brute(rows, max_n=3, least=10, keep=2000, absorb=50):
    found, total = counts(rows, max_n)
    candidates = {p: a for p, a in found.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, ws), a in candidates.items():
        if any(len(o) > len(ws) and l2 == lang and 100 * b >= absorb * a and any(o[i : i + len(ws)] == ws for i in range(len(o))) for (l2, o), b in candidates.items()):
            continue
        cuts = [(1000000 * a * a // (found[lang, ws[:k]] * found[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out.append((lang, " ".join(ws), a, found[lang, ws[:k]], found[lang, ws[k:]], total[lang], score))
    best = {}
    for r in sorted(out, key=lambda r: (r[0], -r[6], -r[2], r[1].encode())):
        best.setdefault(r[0], []).append(r)
    return {(lang, i + 1, *r[1:]) for lang, rs in best.items() for i, r in enumerate(rs[:keep])}


def mined(spark, rows, **options):
    d = spark.createDataFrame([(i, lang, text, "x", 1) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, rank int")
    return {tuple(r) for r in phrases.mine_phrases(d, **options).collect()}


@pytest.mark.parametrize("max_n", [2, 3, 4])
def test_against_counting_all_phrases(spark, max_n, monkeypatch):
    monkeypatch.setattr(phrases, "HOT_SHARE", 20)  # some words are hot
    r = random.Random(max_n)
    text = lambda: "".join(r.choice(["the ", "The\t", "of ", "a b ", "new york city ", "é́x ", "\x01 ", "., ", "\n", "x ", "  ", "rare%d " % r.randint(0, 400)]) for _ in range(r.randint(0, 200)))
    rows = [(r.choice(["en", "fr", None]), text()) for _ in range(120)] + [("en", None), ("en", ""), ("xx", " .!?\t"), (None, "y " * 5000)]
    rows += rows[:20]
    assert mined(spark, rows, max_n=max_n, least=4, keep=50) == brute(rows, max_n, 4, 50)


def test_absorbed_and_empty(spark):
    rows = [("en", "aa bb cc")] * 10 + [("en", "aa bb")] * 10 + [("en", "bb cc")] * 11 + [("en", "dd ee")] * 9
    got = mined(spark, rows)
    assert got == brute(rows)
    assert {r[2] for r in got} == {"aa bb cc", "bb cc"}  # 10 of 20 lie in the longer one, 10 of 21 do not
    assert mined(spark, [("en", None)]) == set()
    assert mined(spark, rows[:0]) == set()


def test_stack_over_small_batches():
    r = random.Random(8)
    found = Counter()
    rows = Counter()
    for _ in range(3000):
        ws = [r.choice("abc") * r.randint(1, 2) for _ in range(r.randint(1, 3))]
        lang = r.choice(["en", "fr"])
        rows[ws[0], lang, "".join(w + " " for w in ws[1:])] += 1
        for k in range(1, len(ws) + 1):
            found[lang, k, " ".join(ws[:k])] += 1
    ordered = sorted(rows.items(), reverse=True)
    stack, got = phrases.Stack(3), Counter()

    def note(done):
        for k, langs, prefix, count, _ in done:
            for lang, p, c in zip(list(langs), list(prefix), list(count)):
                key = str(lang), k, str(p)
                assert key not in got
                got[key] = c

    while ordered:
        part, ordered = ordered[: (m := r.randint(1, 7))], ordered[m:]
        note(stack.push(pa.table([pa.array([x[0][1] for x in part]), pa.array([x[0][0] for x in part]), pa.array([x[0][2] for x in part]), pa.array([x[1] for x in part]), pa.array([False] * len(part))], names=["lang", "word", "rest", "n", "hot"])))
    note(stack.close())
    assert got == found


def test_scores_are_exact(spark):
    """Products past 64 bits: the counts of 3 billion occurrences in decimals."""
    df = spark.sql("SELECT cast(3000000001 as bigint) a, cast(3000000007 as bigint) l, cast(3000000009 as bigint) r")
    got = df.selectExpr("(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000BD) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as s").first().s
    assert got == 1000000 * 3000000001**2 // (3000000007 * 3000000009)


def test_query_equals_sql(spark):
    got = queries.op11_phrase_collocations(spark, SF)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql = f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES['op11_phrase_collocations']})"
    assert {tuple(r) for r in got.collect()} == set(c.execute(sql).fetchall())


def test_large_batches_are_cut():
    t = pa.record_batch({"lang": ["x"] * 1000, "text": ["word " * 10] * 999 + ["long " * 5000]})
    parts = list(phrases.gathered(iter([t]), 4000))
    assert pa.concat_tables(parts).equals(pa.Table.from_batches([t]).combine_chunks())
    assert all(p.nbytes <= 8000 or p.num_rows < 100 for p in parts) and len(parts) > 5


def test_texts_come_in_small_batches(spark, monkeypatch):
    """Neither stage of the count reads many rows of text at once."""
    seen, made = [], phrases.materialize

    def note(df, tag):
        seen.append((tag, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")))
        return made(df, tag)

    monkeypatch.setattr(phrases, "materialize", note)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    phrases.count_phrases(spark.createDataFrame([("x", "a b c")] * 12, "lang string, text string"))
    assert dict(seen)["phrases"] == str(phrases.CHUNK) and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
