import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from layerlake.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, least_length=6, least=5, every=199, times=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % every == 0 else w] += 1
    words = {w: c for w, c in n.items() if len(w) >= least_length and c >= least}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= times * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


@pytest.mark.parametrize("alphabet", ["ab", "abcé", "abcdefghijklmnopqrstuvwxyzßàÿ÷"])
def test_tries_against_all_pairs(alphabet):
    r = random.Random(len(alphabet))
    words = sorted({"".join(r.choice(alphabet) for _ in range(r.randint(1, 9))) for _ in range(400)} | {"a" * 300, "a" * 301, "a" * 299 + "b"})
    asked = [*words, "", "zzzzzzz", "a" * 302]
    i, j = spelling.Trie(words, np.ones(len(words))).near(asked)
    got = list(zip(i.tolist(), j.tolist()))
    assert len(set(got)) == len(got)
    assert set(got) == {(x, y) for x, a in enumerate(asked) for y, b in enumerate(words) if one_edit(a, b)}


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int")


def texts(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abÀé") for _ in range(r.randint(5, 8))) for _ in range(60)]
    rows = [(i, " ".join(r.choice(words[: r.randint(1, 60)]) + r.choice(["", "s", "-", "X", "1"]) for _ in range(80))) for i in range(60)]
    return [*rows, (None, "abcdefg " * 30), (7, None), (8, ""), (9, "..,"), (3, "abcdeg " * 6), *rows[:5], (10, "q" * 5000 + " " + ("q" * 4999 + "r ") * 40)]


@pytest.mark.parametrize("options", [{}, {"every": 3}, {"least_length": 1, "least": 1}])
def test_query_against_all_pairs(spark, options):
    rows = texts(4)
    got = [tuple(x) for x in spelling.spelling_variants(frame(spark, rows), **options).collect()]
    assert len(set(got)) == len(got)
    assert set(got) == brute(rows, **options)


def test_many_tries_and_rounds(spark):
    words = sorted({w for w, *_ in brute(texts(5), least=1)})
    r = random.Random(1)
    n = {w: r.randint(1, 9) for w in words}
    got = spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), trie_letters=60, round_letters=200).collect()
    want = {}
    for w in words:
        near = [x for x in words if one_edit(w, x)]
        if near:
            best = min(near, key=lambda x: (-n[x], x))
            want[w] = (len(near), best, n[best])
    assert {x.word: (x.n_near, x.form, x.form_n) for x in got} == want and len(got) == len(want)


def test_roots_follow_long_chains(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w0"), ("y", "w36")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {w: "w37" for w, _ in links}


def test_nothing(spark):
    assert spelling.spelling_variants(frame(spark, [(1, None), (2, "a b")])).collect() == []
    assert spelling.spelling_variants(frame(spark, [(1, "x")]).limit(0)).collect() == []


def test_query_equals_sql(spark):
    got = queries.op13_spelling_variants(spark, SF)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql = f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES['op13_spelling_variants']})"
    rows = c.execute(sql).fetchall()
    assert len(rows) > 100
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows))
