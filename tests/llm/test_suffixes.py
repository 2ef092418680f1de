import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from layerlake.llm import suffixes

SF = "/root/testdata/sf0.001"


def slow(texts, window):
    """kept bytes and numbers of removed runs, from all windows of all texts."""
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for i in range(len(r) - window + 1):
            seen[r[i : i + window]] = seen.get(r[i : i + window], 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        runs = sum(1 for i in range(len(r)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(r), sum(gone), runs, bytes(c for c, g in zip(r, gone) if not g)))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, h long")
    rule = suffixes.Rule(kw.pop("window", 400), kw.pop("gram", 50))
    got = suffixes.remove_repeats(df, rule, **kw).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str)


def want(rows, window):
    return sorted(((d, *x) for (d, _), x in zip(rows, slow([t for _, t in rows], window))), key=str)


@given(st.lists(st.tuples(st.text("ab", min_size=9, max_size=40), st.integers(1, 3)), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_two_stage_order(groups):
    for words in (False, True):
        rule = suffixes.Rule(8, 3, words)
        regions = [(rule.units((" ".join(t) if words else t).encode()), len(t) - 7) for t, _ in groups]
        order = suffixes.two_stage_suffixes(regions, rule)
        got = list(map(tuple, order.tolist()))
        assert sorted(got) == [(r, p) for r, (_, n) in enumerate(regions) for p in range(n)]
        keys = [regions[r][0][p * rule.size : (p + 8) * rule.size] for r, p in got]
        assert keys == sorted(keys)
        common = [next((i for i in range(8) if a[i * rule.size : (i + 1) * rule.size] != b[i * rule.size : (i + 1) * rule.size]), 8) for a, b in zip(keys, keys[1:])]
        assert suffixes.adjacent_prefixes(regions, order, rule).tolist() == [0, *common]


def test_repeated_places():
    """Windows of regions with weights, of bytes and of words, against counting every window."""
    r = random.Random(2)
    for _ in range(600):
        rule = suffixes.Rule(6, 3, r.random() < 0.4)
        regions = {}
        for _ in range(r.randint(1, 5)):
            n = r.randint(1, 30)
            t = [r.choice("ab") for _ in range(n + 5)]
            regions[rule.units((" ".join(t) if rule.words else "".join(t)).encode())] = (n, r.randint(1, 2))
        seen = {}
        for u, (n, k) in regions.items():
            for p in range(n):
                w = u[p * rule.size : (p + 6) * rule.size]
                seen[w] = seen.get(w, 0) + k
        want = [[seen[u[p * rule.size : (p + 6) * rule.size]] > 1 for p in range(n)] for u, (n, _) in regions.items()]
        assert [x.tolist() for x in suffixes.repeated_places([(u, *x) for u, x in regions.items()], rule)] == want


@given(st.text("ab", max_size=200) | st.text("a", max_size=100) | st.text("abcdefgh", max_size=200))
@settings(max_examples=200, deadline=None)
def test_equal_windows_share_a_run_hash(t):
    h, p, n, g = suffixes.window_runs(t.encode(), 20, 5)
    known = {}
    for k, a, m, x in zip(h.tolist(), p.tolist(), n.tolist(), g.tolist()):
        for i in range(a, a + m):
            assert known.setdefault(t[i : i + 20], (k, x - i)) == (k, x - i)
    assert n.sum() == max(0, len(t) - 19)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = "".join(random.Random(3).choice("abcdé \n") for _ in range(900))
    rows += [(10**6, None), (10**6 + 1, ""), (None, odd), (10**6 + 2, "x" * 1000), (10**6 + 3, odd[100:700] + "tail"), (10**6 + 4, "ab" * 300), (10**6 + 5, odd), (10**6 + 5, odd), (10**6 + 6, "y" * 400), (10**6 + 7, "z" * 399)]
    assert run(spark, rows) == want(rows, 400)


@pytest.mark.parametrize("hot", [10, 200, 400_000])
def test_small_windows(spark, hot):
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(10, 300))) for _ in range(15)]
    rows = []
    for i in range(80):
        parts = [r.choice(base) for _ in range(r.randint(0, 4))]
        t = r.choice(["", "#"]).join(p[r.randint(0, 20) : r.randint(30, 300)] for p in parts)
        rows.append((i, t + r.choice(["", "é", "q" * 60, "common line of text " * 2])))
    assert run(spark, rows, window=40, gram=8, hot_windows=hot) == want(rows, 40)


def test_empty(spark):
    assert run(spark, []) == []


def slow_passages(texts, window=51):
    """Bytes in passages of ``window`` words and more that start elsewhere too, and the words outside them."""
    import re

    places = [[m.span() for m in re.finditer(rb"\S+", (t or "").encode())] for t in texts]
    words = [tuple((t or "").encode()[a:b] for a, b in p) for t, p in zip(texts, places)]
    seen = {}
    for w in words:
        for i in range(len(w) - window + 1):
            seen[w[i : i + window]] = seen.get(w[i : i + window], 0) + 1
    out = []
    for w, p in zip(words, places):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[w[i : i + window]] > 1:
                gone.update(range(i, i + window))
        n = sum(p[i][1] - (p[i][0] if i - 1 not in gone else p[i - 1][1]) for i in gone)
        out.append((n, [x for i, x in enumerate(w) if i not in gone]))
    return out


@pytest.mark.parametrize("hot", [10, 400_000])
def test_words(spark, hot):
    """Passages of words, alone and noted beside strings of bytes; extra columns may have any name."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    r = random.Random(7)
    shared = [[r.choice("abcdefgh") + str(r.randint(0, 99)) for _ in range(n)] for n in (50, 51, 60, 90)]
    for i in range(40):
        own = ["".join(r.choice("xyz") for _ in range(6)) for _ in range(30)]
        rows.append((10**5 + i, r.choice((" ", "\n", " \t")).join(own[:15] + r.choice(shared)[r.choice((0, 0, 1)) :] + own[15:])))
    rows += [(10**6, None), (10**6 + 1, ""), (None, "x " * 120), (10**6 + 2, "é " * 60), (10**6 + 2, "é " * 60), (10**6 + 3, "x " * 50)]
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, h long, spans string")
    want = slow_passages([t for _, t in rows])
    got = suffixes.remove_repeats(df, suffixes.PASSAGES, hot_windows=hot, carry=("spans", "h")).collect()
    assert sorted(((x.doc_id, x.n_removed, x.kept.split(), x._0, x._1) for x in got), key=str) == sorted(
        ((d, n, [w.decode() for w in left], "s", 1) for (d, _), (n, left) in zip(rows, want)), key=str
    )
    both = suffixes.remove_repeats(df, suffixes.BYTES, note=suffixes.PASSAGES, hot_windows=hot).collect()
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_noted) for x in both), key=str) == sorted(
        ((d, n, m, k) for (d, _), (n, m, *_), (k, _) in zip(rows, slow([t for _, t in rows], 400), want)), key=str
    )
