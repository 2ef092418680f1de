"""The near-dedup stage of the pipeline against all pairs."""

import random

from test_filters import slow_components

import corpus_pipeline as cp


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(((r.doc_id, r.text) for r in cp.simhash_near_dedup(spark, df, "").collect()), key=str)


def test_similar_texts_beyond_the_radius(spark):
    r = random.Random(7)
    rows = []
    for i in range(60):
        base = [r.choice("abcdefghijklmnop") + str(r.randint(0, 99)) for _ in range(r.randint(3, 200))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(r.randint(0, 5)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = "new" + str(r.randint(0, 99))
            rows.append((len(rows), " ".join(w)))
    line = " every text holds this one line that many others hold too and more of it"
    rows = [(d, t + line * (d % 3)) for d, t in rows]
    roots = slow_components([d for d, _ in rows], [shingles(t) for _, t in rows], alike)
    want = [x for x, root in zip(rows, roots) if x[0] == root]
    assert 0 < len(want) < len(rows)
    assert run(spark, rows) == sorted(want, key=str)


def test_ids_shared_by_different_texts(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (1, b), (2, b), (1, a), (None, c), (None, a), (None, b + " x"), (3, a)]
    assert run(spark, rows) == sorted([(1, a), (1, b), (None, c)], key=str)
