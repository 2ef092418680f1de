"""The near-dedup of the pipeline against all pairs, on groups whose similarities lie on both sides of 0.8."""

import random

import pytest
from test_filters import slow_components
from test_pipeline import shingles, similar

from layerlake.llm import simhash


def group(r, n_words, copies, edits, vocabulary):
    base = [r.choice(vocabulary) for _ in range(n_words)]
    out = [base]
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            i = r.randrange(len(w))
            kind = r.random()
            if kind < 0.6:
                w[i] = r.choice(vocabulary)
            elif kind < 0.8:
                del w[i]
            else:
                w.insert(i, r.choice(vocabulary))
        out.append(w[: r.choice((len(w), len(w), len(w) - 8))])
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("most", [0, 100_000])
def test_near_copies_of_every_distance(spark, monkeypatch, most):
    """Also without any common shingles put last: the order of shingles does not change the result."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for n, copies, edits in ((150, 120, 6), (60, 60, 4), (30, 40, 3), (400, 40, 14), (12, 30, 2), (6, 20, 1), (5, 6, 1), (3, 6, 1)):
        texts += group(r, n, copies, edits, words)
    passage = " ".join(r.choice(words) for _ in range(60))
    texts += [" ".join(r.choice(words) for _ in range(r.randint(5, 90))) + " " + passage for _ in range(60)]
    texts += [texts[3], texts[3].upper(), "", "", None, "a", "A", "a b", "\t \n"]
    rows = [(i if i % 17 else None, t, i) for i, t in enumerate(texts)] + [(5, texts[5], 5)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, root long")
    if not most:
        monkeypatch.setattr(simhash, "_common_shingles", lambda *a, **k: __import__("numpy").zeros(0, "int64"))
    kept = simhash.keep_dissimilar(df)
    assert kept.columns == df.columns
    got = kept.collect()
    # components over all pairs; the representative is counted by component, as ids may be null
    sets = [shingles(t) for _, t, _ in rows]
    roots = slow_components(list(range(len(rows))), sets, similar)
    where = {}
    for (_, _, i), c in zip(rows, roots):
        where[i] = c
    assert sorted(where[x.root] for x in got) == sorted(set(roots))
    best = {}
    for (d, _, _), c in zip(rows, roots):
        best[c] = min(best.get(c, (True, 0)), (d is None, d or 0))
    assert {where[x.root]: (x.doc_id is None, x.doc_id or 0) for x in got} == best
