"""Work of the near-dedup on groups of near copies whose far ends are not similar to the rest."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_filters import slow_components
from test_pipeline import shingles, similar

from layerlake.llm import simhash


def near_group(n, edits, base_too):
    r = random.Random(3)
    words = [f"w{i}" for i in range(20_000)]
    base = [r.choice(words) for _ in range(150)]
    out = [base] if base_too else []
    while len(out) < n:
        w = list(base)
        for i in r.sample(range(150), r.choice(edits)):
            w[i] = r.choice(words)
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("edits, base_too", [((1, 2, 3, 4, 5, 6), True), ((3,), False)])
def test_far_ends_do_not_meet_the_group(spark, monkeypatch, edits, base_too):
    texts = near_group(300, edits, base_too)
    seen, write = {}, simhash.materialize

    def watched(df, tag):
        seen[tag] = write(df, tag)
        return seen[tag]

    monkeypatch.setattr(simhash, "materialize", watched)
    got = simhash.keep_dissimilar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    roots = slow_components(list(range(len(texts))), [shingles(t) for t in texts], similar)
    assert sorted(r.doc_id for r in got) == sorted(set(roots))
    assert seen["pairs"].count() < (1 if base_too else 8) * len(texts)
    if base_too:
        met = seen["between"].groupBy("s").agg(F.expr("count(*) * count_if(root <> main)").alias("c")).agg(F.sum("c")).first()[0]
        assert (met or 0) < 4 * len(texts)


def test_sketches_differ_in_no_more_bits_than_sets():
    r = random.Random(1)
    for _ in range(200):
        a = {r.getrandbits(62) for _ in range(r.randint(0, 300))}
        b = {x for x in a if r.random() < 0.9} | {r.getrandbits(62) for _ in range(r.randint(0, 40))}
        x, y = (simhash.sketch(np.array(sorted(s), np.int64)).view(np.uint64) for s in (a, b))
        assert sum(int(v).bit_count() for v in x ^ y) <= len(a ^ b)
