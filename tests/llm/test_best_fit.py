import math
import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from layerlake.llm import binpack, queries
from layerlake.llm.encode import SegmentEncoder, vocabulary

SF = "/root/testdata/sf0.001"


def ids_of(text):
    return [*Tokenizer.from_file(vocabulary("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids, 1]


def test_fullest_is_the_best_of_all_combinations():
    r = random.Random(3)
    for _ in range(60):
        counts = {n: r.randint(1, 3) for n in r.sample(range(1, 60), 6)}
        room = r.randint(0, 90)
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        used = binpack.fullest(counts, sorted((n for n in counts if n <= room), reverse=True), room)
        assert sum(n * k for n, k in used) == max(s for s in sums if s <= room)
        assert all(k <= counts[n] for n, k in used)


def test_combinations_use_each_row_once():
    r = random.Random(5)
    for histogram in ({}, {7: 1}, {100: 9}, {64: 5, 36: 5, 1: 3}, {n: r.randint(1, 40) for n in range(1, 101)}):
        bins = binpack.combinations(histogram, 100)
        used = Counter()
        for times, parts in bins:
            assert sum(n * k for n, k in parts) <= 100
            for n, k in parts:
                used[n] += times * k
        assert used == histogram
    assert sum(t for t, _ in bins) <= fewest(histogram, 100) + 2


def fewest(histogram, capacity):
    """No packing has fewer bins: rows over half take a bin each, and those that fit beside none take it alone."""
    best = 0
    for a in range(capacity // 2 + 1):
        alone = sum(c for n, c in histogram.items() if n > capacity - a)
        large = {n: c for n, c in histogram.items() if capacity - a >= n > capacity / 2}
        rest = sum(n * c for n, c in histogram.items() if capacity / 2 >= n >= a)
        room = sum((capacity - n) * c for n, c in large.items())
        best = max(best, alone + sum(large.values()) + max(0, math.ceil((rest - room) / capacity)))
    return best


def test_places_name_every_row():
    histogram = {40: 7, 35: 4, 20: 11, 3: 50}
    bins = binpack.combinations(histogram, 100)
    runs = binpack.places(bins)
    rows = [n for n in sorted(histogram) for _ in range(histogram[n])]
    held = defaultdict(list)
    for i, n in enumerate(rows):
        r = np.searchsorted(runs["first"], i, "right") - 1
        k = i - runs["first"][r]
        assert runs["length"][r] == n
        held[runs["bin"][r] + k // runs["copies"][r]].append((runs["offset"][r] + k % runs["copies"][r] * n, n))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 100
    assert len(held) == sum(t for t, _ in bins)


def test_words_in_one_call_equal_the_library():
    enc = SegmentEncoder(vocabulary("word_bpe_49k.json"))
    words = [" ", " a", "über", " straße", "été", " don't", " x1", "ÿ", " " + "long" * 80, " ü", " İ", " ﬁn", ""] * 120
    for w, raw in zip(words, enc._library(words)):
        assert np.frombuffer(raw, "<u4").tolist() == enc.tok.encode(w, add_special_tokens=False).ids


def check_pieces(rows, texts, capacity):
    """Every id in one piece, whole documents unless longer, no gaps in a sequence."""
    left = Counter((d, i, len(p), zlib.crc32(array("I", p).tobytes())) for d, ids in texts for i, p in enumerate(ids[k : k + capacity] for k in range(0, len(ids), capacity)))
    assert left == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    held = defaultdict(list)
    for r in rows:
        assert r.start == r.piece * capacity
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(held)


def test_query_packs_documents_tightly(spark):
    rows = queries.op12_best_fit_packing(spark, SF).collect()
    texts = [(d.doc_id, ids_of(d.text)) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = check_pieces(rows, texts, 4096)
    assert n <= fewest(Counter(r.length for r in rows), 4096) + 1


@pytest.mark.parametrize("capacity", [8, 50])
def test_odd_rows(spark, capacity):
    rows = [(1, "one two three " * 40, "x"), (2, None, "x"), (None, "no id", None), (3, "", "x"), (5, "same", "y"), (5, "same", "y"), (6, "same", None), (7, "a" * 5000, "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, piece string").withColumnRenamed("piece", "offset")
    from pyspark.sql import functions as F

    got = binpack.pack_best_fit(d, capacity=capacity).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(got, [(r[0], ids_of(r[1])) for r in rows], capacity)
    assert binpack.pack_best_fit(d.limit(0)).collect() == []
