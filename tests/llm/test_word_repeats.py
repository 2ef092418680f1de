"""Repeated passages of over 50 words in the pipeline's suffix stage, against all windows."""

import random

import corpus_pipeline as cp


def slow(texts, window=51):
    words = [t.split() for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def test_passages_of_51_words(spark):
    r = random.Random(11)

    def words(n):
        return [r.choice("abcdefgh") + str(r.randint(0, 99)) for _ in range(n)]

    shared = [words(n) for n in (50, 51, 54, 60, 90)]  # all under 400 bytes
    texts = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(0, 3)):
            parts += words(r.randint(5, 60)) + r.choice(shared)[r.choice((0, 0, 0, 3)) :]
        texts.append(r.choice((" ", "\n")).join(parts + words(5)))
    texts += [texts[-1], "x " * 120, ""]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = slow([x[1] for x in rows])
    got = [(x.doc_id, x.text.split()) for x in cp.suffix_array_dedup(spark, df, "").collect()]
    assert sum(map(len, want)) < sum(len(x[1].split()) for x in rows)
    assert sorted(got) == sorted((x[0], w) for x, w in zip(rows, want))
