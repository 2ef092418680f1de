import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from layerlake.llm import decontam, licenses, quality, rules, simhash

SF = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, fp string, items string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "x", None) for d, t in rows], EXTRA)


ODD = [(1, None), (2, ""), (None, "no id here at all"), (3, "a b c x\x1cy\tz"), (4, "same words here again today"), (4, "same words here again today"), (5, "long " * 30000), (6, "\n\n \n")]


def all_docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(d + 10**6 if d else d, t) for d, t in ODD]


def slow_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def slow_components(ids, values, linked):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(values[i], values[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(ids))]


def test_simhash(spark):
    rows = all_docs(spark)
    fps = [slow_fp(t) for _, t in rows]
    want = slow_components([d for d, _ in rows], fps, lambda a, b: bin(a ^ b).count("1") <= 4)
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, want)), key=key)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20), st.data())
@settings(max_examples=60, deadline=None)
def test_links(base, data):
    fp = set(base)
    for _ in range(data.draw(st.integers(0, 120))):
        x = data.draw(st.sampled_from(base))
        for b in data.draw(st.lists(st.integers(0, 63), max_size=5)):
            x ^= 1 << b
        fp.add(x)
    fp = np.array(sorted(fp), np.uint64)
    want = slow_components(fp.tolist(), fp.tolist(), lambda a, b: bin(a ^ b).count("1") <= 4)
    for small in (4, 64):
        simhash.SMALL = small
        links = []
        for m in simhash.masks(6):
            k = fp & np.uint64(m)
            o = np.argsort(k, kind="stable")
            links += zip(*(x.tolist() for x in simhash.link_buckets(k[o], fp[o])))
        links = {frozenset(x) for x in links}
        got = slow_components(fp.tolist(), fp.tolist(), lambda a, b: frozenset((a, b)) in links)
        assert got == want
    simhash.SMALL = 64


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=4), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_fm_index(seq, patterns):
    index = decontam.FMIndex(np.array(seq), 4)
    m = np.zeros((len(patterns), 4), np.int64)
    for r, p in enumerate(patterns):
        m[r, : len(p)] = p
    lo, hi = index.search(m, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, lo, hi):
        want = [i for i in range(len(seq)) if seq[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist() if b > a else []) == want


def slow_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def slow_contamination(rows, items):
    out = []
    windows = {}
    for i, t in items:
        w = slow_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    for d, t in rows:
        w = slow_words(t)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                who = windows.get(tuple(w[k : k + n]))
                if who:
                    hit.update(range(k, k + n))
                    found |= who
        f = sorted(found)
        out.append((d, len(w), len(hit), len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [16_000_000, 700])
def test_decontamination(spark, block):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, "Hello, WORLD"), (901, "zebra"), (902, None), (903, "..."), (904, "hello world"), (905, "Ärger über x")]
    rows = [*all_docs(spark), (77, "say hello-world zebra zebra! Hello"), (78, "ärger über x Ärger über x"), (5000079, items[0][1] + " tail " + items[0][1])]
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_contamination(docs(spark, rows), b, shard_bytes=50_000, block_bytes=block)
    # rows that are repeated are merged by document where several blocks are
    assert sorted(map(tuple, decontam.contamination_digest(found).collect()), key=str) == slow_contamination(rows, items)
    for r in found.where("doc_id = 5000079").collect():
        assert decontam.remove_spans(r.text, decontam.merge([(s.a, s.b) for s in r.spans])).strip(" .\n") == "tail"
    assert decontam.find_contamination(docs(spark, []), b).count() == 0
    assert decontam.find_contamination(docs(spark, rows), b.limit(0)).where("size(items) > 0").count() == 0


def slow_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    rep = set()
    seen = {}
    for i, x in enumerate(wins):
        seen.setdefault(x, []).append(i)
    for p in seen.values():
        if len(p) > 1:
            for i in p:
                rep.update(range(i, i + 5))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))


def test_rules(spark):
    rows = [*all_docs(spark), (70, "a b c d e f a b c d e x a b c d e f"), (71, "one # two\none # two\n one # two")]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = rules.apply_rules(docs(spark, rows), labels).collect()
    want = []
    for d, t in rows:
        s = slow_stats(t)
        want.append((d, *s, s[0] < 10 or 100 * s[4] > 20 * s[0]))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert not any(r.kept and r.base_failed for r in got)
    quality_of = {r.doc_id: r.quality for r in labels.collect()}
    kept = {r.doc_id: r.kept for r in got}
    good = [kept[d] for d, q in quality_of.items() if q == 1]
    bad = [kept[d] for d, q in quality_of.items() if q == 0]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.5
    assert rules.apply_rules(docs(spark, []), labels).count() == 0
    assert rules.apply_rules(docs(spark, rows), labels.limit(0)).count() == len(rows)


def test_quality(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality.score_quality(d, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    test = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p == q for p, q in test) / len(test) > 0.85
    # ranking: a good held-out text is above a bad one in this share of pairs
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.9
    # one very long labelled text does not use up its class's sample
    first = labels.where("quality = 0").orderBy("doc_id").first().doc_id
    long = spark.createDataFrame([(first, "lorem ipsum " * 200_000, "x", None)], EXTRA)
    assert quality.fit(docs(spark, [(r.doc_id, r.text) for r in d.collect()]).unionByName(long), labels, max_bytes=2_000_000).w is not None
    odd = quality.score_quality(docs(spark, ODD), labels).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert quality.score_quality(docs(spark, []), labels.limit(0)).count() == 0


def test_rules_verdict(spark):
    """The whole verdict from the forest's own trees, walked one by one, and one row for each labelled id."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    d = d.unionByName(d.where("doc_id < 20"))
    forest, cut = rules.fit_forest(d, labels)
    deep = forest._mean_path(forest.sample)

    def score(x):
        total = 0.0
        for nodes in forest.trees:
            at = 0
            while nodes[at][0] >= 0:
                at = int(nodes[at][2] if x[int(nodes[at][0])] <= nodes[at][1] else nodes[at][3])
            total += nodes[at][1]
        return 2 ** (-total / len(forest.trees) / deep)

    got = rules.apply_rules(d, labels).collect()
    text = {r.doc_id: r.text for r in d.collect()}
    assert len(got) == d.count()
    for r in got[::7]:
        stats = rules.text_stats(text[r.doc_id])
        failed = stats[0] < 10 or 100 * stats[4] > 20 * stats[0]
        s = score(stats[5:])
        assert (r.base_failed, round(r.anomaly, 9)) == (failed, round(s, 9)) and r.kept == (not failed and s <= cut)


def test_licenses(spark):
    mit = "\n".join("// " + x for x in [
        "The MIT License", "", "Permission is hereby granted, free of charge, to any person obtaining a copy", 'of this software and associated documentation files (the "Software"), to deal',
        "in the Software without restriction, including without limitation the rights", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell", "copies of the Software, and to permit persons to whom the Software is", "furnished to do so, subject to the following conditions:", "",
        "The above copyright notice and this permission notice shall be included in all", "copies or substantial portions of the Software.", "",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR', "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,", "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."])
    rows = [(1, mit), (2, "some text\nLicensed under CC BY-NC 4.0.\nmore"), (3, "Word. Licensed under the Apache License, Version 2.0."), (4, "this mentions the mit license in passing"),
            (5, "as the gpl2-later\nThis Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."), *[(d + 100 if d else d, t) for d, t in ODD]]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got[1].licenses == "MIT" and got[1].sentence_ids == "mit-name,mit-grant,mit-notice,as-is"
    assert (got[2].licenses, got[2].restricted) == ("CC-BY-NC-4.0", True)
    assert got[3].licenses == "Apache-2.0" and got[4].n_licenses == 0 and got[5].licenses == "MPL-2.0"
    assert got[101].n_sentences == 0 and licenses.scan_licenses(docs(spark, [])).count() == 0
    # every document with a planted notice, and no other
    notice = re.compile(r"(?m)(^|[.!?:;]\s+)(This work is licensed under the GNU General Public License, version 3\.|Licensed under CC BY-NC 4\.0\.|Licensed under the Apache License, Version 2\.0\.|Released under the MIT License\.)")
    all_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id for r in licenses.scan_licenses(all_).where("n_licenses > 0 and licenses <> 'proprietary'").collect()}
    assert found == {r.doc_id for r in all_.collect() if notice.search(r.text or "")}


def test_quality_figures(spark):
    """The README's figures: 990 held-out rows of sf0.1; the inputs are chosen on training rows."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(d, labels)
    held = d.join(labels, "doc_id").where(quality.held_out_column()).select("text", "quality").collect()
    scores = model.score(quality.Compressors(model.good, model.bad), [r.text or "" for r in held])
    good, bad = (np.sort([s for s, r in zip(scores, held) if r.quality == q]) for q in (1, 0))
    above = (np.searchsorted(bad, good, "left") + np.searchsorted(bad, good, "right")).sum() / 2 / (len(good) * len(bad))
    right = np.mean([(s >= 0.7) == (r.quality == 1) for s, r in zip(scores, held)])
    print(len(held), above, right)
    assert len(held) == 990 and model.inputs == 3
    assert abs(above - 0.986) < 0.001 and abs(right - 0.991) < 0.001


def test_inputs_are_chosen_by_cross_validation():
    r = np.random.default_rng(3)
    y = (r.random(400) > 0.5).astype(float)
    x = np.column_stack([y + r.normal(0, 0.7, 400), r.normal(0, 1, 400), r.normal(0, 1, 400)])
    assert quality.inputs_for(x, y) == 1  # noise adds nothing
    x[:, 2] = y + r.normal(0, 0.2, 400)
    assert quality.inputs_for(x, y) == 3


def test_threshold_is_counted_over_all_labelled_rows(spark):
    """As one sorted pass over every row has it; no parameter bounds the rows."""
    rng = np.random.default_rng(5)
    score, good = np.round(rng.random(3000), 2), rng.random(3000) < 0.7
    score[~good] += 0.3
    rows = [(i, float(s), int(g)) for i, (s, g) in enumerate(zip(score, good))]
    t = rules.materialize(spark.createDataFrame(rows, "doc_id long, score double, good long").repartition(4), "test-scored")
    for lost in (0.005, 0.2):
        best = min(
            (round((good & (score > c)).sum() / good.sum() + (~good & (score <= c)).sum() / (~good).sum(), 12), c)
            for c in np.unique(score)
            if (good & (score > c)).sum() / good.sum() <= lost
        )
        assert rules.threshold(t, lost) == best[1]
    assert "max_rows" not in rules.fit_statistics.__code__.co_varnames


def test_decontamination_has_one_pass(spark):
    """One Python stage searches and cuts; the cut texts are those of the spans."""
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words), "x"), (2, None, "y"), (3, "only " + " ".join(words[:5]), None)], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([("a", " ".join(words[5:16]))], "item_id string, text string")
    clean = decontam.decontaminate(docs, bench)
    assert clean._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = {(1, " ".join(words[:5]) + "  " + " ".join(words[16:]), "x"), (2, "", "y"), (3, "only " + " ".join(words[:5]), None)}
    assert {tuple(r) for r in clean.collect()} == want
    assert {tuple(r) for r in decontam.decontaminate(docs, bench, block_bytes=20).collect()} == want
