"""The licence recogniser against a plain search of every sentence at every word, and every rule tried in turn."""

import random
import re

from layerlake.llm.licenses import ALONE, NAMED, RULES, SENTENCES, SHORT, Recogniser, scan_licenses


def words(text):
    return re.findall(r"[a-z0-9]+", text.lower().replace("licence", "license"))


def denied(before):
    """Whether one of the last words before a sentence, at most two words away from it, takes it back."""
    said = [(["not"],), (["never"],), (["cannot"],), (["formerly"],), (["previously"],), (["no", "longer"],), (["used", "to", "be"],), (["was", "once"],), (["were", "once"],)]
    ends = [before[: len(before) - back] for back in range(3)]
    if any(e[-2:-1] == ["not"] and e[-1] in ("only", "just", "merely") for e in ends if e):
        return False
    return any(e[-len(w) :] == w for e in ends for (w,) in said)


def slow_identify(text):
    known = {k: words(s) for k, s in SENTENCES.items()} | {f"spdx-{n}": words(f"SPDX-License-Identifier: {n}") for n, _, _ in RULES if n not in ALONE}
    flat, begins = [], set()
    for piece in re.split(r"[\n\r.!?:;]", text):
        begins.add(len(flat))
        flat += words(piece)
    out, i = [], 0
    while i < len(flat):
        best = max(((len(w), k) for k, w in known.items() if flat[i : i + len(w)] == w and (len(w) >= SHORT or i in begins)), default=None)
        start = max(b for b in begins if b <= i)
        if best and (best[0] > NAMED or best[1].startswith("spdx-") or not denied(flat[start:i])):
            out.append(best[1])
        i += best[0] if best else 1
    return out


def slow_match(ids):
    """Longest rules first; a rule takes the first sentences that are left, in its order."""
    out, left = [], list(ids)
    tags = sorted({(n, (f"spdx-{n}",), x) for n, _, x in RULES if n not in ALONE})
    for name, need, restricted in sorted([*RULES, *tags], key=lambda r: -len(r[1])):
        while True:
            places, at = [], 0
            for k in need:
                while at < len(left) and left[at] != k:
                    at += 1
                places.append(at)
                at += 1
            if places[-1] >= len(left):
                break
            left = ["" if i in places else k for i, k in enumerate(left)]
            out.append((name, restricted))
    others = {x for x in out if x[0] not in ALONE}
    return others or set(out)


def test_against_plain_search():
    r, fast = random.Random(3), Recogniser()
    every = list(SENTENCES.values()) + ["SPDX-License-Identifier: MIT", "SPDX-License-Identifier: GPL-3.0-or-later"]
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 7)):
            s = r.choice(every)
            cut = s.split()
            s = r.choice((s, s, s.upper(), " ".join(cut[: len(cut) // 2]), "\n * ".join(cut), s.replace("License", "Licence")))
            parts.append(r.choice(("", "This is ", "we said that ", "// ")) + s)
        for rule in r.sample(RULES, 2):
            parts += [SENTENCES[k] for k in rule[1]]
        text = r.choice((". ", "\n", "; ", " ")).join(parts)
        ids = fast.identify(text)
        assert ids == slow_identify(text)
        assert set(fast.match(ids)) == slow_match(ids)


def test_every_rule():
    r = Recogniser()
    for name, need, restricted in RULES:
        assert r.match(r.identify("\n".join(f"# {SENTENCES[k]}." for k in need))) == [(name, restricted)]
    assert len({n for n, *_ in RULES}) >= 40


def test_known_cases(spark):
    bsd = "\n".join(SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"))
    rows = [
        (1, f"Copyright (c) 2020, Somebody\nAll rights reserved.\n\n{bsd}", "BSD-3-Clause", False),
        (2, "This is licensed under the MIT License.", "MIT", False),
        (3, "All rights reserved.", "proprietary", True),
        (4, "he said all rights reserved, and left", "", False),
        (5, SENTENCES["cc0-dedicated"], "CC0-1.0", False),
        (6, "This library is free software; " + SENTENCES["lgpl21-later"], "LGPL-2.1-or-later", True),
        (7, "\n".join(SENTENCES["mit-grant"].split()) + "\n" + SENTENCES["mit-notice"], "MIT", False),
        (None, None, "", False),
    ]
    df = spark.createDataFrame([(d, t, "x") for d, t, *_ in rows], "doc_id long, text string, licenses string")
    got = {x.doc_id: (x.licenses, x.restricted) for x in scan_licenses(df).collect()}
    assert got == {d: (n, x) for d, _, n, x in rows}
