import time

import pytest

from layerlake.functions.text import search_tokens
from layerlake.operators import catalog, checks, completer, search, validate
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"ungrounded": [{"claim": "a", "suggestion": "b"}, {"claim": "c", "sugg', 1),
        ('{"ungrounded": [{"claim": "a}]{", "suggestion": "\\"]}"}, {"claim": "c", "suggestion": "d"}', 2),
        ('{"x": [{"claim": "no", "suggestion": "no"}], "ungrounded": [{"claim": "a", "suggestion": {"n": [1]}}', 1),
        ('{"ungrounded": [', 0),
        ("nothing", 0),
        ("", 0),
    ],
)
def test_complete_objects_of_a_cut_array(text, want):
    assert len(validate.whole_objects(text, "ungrounded")) == want


def test_every_cut_of_an_answer(spark):
    whole = '```json\n{"ungrounded": [{"claim": "a \\"x\\" [", "suggestion": "s"}, {"suggestion": "t", "claim": "b"}]}\n```'
    rows = spark.createDataFrame([(f"d-{i}", "text", f"id{i}") for i in range(len(whole) + 1)], "label string, content string, artifact_id string")
    complete = lambda a: a.select("label", F.expr(f"substring('{whole.replace(chr(92), chr(92) * 2)}', 1, cast(substring(label, 3) as int))").alias("content"))
    got = {}
    for r in validate.ungrounded_claims(rows, "{content}", complete).collect():
        got.setdefault(int(r.label[2:]), []).append(r.metadata.get("claim"))
    first, second = whole.index("}, {") + 1, whole.index("}]}") + 1
    for i in range(len(whole) + 1):
        want = [] if i < first else ['a "x" ['] if i < second else ['a "x" [', "b"]
        assert sorted(got[i], key=str) == sorted(want or [None], key=str), i


def requests(spark, n):
    return completer.requests(spark.range(n), "id", F.concat(F.lit("p"), "id")).coalesce(1)


def test_pool_keeps_order_deadlines_and_answers(spark, tmp_path):
    log, saved = tmp_path / "log", str(tmp_path / "saved")
    reqs = requests(spark, 24)

    def send(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if prompt == "p3":
            time.sleep(30)
        if prompt == "p5":
            raise ValueError("bad input")
        time.sleep(0.3)
        return prompt.upper()

    begun = time.time()
    rows = {r.request_id: r for r in completer.call(reqs, send, workers=8, deadline_s=2, saved=saved).collect()}
    assert time.time() - begun < 20
    by = {r.label: rows[r.request_id] for r in reqs.collect()}
    assert by[3].error == "timed out after 2 s" and by[5].error == "bad input"
    assert all(by[i].content == f"P{i}" for i in range(24) if i not in (3, 5))
    assert len(log.read_text().split()) == 24
    again = completer.call(requests(spark, 25), lambda p: (open(log, "a").write(p + "\n"), p.upper())[1], saved=saved).where("error is null").count()
    assert again == 25 and sorted(log.read_text().split()[24:]) == ["p24", "p3", "p5"]


def test_only_rate_limits_are_sent_again(spark, tmp_path):
    log = tmp_path / "log"

    def send(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        said = log.read_text().split()
        if prompt == "p0" and said.count("p0") < 3:
            raise RuntimeError("429 too many")
        if prompt == "p1":
            raise RuntimeError("broken")
        if prompt == "p2":
            raise RuntimeError("Rate limit")
        return "ok"

    rows = completer.call(requests(spark, 3), send, retries=2, pause_s=0.01).collect()
    assert sorted((r.content or "", r.error or "") for r in rows) == [("", "Rate limit"), ("", "broken"), ("ok", "")]
    said = log.read_text().split()
    assert [said.count(f"p{i}") for i in range(3)] == [3, 1, 3]


def test_folding_of_letters_beyond_latin_1(spark):
    rows = ["Čapek Łódź", "caf" + "é" + " x", "Ñandú ǆ", "ŠKODA ệ ø ß", "Ἀθήνα й"]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(search_tokens(F.col("t")).alias("ts"))
    got = [r.ts for r in df.collect()]
    assert got[:2] == [["capek", "łodz"], ["cafe", "x"]]
    assert got[2][0] == "nandu" and got[3] == ["skoda", "ệ", "ø", "ß"]
    for text, ts in zip(rows, got):
        assert [t for w in text.split() for t in search.folded(w)] == ts


def test_shown_keys_and_prefixes(spark):
    df = spark.createDataFrame([("sk-12345678abcd",), ("12345678",), ("",), (None,)], "k string").select(checks.mask_key(F.col("k")).alias("s"))
    assert [r.s for r in df.collect()] == ["sk-1...abcd", "****", "****", None]
    arts = spark.createDataFrame([("ab", "sha256:aa11"), ("abc", "sha256:aa22"), ("zz", "sha256:ab33")], "label string, artifact_id string")
    asked = spark.createDataFrame([(x,) for x in ("ab", "abc", "a", "sha256:aa1", "aa2", "q", "aa", "")], "prefix string")
    got = {r.prefix: (r.label, r.state) for r in catalog.resolve_prefix(arts, asked).collect()}
    assert got == {"ab": ("ab", "found"), "abc": ("abc", "found"), "a": (None, "ambiguous"), "sha256:aa1": ("ab", "found"), "aa2": ("abc", "found"), "q": (None, "absent"), "aa": (None, "ambiguous"), "": (None, "ambiguous")}
    assert catalog.resolve_prefix(arts, asked.limit(0)).collect() == []
