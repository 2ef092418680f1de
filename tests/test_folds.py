import random

import pytest
from pyspark.sql import functions as F

from layerlake.operators import prompts, transforms

TEMPLATE = "{accumulated}({step}/{total}:{label}={artifact}{accumulated2})".replace("{accumulated2}", "")


def table(spark, seed=1):
    r = random.Random(seed)
    rows = [(r.choice([1, 2, 3, 4, None]), r.choice(["a", "{step}", None]), r.choice(["x", None, "{label}"]), i) for i in range(120)]
    return rows, spark.createDataFrame(rows, "key long, label string, content string, at long").repartition(5)


def folded(rows, ask=lambda p: p):
    out = {}
    for key in {r[0] for r in rows}:
        own, said = sorted((r for r in rows if r[0] == key), key=lambda r: r[3]), "start"
        for i, (_, label, content, _) in enumerate(own):
            said = ask(f"{said}({i + 1}/{len(own)}:{label or ''}={content or ''})")
        out[key] = (said, len(own))
    return out


def test_fold_equals_a_loop(spark):
    rows, df = table(spark)
    got = prompts.fold_synthesis(df, "key", ["at"], TEMPLATE, lambda p: p[-40:], "start").collect()
    assert {r.key: (r.content, r.steps) for r in got} == folded(rows, lambda p: p[-40:]) and len(got) == 5
    plan = prompts.fold_synthesis(df, "key", ["at"], TEMPLATE, lambda p: p, "start")._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") >= 1
    assert prompts.fold_synthesis(df.limit(0), "key", ["at"], TEMPLATE, lambda p: p).collect() == []


def test_killed_fold_asks_for_no_step_again(spark, tmp_path):
    rows, df = table(spark, 2)
    log, stop, saved = tmp_path / "log", tmp_path / "stop", str(tmp_path / "saved")
    stop.touch()

    def ask(prompt):
        import os

        if "(17/" in prompt[-30:] and os.path.exists(stop):
            raise RuntimeError("worker lost")
        with open(log, "a") as f:
            f.write(prompt.replace("\n", " ")[-120:] + "\n")
        return prompt[-60:]

    run = lambda: prompts.fold_synthesis(df, "key", ["at"], TEMPLATE, ask, "start", saved).collect()
    with pytest.raises(Exception, match="worker lost"):
        run()
    first = log.read_text().splitlines()
    assert first
    stop.unlink()
    got = run()
    assert {r.key: (r.content, r.steps) for r in got} == folded(rows, lambda p: p[-60:])
    asked = log.read_text().splitlines()
    assert len(asked) == len(set(asked)) == len(rows)  # each step of each key once over both runs
    run()
    assert log.read_text().splitlines() == asked
    changed = df.withColumn("content", F.when(F.col("at") == df.agg(F.max("at")).first()[0], "new").otherwise(F.col("content")))
    prompts.fold_synthesis(changed, "key", ["at"], TEMPLATE, ask, "start", saved).collect()
    assert len(log.read_text().splitlines()) == len(asked) + 1  # only the changed last step


def test_copies_are_spread_over_prompts(spark):
    df = spark.createDataFrame([(f"r{i}", "same") for i in range(500)] + [("n", None)], "label string, content string")
    sizes = []

    def complete(asked):
        sizes.extend(r.input_count for r in asked.select("input_count").collect())
        return asked.select("label", F.sha2("prompt", 256).alias("content"))

    assert transforms.reduce_tree(df, complete, 20).count() == 1
    assert max(sizes) <= 20 and sum(sizes[:26]) == 501 and len(sizes) == 26 + 2 + 1


def test_null_texts_keep_their_sections(spark):
    df = spark.createDataFrame([("k", "a", None, 1), ("k", "b", "x", 2)], "key string, label string, text string, at int")
    g = transforms.group_body(df, F.col("key"), "label", "text", "at").first()
    assert g.body == "### a\n\n\n---\n\n### b\nx" and g.input_count == 2
    assert transforms.flat_text(df, "key", "at", "text").first().content == "\n\nx"
