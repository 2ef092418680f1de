import json
import random

import pytest

from layerlake.sources.json_list import json_records, scan


def value(r, depth=0):
    kind = r.randint(0, 6 if depth < 3 else 3)
    if kind == 0:
        return r.choice(["", "}", '"', "\\", '\\"}{[', "é}{" * r.randint(0, 6), "]\n[", "x" * r.randint(0, 80)])
    if kind < 4:
        return r.choice([1, None, True, 2.5])
    if kind < 5:
        return [value(r, depth + 1) for _ in range(r.randint(0, 3))]
    return {r.choice(["a", "}", '"', "b{"]) + str(i): value(r, depth + 1) for i in range(r.randint(0, 4))}


def record(r, i):
    return {"id": i, "v": value(r), "w": value(r)}


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    had = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in had.items():
        spark.conf.set(k, v)


def read(spark, *paths):
    rows = sorted(json_records(spark, [str(p) for p in paths]).collect(), key=lambda r: (r.path, r.nth if r.nth is not None else 1 << 60))
    return {p.name: [(None if r.record is None else json.loads(r.record) if not r.error else r.record, r.error) for r in rows if r.path.endswith("/" + p.name)] for p in paths}


def test_scan_of_both_states():
    assert scan('[{"a": "}"}, {', False, 0, True) == (False, 2, [(1, 11), (13, -1)])
    assert scan('x}"}, {"b": 1}', True, 2, True) == (False, 1, [(-1, 4), (6, 14)])
    assert scan('a\\"}', True)[0]


def test_lists_equal_a_reader_of_whole_files(spark, tmp_path, small_ranges):
    r = random.Random(4)
    lists = {f"{n}.json": [record(r, i) for i in range(k)] for n, k in (("a", 60), ("b", 1), ("c", 0), ("d", 25))}
    lists["e.json"] = [{"id": 0, "v": "}" * 5000}, {"id": 1, "v": "{[" * 2000}, {"id": 2}]
    for i, (name, rows) in enumerate(lists.items()):
        (tmp_path / name).write_text(json.dumps(rows, indent=i % 3 or None, ensure_ascii=bool(i % 2)) + "\n" * (i % 2))
    got = read(spark, *[tmp_path / n for n in lists])
    for name, rows in lists.items():
        assert got[name] == [(x, None) for x in rows], name
    parts = spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions()
    assert parts > 4


def test_broken_files_keep_what_is_whole(spark, tmp_path, small_ranges):
    r = random.Random(7)
    rows = [record(r, i) for i in range(40)]
    text = json.dumps(rows)
    (tmp_path / "whole.json").write_text(text)
    (tmp_path / "object.json").write_text(json.dumps({"a": rows}))
    (tmp_path / "text.json").write_text("no json at all")
    (tmp_path / "bad.json").write_text('[{"a": 1}, {"a": }, {"a": 2}]')
    cuts = [len(text) - 1, len(text) // 2, len(json.dumps(rows[:7])) - 1]
    for i, n in enumerate(cuts):
        (tmp_path / f"cut{i}.json").write_text(text[:n])
    got = read(spark, *sorted(tmp_path.glob("*.json")))
    assert got["whole.json"] == [(x, None) for x in rows]
    assert got["object.json"] == [(None, "not a JSON list")] and got["text.json"] == [(None, "not a JSON list")]
    assert got["bad.json"] == [({"a": 1}, None), ('{"a": }', "invalid record"), ({"a": 2}, None)]
    for i, n in enumerate(cuts):
        ends = [len(json.dumps(rows[: k + 1])) - 1 for k in range(len(rows))]  # where each record ends
        want = [(x, None) for x, e in zip(rows, ends) if e <= n]
        assert got[f"cut{i}.json"] == [*want, (None, "the list is not finished")], i
