"""JSON lists of any size, read by many tasks.

Spark's text reader cuts files to byte ranges at closing braces. Whether a range begins inside a string, and how deep, depends
on all before it, so each is scanned for both cases first; the cases are combined from the ranges' ends (one small row a
range), and then each range gives the records that lie in it. Only records over a border are put together by a shuffle."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTSIDE = re.compile(r'["{}\[\]]')
STRING_END = re.compile(r'(?:[^"\\]|\\.)*+"', re.DOTALL)


def scan(text: str, quoted: bool, depth: int = 0, want: bool = False) -> tuple[bool, int, list[tuple[int, int]]]:
    """State after ``text``: inside a string or not, the depth, and with ``want`` the (begin, end) of records, objects at depth 1. A
    begin of -1 and an end of -1 say that a record goes over that border."""
    at, found, begin = 0, [], -1 if depth > 1 else None
    while at < len(text):
        if quoted:
            m = STRING_END.match(text, at)
            if not m:
                break
            quoted, at = False, m.end()
            continue
        m = OUTSIDE.search(text, at)
        if not m:
            break
        c, at = m[0], m.end()
        if c == '"':
            quoted = True
        elif c in "{[":
            if depth == 1 and c == "{":
                begin = at - 1
            depth += 1
        else:
            depth -= 1
            if depth == 1 and begin is not None and c == "}":
                if want:
                    found.append((begin, at))
                begin = None
    if want and begin is not None and (begin >= 0 or depth > 1):
        found.append((begin, -1))
    return quoted, depth, found


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    m = "_metadata."
    return spark.read.option("lineSep", "}").text(paths).select(
        F.col(f"{m}file_path").alias("path"), F.col(f"{m}file_block_start").alias("block"), F.col(f"{m}file_size").alias("size"), "value"
    )


def _ranges(batches):
    """(path, block, size, text, bytes) of each range: its segments with the braces that parted them."""
    key, held, n = None, [], 0
    for b in batches:
        for path, block, size, value in zip(*(b.column(i).to_pylist() for i in range(4))):
            if (path, block, size) != key:
                if held:
                    yield (*key, "}".join([*held, ""]), n)
                key, held, n = (path, block, size), [], 0
            held.append(value)
            n += len(value.encode()) + 1
    if held:
        yield (*key, "}".join([*held, ""]), n)


def json_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, nth, record, error: the objects of the JSON list in each file, in order (``nth`` ascends, with gaps); a record that is no
    JSON has an error. A file that is no list, or whose list is not finished, has one more row with its error and no record;
    what is whole in it is kept. Empty files: such an error. A record is one row."""

    def ends(batches):
        for path, block, size, text, n in _ranges(batches):
            a, b = (scan(text, q) for q in (False, True))
            cols = [path], [block], [size], [n], [text.lstrip()[:1]], [a[0]], [a[1]], [b[0]], [b[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["path", "block", "size", "n", "first", "q0", "d0", "q1", "d1"])

    pieces = _pieces(spark, paths)
    kinds = "path string, block long, size long, n long, first string, q0 boolean, d0 long, q1 boolean, d1 long"
    rows = pieces.mapInArrow(ends, kinds).orderBy("path", "block").collect()  # one row a range
    begins, errors, last, state = {}, [], None, None
    total: dict[str, int] = {}
    for r in rows:
        if r.path != last:
            state, last, owner = (False, 0), r.path, None
            if r.first != "[":
                errors.append((r.path, "not a JSON list"))
        begins[r.path, r.block] = (*state, owner)
        quoted, depth = state
        quoted, by = (r.q1, r.d1) if quoted else (r.q0, r.d0)
        if depth + by <= 1:
            owner = None
        elif depth <= 1 or owner is None or by < 0:
            owner = r.block
        state = (quoted, depth + by)
        total[r.path] = total.get(r.path, 0) + r.n
        begins[r.path] = (*state, r.size)
    bad = {p for p, _ in errors}
    cut = {p: total[p] > begins[p][2] for p in total}  # the reader's last segment had no brace after it
    for p in total:
        quoted, depth, _ = begins[p]
        if p not in bad and (quoted or depth + cut[p] != 0):
            errors.append((p, "the list is not finished"))
    lists = set(total) - bad
    last_block = {p: max(b for q, b in (k for k in begins if isinstance(k, tuple)) if q == p) for p in total}

    def parts(batches):
        for path, block, _, text, _ in _ranges(batches):
            if path not in lists:
                continue
            if cut[path] and block == last_block[path]:
                text = text[:-1]
            quoted, depth, _ = begins[path, block]
            out = []
            for a, b in scan(text, quoted, depth, True)[2]:
                whole = a >= 0 and b >= 0
                out.append((path, block, max(a, 0), whole, a >= 0, b >= 0, text[max(a, 0) : b if b >= 0 else None]))
            cols = list(zip(*out)) or [[]] * 7
            types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=["path", "block", "at", "whole", "opens", "closes", "text"])

    found = pieces.mapInArrow(parts, "path string, block long, at long, whole boolean, opens boolean, closes boolean, text string")
    nth = F.col("block") + F.col("at")
    whole = found.where("whole").select("path", nth.alias("nth"), F.col("text").alias("record"))
    # a record over borders: its first part opens it, and the parts up to the one that closes it follow, one a range
    over = found.where("not whole").select("path", "block", nth.alias("at"), "opens", "closes", "text").checkpoint()
    starts = sorted((r.path, r.block, r["at"]) for r in over.where("opens").select("path", "block", "at").collect())  # one a range at most
    owned = spark.createDataFrame(_owners(starts, begins), "path string, block long, opens boolean, nth long")
    joined = over.join(F.broadcast(owned), ["path", "block", "opens"]).groupBy("path", "nth").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("x"), F.max("closes").alias("closes"))
    joined = joined.where("closes").select("path", "nth", F.array_join("x.text", "").alias("record"))
    records = whole.unionByName(joined).select("path", "nth", "record", F.when(F.try_parse_json("record").isNull(), "invalid record").alias("error"))
    failed = spark.createDataFrame([(p, None, None, e) for p, e in errors], "path string, nth long, record string, error string")
    return records.unionByName(failed)


def _owners(starts: list[tuple], begins: dict) -> list[tuple]:
    """(path, block, opens, nth): for the open part of each range, and for each range that goes on with a record, the record's place."""
    out, blocks = [], {}
    for path, block in (k for k in begins if isinstance(k, tuple)):
        blocks.setdefault(path, []).append(block)
    for path, block, at in starts:
        out.append((path, block, True, at))
        later = sorted(b for b in blocks[path] if b > block)
        for b in later:
            if begins[path, b][1] <= 1:
                break
            out.append((path, b, False, at))
            if any(p == path and s == b for p, s, _ in starts):
                break
    return out
