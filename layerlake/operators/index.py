"""A keyword index that grows, and searches of many queries at once.

An index is a folder of immutable segments. A segment's rows are (token, block): the postings of one token in a block of
some ``BLOCK`` rows of nearly equal length, with the largest frequency and smallest length as a bound of their scores. A
row without a token lists a block's labels. ``manifests/n`` names the segments and the tables of deleted rows of version n;
it is written last, so a version is there whole or not at all, and readers of an older one keep it."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import search_tokens
from .search import parse_query

BLOCK = 128
BUCKETS = 64
#: Documents that a task sorts by length before they are cut into blocks, and tokens after which it does so anyway.
CHUNK_ROWS, CHUNK_TOKENS = 16_384, 1_000_000
#: Terms of the queries that are sent to the tasks together.
ROUND_TERMS = 200_000
#: The rows of so many tokens are named to the reader, which skips others; more tokens are joined.
FEW_TOKENS = 1000
#: Bounds of so many (token, block) rows are looked at in the driver; more of them in tasks.
FEW_ROWS = 50_000
#: Places of different columns are so far apart that no phrase crosses them.
FAR = 1 << 32


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


@contextmanager
def _batch_rows(spark, n: int):
    """Arrow batches of ``n`` rows inside (texts may be very long)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, had)


def _give_back() -> None:
    """Gives what is free in a worker back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


# -- building -----------------------------------------------------------------------------------------------------------


def _rows(labels: pa.Array, digests: pa.Array, columns: list[pa.ListArray], base: int, names: list[str]) -> tuple[pa.Table, int]:
    """The segment rows of some documents, and the number of their blocks. Documents are put in order of length first."""
    n = len(labels)
    sizes = [np.diff(c.offsets.to_numpy()) for c in columns]
    length = np.sum(sizes, axis=0)
    order = np.argsort(length, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    flat = pa.concat_arrays([c.flatten().cast(pa.string()) for c in columns]).dictionary_encode()
    token = flat.indices.to_numpy().astype(np.int64)
    doc = np.concatenate([np.repeat(rank, s) for s in sizes])
    at = np.concatenate([k * FAR + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) for k, s in enumerate(sizes)]).astype(np.int64)
    words = len(flat.dictionary)
    by = np.argsort((doc // BLOCK * words + token) * n + doc, kind="stable")  # block, token, document, place
    token, doc, at = token[by], doc[by], at[by]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    post = np.flatnonzero(new)  # where a posting begins
    token, doc, tf = token[post], doc[post], np.diff(np.append(post, len(at)))
    new = np.ones(len(post), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] // BLOCK != doc[:-1] // BLOCK)
    row = np.flatnonzero(new)  # where a (block, token) begins
    ends = np.append(row, len(post)).astype(np.int32)
    label, dl = labels.take(pa.array(order)), length[order].astype(np.int64)
    places = pa.ListArray.from_arrays(pa.array(np.append(post[row], len(at)).astype(np.int32)), pa.array(at, pa.int64()))
    crc = np.fromiter((bucket(w) for w in flat.dictionary.to_pylist()), np.int32, words)

    def lists(x, ends=ends):
        return pa.ListArray.from_arrays(pa.array(ends), x)

    some = len(row) > 0
    columns_of = [
        pa.array(crc[token[row]], pa.int32()), flat.dictionary.take(pa.array(token[row])), pa.array(base + doc[row] // BLOCK, pa.int64()), pa.array(np.diff(ends), pa.int32()),
        pa.array(np.maximum.reduceat(tf, row) if some else [], pa.int64()), pa.array(np.minimum.reduceat(dl[doc], row) if some else [], pa.int64()),
        lists(label.take(pa.array(doc))), lists(pa.array(tf.astype(np.int32))), lists(pa.array(dl[doc].astype(np.int32))), places, pa.nulls(len(row), pa.list_(pa.string())),
    ]
    blocks = -(-n // BLOCK)
    edges = np.minimum(np.arange(blocks + 1) * BLOCK, n).astype(np.int32)
    zeros = pa.array(np.zeros(blocks), pa.int64())
    of_blocks = [
        pa.array(np.full(blocks, -1), pa.int32()), pa.nulls(blocks, pa.string()), pa.array(base + np.arange(blocks), pa.int64()), pa.array(np.diff(edges), pa.int32()),
        zeros, zeros, lists(label, edges), pa.nulls(blocks, pa.list_(pa.int32())), lists(pa.array(dl.astype(np.int32)), edges), pa.nulls(blocks, pa.list_(pa.int64())), lists(digests.take(pa.array(order)), edges),
    ]
    tables = [pa.Table.from_arrays(c, names=names) for c in (columns_of, of_blocks)]
    return pa.concat_tables([t.cast(tables[0].schema) for t in tables]), blocks


def _schema(kind: T.DataType) -> T.StructType:
    """``at`` has the places of one document after the other's, as many as its frequency each."""
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    return T.StructType([
        T.StructField("bucket", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("block", T.LongType()), T.StructField("n", T.IntegerType()),
        T.StructField("max_tf", T.LongType()), T.StructField("min_dl", T.LongType()), T.StructField("labels", T.ArrayType(kind)), T.StructField("tfs", ints),
        T.StructField("dls", ints), T.StructField("at", longs), T.StructField("digests", T.ArrayType(T.StringType())),
    ])


def _write_segment(docs: DataFrame, columns: list[str], path: str, number: int) -> str:
    """Writes ``docs(label, digest, columns)`` as a segment in one pass without a shuffle: texts are tokenized and counted where they lie,
    and each task writes the rows of its blocks, a file a bucket in order of tokens, so a frequent token has one row for ``BLOCK`` documents.
    ``docs`` is read from files or a checkpoint: a task that runs again must see the same rows."""
    spark = docs.sparkSession
    kind = docs.schema["label"].dataType
    schema = _schema(kind)
    name = f"{number:08d}-{uuid.uuid4().hex[:8]}"
    tokens = [F.coalesce(search_tokens(F.col(c)), F.array().cast("array<string>")).alias(f"c{i}") for i, c in enumerate(columns)]

    def run(batches):
        from pyspark import TaskContext

        base, held, rows, size = (number << 44) + (TaskContext.get().partitionId() << 24), [], 0, 0

        def out():
            t = pa.Table.from_batches(held).combine_chunks()
            col = lambda c: t.column(c).combine_chunks()
            return _rows(col("label"), col("digest"), [col(f"c{i}") for i in range(len(columns))], base, schema.names)

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
                size += sum(len(b.column(f"c{i}").flatten()) for i in range(len(columns)))
            if rows >= CHUNK_ROWS or size >= CHUNK_TOKENS:
                found, blocks = out()
                yield from found.to_batches(max_chunksize=2000)
                base, held, rows, size, found = base + blocks, [], 0, 0, None
                _give_back()
        if held:
            yield from out()[0].to_batches(max_chunksize=2000)
            held = []
        _give_back()

    with _batch_rows(spark, 200):
        found = docs.select("label", "digest", *tokens).mapInArrow(run, schema)
        _stored(found, f"{path}/segments/{name}")
    return name


def _stored(rows: DataFrame, path: str) -> None:
    """Writes segment rows, those of each bucket in order of tokens."""
    rows.sortWithinPartitions("bucket", "token", "block").write.partitionBy("bucket").option("compression", "zstd").parquet(path)


# -- versions -----------------------------------------------------------------------------------------------------------


def _folder(spark, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def version(spark, path: str) -> int:
    """The newest whole version of the index, 0 where there is none."""
    fs, p = _folder(spark, f"{path}/manifests")
    if not fs.exists(p):
        return 0
    done = [s.getPath().getName() for s in fs.listStatus(p) if fs.exists(_folder(spark, f"{s.getPath()}/_SUCCESS")[1])]
    return max(map(int, done), default=0)


def manifest(spark, path: str, at: int | None = None) -> list:
    """Rows (kind, name, n, dl) of a version: its segments with their numbers of rows and tokens, its tables of deleted rows, and
    the type of its labels."""
    at = version(spark, path) if at is None else at
    return spark.read.parquet(f"{path}/manifests/{at:08d}").collect() if at else []  # one row a segment


def _commit(spark, path: str, number: int, rows: list[tuple]) -> None:
    """Switches the index to ``rows``; an error if another writer has made this version."""
    spark.createDataFrame(rows, "kind string, name string, n long, dl long").coalesce(1).write.parquet(f"{path}/manifests/{number:08d}")


def _segments(spark, path: str, rows: list) -> DataFrame:
    schema = _schema(next(T.StructType.fromDDL(f"label {r.name}")["label"].dataType for r in rows if r.kind == "label"))
    names = [f"{path}/segments/{r.name}" for r in rows if r.kind == "segment"]
    return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(n) for n in names])


def _gone(spark, path: str, rows: list) -> DataFrame | None:
    names = [f"{path}/gone/{r.name}" for r in rows if r.kind == "gone"]
    return spark.read.parquet(*names).select("block", F.col("label").alias("_gone")) if names else None


def _live(spark, path: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of the newest version, without what is deleted; rows of blocks have no token. Without deleted rows nothing
    is joined; with them, the few blocks that lost some are cut. ``columns`` names those that are read (with block, n and labels)."""
    named = manifest(spark, path)
    rows, gone = _segments(spark, path, named), _gone(spark, path, named)
    if columns:
        rows = rows.select(*[c for c in rows.columns if c in ("token", "block", "n", "labels", *columns)])
    return rows if gone is None else _cut(rows, gone)


def rows_of(spark, path: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of the newest version (``_live``), with the places of each document apart."""
    rows = _live(spark, path, columns)
    return rows.withColumn("at", nested(F.col("at"), F.col("tfs"))) if "at" in rows.columns else rows


def nested(at, tfs):
    """The places of a row by document."""
    before = lambda i: F.aggregate(F.slice(tfs, F.lit(1), i), F.lit(0), lambda a, x: a + x)
    return F.transform(tfs, lambda x, i: F.slice(at, before(i) + 1, x))


def _cut(rows: DataFrame, gone: DataFrame) -> DataFrame:
    lost = gone.groupBy("block").agg(F.collect_set("_gone").alias("_lost"))  # up to BLOCK labels
    out = rows.join(lost, "block", "left")
    kinds = {"labels": rows.schema["labels"].dataType.elementType, "tfs": "int", "dls": "int", "at": "array<long>", "digests": "string"}
    kinds = {c: k for c, k in kinds.items() if c in rows.columns}

    def whole(c):  # of the length of the labels, also where a row has none
        value = nested(F.col("at"), F.col("tfs")) if c == "at" else F.col(c)
        return F.coalesce(value, F.transform("labels", lambda _: F.lit(None).cast(kinds[c])))

    zipped = F.arrays_zip(*[whole(c).alias(c) for c in kinds])
    left = F.filter(zipped, lambda x: ~F.array_contains("_lost", x["labels"]))
    out = out.withColumn("_x", F.when(F.col("_lost").isNotNull(), left))
    cut = F.col("_x").isNotNull()

    def kept(c):
        value = F.flatten(F.col("_x")[c]) if c == "at" else F.col("_x")[c]
        return F.when(cut & F.col("token").isNotNull(), value) if c in ("at", "tfs") else F.when(cut, value)

    own = {c: kept(c).otherwise(F.col(c)).alias(c) for c in kinds}
    more = {
        "n": F.when(cut, F.size("_x")).otherwise(F.col("n")).alias("n"),
        "max_tf": F.when(cut & F.col("token").isNotNull(), F.array_max(F.col("_x")["tfs"]).cast("long")).otherwise(F.col("max_tf")).alias("max_tf") if "tfs" in kinds else None,
        "min_dl": F.when(cut & F.col("token").isNotNull(), F.array_min(F.col("_x")["dls"]).cast("long")).otherwise(F.col("min_dl")).alias("min_dl") if "dls" in kinds else None,
    }
    return out.select(*[(own | more).get(c, F.col(c)) for c in rows.columns]).where("n > 0")


def _digest(columns: list[str]):
    parts = [F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def build(docs: DataFrame, label: str, columns: list[str], path: str) -> None:
    """The index of ``docs`` at ``path``, as a new version of one segment. Labels are unique; null texts have no tokens."""
    spark = docs.sparkSession
    number = version(spark, path) + 1
    rows = docs.select(F.col(label).alias("label"), _digest(columns).alias("digest"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(columns)])
    name = _write_segment(rows, [f"_t{i}" for i in range(len(columns))], path, number)
    kind = ("label", docs.schema[label].dataType.simpleString(), 0, 0)
    _commit(spark, path, number, [kind, ("segment", name, *_size(spark, path, name))])


def _size(spark, path: str, name: str) -> tuple[int, int]:
    return _sums(spark.read.schema("bucket int, n int, dls array<int>").parquet(f"{path}/segments/{name}"))


def _sums(rows: DataFrame) -> tuple[int, int]:
    """Number of rows and of tokens."""
    r = rows.where("bucket = -1").agg(F.sum("n").alias("n"), F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)).alias("dl")).first()
    return int(r.n or 0), int(r.dl or 0)


def update(docs: DataFrame, label: str, columns: list[str], path: str, most: int = 8) -> None:
    """Makes the index that of ``docs``: rows that are new or whose text changed become a segment, rows that went or changed are
    listed as deleted, and beyond ``most`` segments the smaller half is merged. The version is switched last: whatever
    ends this before, the index stays as it was, and only files that no version names are left."""
    spark = docs.sparkSession
    named = manifest(spark, path)
    if not named:
        return build(docs, label, columns, path)
    number = version(spark, path) + 1
    live = _live(spark, path, ["bucket", "digests"]).where("bucket = -1").select("block", F.explode(F.arrays_zip("labels", "digests")).alias("x"))
    live = live.select("block", F.col("x.labels").alias("label"), F.col("x.digests").alias("_had"))
    now = docs.select(F.col(label).alias("label"), _digest(columns).alias("digest"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(columns)])
    texts = [f"_t{i}" for i in range(len(columns))]
    fresh = now.join(live.select("label", "_had"), "label", "left").where("_had is null or _had <> digest").drop("_had").checkpoint()
    lost = live.join(now.select("label", "digest"), "label", "left").where("digest is null or digest <> _had").select("block", "label").checkpoint()
    out = [(r.kind, r.name, r.n, r.dl) for r in named]
    if n := lost.count():
        name = uuid.uuid4().hex
        lost.write.parquet(f"{path}/gone/{name}")
        out.append(("gone", name, n, 0))
    if fresh.limit(1).count():
        name = _write_segment(fresh, texts, path, number)
        out.append(("segment", name, *_size(spark, path, name)))
    if len(out) == len(named):
        return None
    _commit(spark, path, number, out)
    if sum(k == "segment" for k, *_ in out) > most:
        merge(spark, path, most)
    return None


def merge(spark, path: str, most: int = 8) -> None:
    """Merges the smaller half of the segments into one without their deleted rows; nothing is tokenized again."""
    named = manifest(spark, path)
    number = version(spark, path) + 1
    parts = sorted((r for r in named if r.kind == "segment"), key=lambda r: (r.n, r.name))
    small = parts[: max(2, len(parts) - most // 2)]
    gone = _gone(spark, path, named)
    rows = _segments(spark, path, [r for r in named if r.kind == "label"] + small)
    rows = rows if gone is None else _cut(rows, gone)
    name = f"{number:08d}-{uuid.uuid4().hex[:8]}"
    # buckets that are large are dealt to several tasks, so that what a task sorts does not grow with the table
    _stored(rows.hint("rebalance", F.col("bucket")), f"{path}/segments/{name}")
    rest = [(r.kind, r.name, r.n, r.dl) for r in named if r not in small]
    whole = not any(k == "segment" for k, *_ in rest)  # then no deleted row is left anywhere
    kept = [r for r in rest if r[0] != "gone" or not whole]
    _commit(spark, path, number, [*kept, ("segment", name, *_size(spark, path, name))])


def vacuum(spark, path: str) -> list[str]:
    """Removes segments, tables and versions that the newest version does not name: files of writers that failed, merged ones."""
    at = version(spark, path)
    keep = {r.name for r in manifest(spark, path, at)} | {f"{at:08d}"}
    gone = []
    for part in ("segments", "gone", "manifests"):
        fs, p = _folder(spark, f"{path}/{part}")
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if s.getPath().getName() not in keep:
                fs.delete(s.getPath(), True)
                gone.append(s.getPath().getName())
    return gone


# -- searching ----------------------------------------------------------------------------------------------------------


def statistics(spark, path: str) -> tuple[int, float]:
    """Number of live rows and their mean length: from the version's list, or from the rows where some were deleted."""
    named = manifest(spark, path)
    if any(r.kind == "gone" for r in named):
        n, dl = _sums(_live(spark, path, ["bucket", "dls"]))
    else:
        n, dl = (sum(r[c] for r in named if r.kind == "segment") for c in ("n", "dl"))
    return n, dl / n if n else 1.0


def of_tokens(rows: DataFrame, tokens: list[str]) -> DataFrame:
    """The rows of some tokens: only their folders and row groups are read."""
    return rows.where(F.col("bucket").isin(sorted({bucket(t) for t in tokens})) & F.col("token").isin(*tokens))


def parsed(queries: DataFrame, query_id: str, text: str, any_word: bool = False) -> DataFrame:
    """query_id, every, terms (arrays of tokens that must follow each other; most are of one) of each query."""
    kind = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("every", T.BooleanType()), T.StructField("terms", T.ArrayType(T.ArrayType(T.StringType())))])

    def run(batches):
        for b in batches:
            got = [parse_query(x or "", any_word) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("query_id"), pa.array([e for _, e in got], pa.bool_()), pa.array([p for p, _ in got], pa.list_(pa.list_(pa.string())))], names=["query_id", "every", "terms"])

    return queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("text")).mapInArrow(run, kind)


class Scorer:
    """Scores the queries of a round in one block after the other, and keeps the ``k`` best of each.

    A (query, block) is looked into only if its bound, from the largest frequency and smallest length of each term in the block,
    reaches the query's threshold: the k-th best score so far, at least ``least`` of it."""

    def __init__(self, queries: list[tuple[bool, list[tuple[str, ...]]]], idf: dict, avgdl: float, k: int, least: np.ndarray | None = None):
        self.terms = sorted({t for _, terms in queries for t in terms})
        number = {t: i for i, t in enumerate(self.terms)}
        self.single = {t[0]: i for i, t in enumerate(self.terms) if len(t) == 1}
        self.multi = [i for i, t in enumerate(self.terms) if len(t) > 1]
        self.of = [np.array([number[t] for t in terms], np.int64) for _, terms in queries]
        self.idf = np.array([idf.get(t, 0.0) for t in self.terms])
        self.query = np.repeat(np.arange(len(queries)), [len(x) for x in self.of])
        self.term = np.concatenate(self.of) if self.of else np.zeros(0, np.int64)
        self.every = np.array([e for e, _ in queries], bool)
        self.count = np.array([len(x) for x in self.of])
        self.avgdl, self.k = avgdl, k
        self.least = np.full(len(queries), -np.inf) if least is None else least.copy()
        self.best: list[list] = [[] for _ in queries]

    def impact(self, tf, dl):
        return tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / self.avgdl))

    def bounds(self, block: dict) -> np.ndarray:
        """The highest score that each query can have in a block ``{token: row}``, -inf where it has none."""
        there = np.zeros(len(self.terms), bool)
        most = np.zeros(len(self.terms))
        met = [(i, (r,)) for x, r in block.items() if (i := self.single.get(x)) is not None]
        met += [(i, [block[x] for x in self.terms[i]]) for i in self.multi if all(x in block for x in self.terms[i])]
        for i, rows in met:
            there[i] = True
            most[i] = self.idf[i] * self.impact(min(r["max_tf"] for r in rows), max(r["min_dl"] for r in rows))
        met = np.bincount(self.query, there[self.term], minlength=len(self.of))
        high = np.bincount(self.query, most[self.term], minlength=len(self.of))
        return np.where((met > 0) & (~self.every | (met == self.count)), high, -np.inf)

    def _postings(self, block: dict, t: tuple, number: dict) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block (by number) and how often the term occurs in each."""
        if len(t) == 1:
            r = block[t[0]]
            return np.array([number[x] for x in r["labels"]], np.int64), np.array(r["tfs"], np.int64)
        places = [dict(zip(block[x]["labels"], np.split(np.array(block[x]["at"], np.int64), np.cumsum(block[x]["tfs"])[:-1]))) for x in t]
        got = []
        for label, first in places[0].items():
            if all(label in p for p in places[1:]):
                more = [set(p[label].tolist()) for p in places[1:]]
                times = sum(all(x + j + 1 in m for j, m in enumerate(more)) for x in first.tolist())
                if times:
                    got.append((number[label], times))
        return tuple(np.array(x, np.int64) for x in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def phrases(self, block: dict) -> list[tuple[int, int]]:
        """(term, documents) of the terms of several tokens in a block."""
        out = []
        for i in self.multi:
            t = self.terms[i]
            if all(x in block for x in t):
                number = {label: j for j, label in enumerate(block[t[0]]["labels"])}
                if n := len(self._postings(block, t, number)[0]):
                    out.append((i, n))
        return out

    def push(self, block: dict) -> int:
        """Scores a block; the number of queries that looked into it."""
        high = self.bounds(block)
        open_ = np.flatnonzero(high + 1e-6 >= self.least)
        open_ = open_[high[open_] > -np.inf]
        if not len(open_):
            return 0
        labels, number, lengths = [], {}, []
        for r in block.values():
            for label, dl in zip(r["labels"], r["dls"]):
                if label not in number:
                    number[label] = len(labels)
                    labels.append(label)
                    lengths.append(dl)
        lengths = np.array(lengths, float)
        known: dict[int, tuple] = {}
        for q in open_.tolist():
            score, met = np.zeros(len(labels)), np.zeros(len(labels), np.int64)
            for i in self.of[q].tolist():
                t = self.terms[i]
                if i not in known:
                    docs, tf = self._postings(block, t, number) if all(x in block for x in t) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    known[i] = docs, self.idf[i] * self.impact(tf, lengths[docs]) if len(docs) else np.zeros(0)
                docs, s = known[i]
                score[docs] += s
                met[docs] += 1
            hit = np.flatnonzero(met == self.count[q] if self.every[q] else met > 0)
            if len(hit):
                value = np.round(score[hit], 6)
                good = value >= self.least[q] - 1e-6
                mine = self.best[q] + [(-v, labels[j]) for v, j in zip(value[good].tolist(), hit[good].tolist())]
                mine.sort()
                self.best[q] = mine[: self.k]
                if len(self.best[q]) == self.k:
                    self.least[q] = max(self.least[q], -self.best[q][-1][0])
        return len(open_)


def _blocks(batches, columns: list[str]):
    """(block, {token: row}) of rows that come in order of blocks."""
    now, held = None, {}
    for b in batches:
        for r in b.select(columns).to_pylist():
            if r["block"] != now:
                if held:
                    yield now, held
                now, held = r["block"], {}
            held[r["token"]] = r
    if held:
        yield now, held


META = ["block", "token", "n", "max_tf", "min_dl"]
PACKED = [*META, "labels", "tfs", "dls", "at"]


def _pack(batches):
    """(block, data): the rows of each block that a task has, in one compressed piece. They come in order of blocks."""
    now, held = None, []

    def piece() -> bytes:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(pa.Table.from_batches(held).combine_chunks())
        return out.getvalue().to_pybytes()

    def rows(done) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in done], pa.int64()), pa.array([x for _, x in done], pa.binary())], names=["block", "data"])

    for b in batches:
        blocks, done = b.column("block").to_numpy(), []
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if j > i:
                if held and blocks[i] != now:
                    done.append((now, piece()))
                    held = []
                now = int(blocks[i])
                held.append(b.slice(i, j - i))
        if done:
            yield rows(done)
    if held:
        yield rows([(now, piece())])


def _opened(batches, tokens: list[str], columns: list[str]):
    """(block, {token: row}) of ``packed`` blocks, of some tokens and columns."""
    wanted = pa.array(tokens, pa.string())
    for b in batches:
        for block, pieces in zip(b.column("block").to_pylist(), b.column("data").to_pylist()):
            held = {}
            for x in pieces:
                t = pa.ipc.open_stream(x).read_all().select(columns)
                held |= {r["token"]: r for r in t.filter(pc.is_in(t.column("token"), value_set=wanted)).to_pylist()}
            if held:
                yield block, held


class Packed:
    """The rows of many tokens block by block (written once): a row is a whole block, so the rounds of a search read them without a
    shuffle. ``tokens(token, placed)``: places are kept where ``placed`` says so."""

    def __init__(self, rows: DataFrame, tokens: DataFrame):
        chosen = rows.where("token is not null").join(F.broadcast(tokens), "token").withColumn("at", F.when(F.col("placed"), F.col("at"))).select(*PACKED)
        with _batch_rows(rows.sparkSession, 1000):
            pieces = chosen.sortWithinPartitions("block").mapInArrow(_pack, "block long, data binary")
            self.blocks = pieces.groupBy("block").agg(F.collect_list("data").alias("data")).checkpoint()
        self.counts = rows.join(F.broadcast(tokens), "token").groupBy("token").agg(F.sum("n").alias("c")).checkpoint()


class Search:
    """A round of queries over an index: what the tasks of its steps share."""

    def __init__(self, rows: DataFrame, queries: list[tuple[bool, list[tuple[str, ...]]]], n: int, avgdl: float, k: int, packed: Packed | None = None):
        self.spark, self.queries, self.n, self.avgdl, self.k = rows.sparkSession, queries, n, avgdl, k
        self.tokens = tokens = sorted({x for _, terms in queries for t in terms for x in t})
        self.packed, self.label = packed, rows.schema["labels"].dataType.elementType
        self.meta: dict | None = None
        if packed:
            self.rows, meta = packed.blocks, None
        else:
            self.rows = of_tokens(rows, tokens) if tokens else rows.where(F.lit(False))
            meta = self.rows.select(*META).limit(FEW_ROWS + 1).collect()
        if meta is not None and len(meta) <= FEW_ROWS:
            self.meta = {}
            for r in meta:
                self.meta.setdefault(r.block, {})[r.token] = r.asDict()
        self.places = any(len(t) > 1 for _, terms in queries for t in terms)
        self.idf = self._idf()

    def _by_block(self, rows: DataFrame, columns: list[str], run, schema: str | T.StructType, tokens: list[str] | None = None) -> DataFrame:
        """``run`` over whole blocks, each with at most one row a token of the queries (or of ``tokens``). Rows that are not packed are dealt
        by a hash of the block: a shuffle by the block itself is left out above a join by it, whose shuffle Spark may then read piecemeal,
        as nothing it knows of ``run`` forbids that."""
        tokens = self.tokens if tokens is None else tokens
        if self.packed:
            with _batch_rows(self.spark, 16):
                return rows.mapInArrow(lambda batches: run(_opened(batches, tokens, columns)), schema).checkpoint()
        rows = rows.where(F.col("token").isin(*tokens)).select(*columns).repartition(F.xxhash64("block")).sortWithinPartitions("block")
        with _batch_rows(self.spark, 1000):
            return rows.mapInArrow(lambda batches: run(_blocks(batches, columns)), schema).checkpoint()

    def _idf(self) -> dict:
        if self.meta is not None:
            found: dict = {}
            for block in self.meta.values():
                for t, r in block.items():
                    found[t,] = found.get((t,), 0) + r["n"]
        else:
            if self.packed:
                asked = self.spark.createDataFrame([(x,) for x in self.tokens], "token string")
                counts = self.packed.counts.join(F.broadcast(asked), "token")
            else:
                counts = self.rows.groupBy("token").agg(F.sum("n").alias("c"))
            found = {(r.token,): r.c for r in counts.collect()}  # one row a token
        phrases = [(True, [t]) for t in sorted({t for _, terms in self.queries for t in terms if len(t) > 1})]
        if phrases:
            scorer = Scorer(phrases, {}, 1.0, 1)

            def run(blocks):
                counts: dict[int, int] = {}
                for _, block in blocks:
                    for i, c in scorer.phrases(block):
                        counts[i] = counts.get(i, 0) + c
                yield pa.RecordBatch.from_pydict({"i": list(counts), "c": list(counts.values())}, schema=pa.schema([("i", pa.int64()), ("c", pa.int64())]))

            inside = sorted({x for _, (t,) in phrases for x in t})
            got = self._by_block(self.rows if self.packed else of_tokens(self.rows, inside), ["block", "token", "labels", "tfs", "at"], run, "i long, c long", inside)
            found |= {scorer.terms[r.i]: r.c for r in got.groupBy("i").agg(F.sum("c").alias("c")).collect()}
        return {t: max(np.log((self.n - c + 0.5) / (c + 0.5)), 1e-6) for t, c in found.items()}

    def scorer(self, least: np.ndarray | None = None) -> Scorer:
        return Scorer(self.queries, self.idf, self.avgdl, self.k, least)

    def _scored(self, rows: DataFrame, least: np.ndarray | None) -> DataFrame:
        """q, label, score: each task's ``k`` best of each query."""
        columns = ["block", "token", "max_tf", "min_dl", "labels", "tfs", "dls", *(["at"] if self.places else [])]
        label = self.label
        schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("label", label), T.StructField("score", T.DoubleType())])

        def run(blocks):
            scorer = self_.scorer(least)
            for _, block in blocks:
                scorer.push(block)
            hits = [(q, label, -s) for q, best in enumerate(scorer.best) for s, label in best]
            cols = list(zip(*hits)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], kind) if cols[1] else pa.array([], kind), pa.array(cols[2], pa.float64())], names=["q", "label", "score"])

        from pyspark.sql.pandas.types import to_arrow_type

        kind, self_ = to_arrow_type(label), self._light()
        return self._by_block(rows, columns, run, schema)

    def _light(self) -> Search:
        """This search without its tables, for the tasks."""
        light = object.__new__(Search)
        light.queries, light.n, light.avgdl, light.k, light.idf = self.queries, self.n, self.avgdl, self.k, self.idf
        return light

    def _named(self, blocks: list[int]) -> DataFrame:
        return self.spark.createDataFrame([(b,) for b in blocks], "block long")

    def first_blocks(self) -> DataFrame:
        """block: for each query, of each task's blocks the one with the highest bound."""
        light = self._light()

        def best(blocks) -> list[int]:
            scorer = light.scorer()
            top, at = np.full(len(light.queries), -np.inf), np.zeros(len(light.queries), np.int64)
            for block, rows in blocks:
                high = scorer.bounds(rows)
                better = high > top
                top[better], at[better] = high[better], block
            return np.unique(at[top > -np.inf]).tolist()

        def run(blocks):
            yield pa.RecordBatch.from_arrays([pa.array(best(blocks), pa.int64())], names=["block"])

        if self.meta is not None:
            return self._named(best(self.meta.items()))
        return self._by_block(self.rows, META, run, "block long").distinct()

    def needed_blocks(self, least: np.ndarray) -> DataFrame:
        """block: those where some query's bound reaches its threshold."""
        light = self._light()

        def needed(blocks) -> list[int]:
            scorer = light.scorer()
            return [block for block, rows in blocks if ((high := scorer.bounds(rows)) + 1e-6 >= least)[high > -np.inf].any()]

        def run(blocks):
            yield pa.RecordBatch.from_arrays([pa.array(needed(blocks), pa.int64())], names=["block"])

        if self.meta is not None:
            return self._named(needed(self.meta.items()))
        return self._by_block(self.rows, META, run, "block long")

    def thresholds(self) -> np.ndarray:
        """A score that each query's k-th hit has at least: that in the blocks that promise most."""
        found = self._scored(self.rows.join(F.broadcast(self.first_blocks()), "block", "left_semi"), None)
        nth = found.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "label"))).where(F.col("nth") == self.k)
        least = np.full(len(self.queries), -np.inf)
        for r in nth.collect():  # one row a query of the round
            least[r.q] = r.score
        return least

    def hits(self) -> DataFrame:
        """q, label, score, rank: the ``k`` best of each query; ties go by label."""
        least = self.thresholds()
        found = self._scored(self.rows.join(F.broadcast(self.needed_blocks(least)), "block", "left_semi"), least)
        best = Window.partitionBy("q").orderBy(F.desc("score"), "label")
        return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= self.k)


def search_many(spark, path: str, queries: DataFrame, query_id: str, text: str, k: int = 10, any_word: bool = False) -> DataFrame:
    """query_id, label, score, rank: the ``k`` best rows of the index for each of ``queries``, in one pass over the rows of their
    tokens (for a round of ``ROUND_TERMS`` terms; more queries are more rounds). Tasks get whole blocks, look into those whose
    bound reaches a threshold, and give up to ``k`` rows of each query to the shuffle. The rows of many tokens are put together by blocks
    once for all rounds (``Packed``). Equal to scoring all
    rows. Query ids are unique; null texts and texts without words find nothing. ``any_word``: as in ``parse_query``."""
    rows = _live(spark, path)
    n, avgdl = statistics(spark, path)
    asked = parsed(queries, query_id, text, any_word).where(F.size("terms") > 0).select("*", F.size("terms").alias("m")).checkpoint()
    words = asked.select(F.explode("terms").alias("t")).select(F.explode("t").alias("token"), (F.size("t") > 1).alias("placed")).groupBy("token").agg(F.max("placed").alias("placed")).checkpoint()
    packed = Packed(rows, words) if words.limit(FEW_TOKENS + 1).count() > FEW_TOKENS else None
    rounds, room, ids = [], 0, asked.schema["query_id"]
    out = None
    for r in asked.toLocalIterator():
        if not rounds or r.m > room:
            rounds, room, out = [], ROUND_TERMS, _round(rows, rounds, n, avgdl, k, ids, out, packed)
        rounds.append(r)
        room -= r.m
    out = _round(rows, rounds, n, avgdl, k, ids, out, packed)
    if out is None:
        kind = T.StructType([ids, T.StructField("label", rows.schema["labels"].dataType.elementType), T.StructField("score", T.DoubleType()), T.StructField("rank", T.LongType())])
        return spark.createDataFrame([], kind)
    return out


def _round(rows: DataFrame, asked: list, n: int, avgdl: float, k: int, ids: T.StructField, before: DataFrame | None, packed: Packed | None = None) -> DataFrame | None:
    if not asked:
        return before
    spark = rows.sparkSession
    found = Search(rows, [(r.every, [tuple(t) for t in r.terms]) for r in asked], n, avgdl, k, packed).hits()
    names = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(asked)], T.StructType([T.StructField("q", T.IntegerType()), ids]))
    out = found.join(F.broadcast(names), "q").select("query_id", "label", "score", "rank")
    return out if before is None else before.unionByName(out)


def match_many(spark, path: str, queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """query_id, label of every row that matches each of ``queries``, without scores: the queries' tokens are joined with the
    postings once, of which only those of these tokens are moved, and places are read for phrases only."""
    rows = _live(spark, path, ["bucket", "tfs", "at"]).where("token is not null")
    asked = parsed(queries, query_id, text).select("query_id", "every", F.size("terms").alias("m"), F.posexplode("terms").alias("i", "term")).checkpoint()
    key = ["query_id", "every", "m", "i"]
    tokens = asked.select(F.explode("term").alias("token")).distinct()
    some = tokens.limit(FEW_TOKENS + 1).collect()
    rows = of_tokens(rows, [r.token for r in some]) if len(some) <= FEW_TOKENS else rows.join(F.broadcast(tokens), "token", "left_semi")
    asked = F.broadcast(asked) if asked.limit(FEW_ROWS + 1).count() <= FEW_ROWS else asked
    one = asked.where(F.size("term") == 1).withColumn("token", F.col("term")[0])
    found = one.join(rows.select("token", "labels"), "token").select(*key, F.explode("labels").alias("label"))
    several = asked.where(F.size("term") > 1).select(*key, F.size("term").alias("size"), F.posexplode("term").alias("pos", "token"))
    if several.limit(1).count():
        placed = several.join(rows.select("token", "labels", "tfs", "at"), "token").select(*key, "size", "pos", F.explode(F.arrays_zip("labels", nested(F.col("at"), F.col("tfs")).alias("at"))).alias("x"))
        placed = placed.groupBy(*key, "size", F.col("x.labels").alias("label")).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("x.at").alias("at")))).alias("ps"))  # a term's tokens
        follow = F.exists(F.col("ps")[0]["at"], lambda x: F.forall("ps", lambda p: F.array_contains(p["at"], x + p["pos"])))
        found = found.unionByName(placed.where((F.size("ps") == F.col("size")) & follow).select(*key, "label"))
    met = found.groupBy("query_id", "every", "m", "label").agg(F.countDistinct("i").alias("c"))
    return met.where("not every or c = m").select("query_id", "label")


def search_all(spark, path: str, query: str) -> DataFrame:
    """label, keyword_score of every row of the index that matches one query (for searches that filter or fuse whole lists)."""
    rows = _live(spark, path)
    phrases, every = parse_query(query)
    label = rows.schema["labels"].dataType.elementType
    if not phrases:
        return rows.select(F.lit(None).cast(label).alias("label"), F.lit(0.0).alias("keyword_score")).limit(0)
    n, avgdl = statistics(spark, path)
    tokens = list(dict.fromkeys(t for p in phrases for t in p))
    long_ones = {t for p in phrases if len(p) > 1 for t in p}
    parts = ["labels", "tfs", "dls", *([nested(F.col("at"), F.col("tfs")).alias("at")] if long_ones else [])]  # places are read for phrases only
    each = of_tokens(rows, tokens).select("token", F.explode(F.arrays_zip(*parts)).alias("x")).select("token", F.col("x.labels").alias("label"), F.col("x.tfs").alias("tf"), F.col("x.dls").alias("dl"), *(["x.at"] if long_ones else []))

    def first(value, t):
        return F.first(F.when(F.col("token") == t, F.col(value)), ignorenulls=True)

    aggs = [first("at" if t in long_ones else "tf", t).alias(f"a{i}") for i, t in enumerate(tokens)]
    at = each.groupBy("label").agg(F.first("dl").alias("dl"), *aggs)

    def times(p):
        cols = [F.col(f"a{tokens.index(t)}") for t in p]
        if len(p) == 1:
            return F.coalesce(cols[0] if p[0] not in long_ones else F.size(cols[0]), F.lit(0))
        hit = F.filter(cols[0], lambda x: reduce(lambda a, b: a & b, [F.coalesce(F.array_contains(m, x + j + 1), F.lit(False)) for j, m in enumerate(cols[1:])]))
        return F.greatest(F.coalesce(F.size(hit), F.lit(0)), F.lit(0))

    rows = at.select("label", "dl", *[F.greatest(times(p), F.lit(0)).alias(f"t{i}") for i, p in enumerate(phrases)])
    counts = rows.agg(F.lit(n).alias("n"), F.lit(avgdl).alias("avgdl"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"n{i}") for i in range(len(phrases))])
    from .search import _score

    return _score(rows, len(phrases), every, counts)
