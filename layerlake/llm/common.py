"""Helpers shared by the corpus operators: session settings, tables in the shared
folder, global prefix sums and connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPO_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on: workers can import this package, and
    Arrow batches stay small enough for very long texts."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if REPO_ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([REPO_ROOT, *(p for p in have if p)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only where unset, in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints", "layerlake")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/layerlake/{tag}-{uuid.uuid4().hex}"


def release_memory() -> None:
    """Gives what is free back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run):
    """``run`` over a task's batches, after which the worker, which may serve other stages, gives its memory back."""

    def out(batches):
        yield from run(batches)
        release_memory()

    return out


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage,
    and a lost executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove the files of a table written by ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {os.path.dirname(f) for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(docs: DataFrame, name: str = "text"):
    """The text column, null as the empty string."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def row_key(text_col) -> list:
    """Columns that name a row: its id and a hash of its text, so that rows which share an
    id (or are repeated) stay apart or give equal results."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k1"),
        F.xxhash64(text_col).alias("k2"),
    ]


def halved(b: pa.RecordBatch, size: int):
    """The batch cut between rows, until no part of several rows has more than ``size`` bytes."""
    if b.num_rows < 2 or b.nbytes <= size:
        yield b
    else:
        yield from halved(b.slice(0, b.num_rows // 2), size)
        yield from halved(b.slice(b.num_rows // 2), size)


def gathered(batches, size: int, rows: int | None = None):
    """Batches joined up to about ``size`` bytes (or ``rows`` rows); larger ones are cut between rows."""
    held, n, k = [], 0, 0
    for b in (part for whole in batches for part in halved(whole, size)):
        if b.num_rows:
            held.append(b)
            n, k = n + b.nbytes, k + b.num_rows
        if n >= size or rows and k >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n, k = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _running(batches, value: str):
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    total = rows = 0
    for b in batches:
        v = b.column(value).to_numpy(zero_copy_only=False).astype("int64")
        end = v.cumsum() + total
        n = len(v)
        yield pa.RecordBatch.from_arrays(
            [
                *b.columns,
                pa.array([pid] * n, pa.int32()),
                pa.array(end - v, pa.int64()),
                pa.array(range(rows, rows + n), pa.int64()),
            ],
            names=[*b.schema.names, "_pid", "_before", "_nth"],
        )
        if n:
            total, rows = int(end[-1]), rows + n


def prefix_sums(df: DataFrame, order: list[str], value: str, tag: str) -> DataFrame:
    """Adds to each row, in the total order ``order``: ``start`` (sum of ``value`` in all rows
    before it), ``nth`` (number of rows before it) and ``total`` (sum over all rows).

    Range partitions are summed on their own; only one total for each partition meets in
    one place (and is broadcast: its size is the number of partitions)."""
    spark = df.sparkSession
    schema = T.StructType(
        [*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_before", T.LongType()), T.StructField("_nth", T.LongType())]
    )
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    t = materialize(sorted_.mapInArrow(lambda it: _running(it, value), schema), tag)
    per = t.groupBy("_pid").agg(F.sum(value).alias("_v"), F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select(
        "_pid",
        F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_v0"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.sum("_v").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    return t.join(F.broadcast(offs), "_pid").select(
        *df.columns,
        (F.col("_before") + F.col("_v0")).alias("start"),
        (F.col("_nth") + F.col("_n0")).alias("nth"),
        "total",
    )


class BitFilter:
    """Two bits for each key of ``keys`` in a table of 16 bits a key (a written table: it is counted first): a row whose bits are
    not set is surely not among them, and of those not among them 1.4 % pass; whoever uses it checks those. A table has
    2**28 bits (32 MB) at most, for what the driver and each worker hold: beyond 17 million keys more rows pass (5 % at
    33 million), but never fewer. ``column`` holds 64-bit hashes."""

    def __init__(self, keys: DataFrame, column: str, most: int = 28):
        power = min(most, max(16, (16 * keys.count() - 1).bit_length()))
        self.column, self.mask = column, np.uint64((1 << power) - 1)
        places = F.explode(F.array(*(F.shiftrightunsigned(F.col(column), n).bitwiseAND(F.lit((1 << power) - 1)) for n in (0, 32)))).alias("p")
        words = keys.select(places).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))
        got = words.toPandas()
        self.words = np.zeros(1 << power - 6, np.uint64)
        self.words[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for n in (0, 32):
            p = hashes.view(np.uint64) >> np.uint64(n) & self.mask
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that may be among the keys, and rows that are not."""

        def run(batches, wanted):
            for b in batches:
                ok = self.passes(b.column(self.column).to_numpy(zero_copy_only=False).astype(np.int64))
                yield b.filter(pa.array(ok == wanted))

        return df.mapInArrow(lambda it: run(it, True), df.schema), df.mapInArrow(lambda it: run(it, False), df.schema)


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)`` (any orderable type): a row (``node``, ``root``)
    for each node that has a link, with the smallest node of its component.

    Alternates taking the smallest label among neighbours (pre-aggregated before its
    shuffle) with following labels one step further, so paths shrink by doubling. Each
    round is a table in the shared folder; only a count of changes reaches the driver."""
    e = edges.select("a", "b").where("a <> b")
    e = materialize(
        e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges"
    )
    labels = materialize(
        e.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("root")
        ),
        f"{tag}-0",
    )
    step = 0
    while True:
        step += 1
        near = (
            e.join(labels, e.b == labels.node)
            .groupBy("a")
            .agg(F.min("root").alias("m"))
        )
        low = labels.join(near, labels.node == near.a).select(
            "node", "root", F.least("root", "m").alias("low")
        )
        up = labels.select(F.col("node").alias("low"), F.col("root").alias("up"))
        new = materialize(
            low.join(up, "low", "left").select(
                "node",
                F.coalesce(F.least("low", "up"), F.col("low")).alias("root"),
                (F.coalesce(F.least("low", "up"), F.col("low")) != F.col("root")).alias("moved"),
            ),
            f"{tag}-{step}",
        )
        moved = new.where("moved").limit(1).count()
        drop(labels)
        labels = new.select("node", "root")
        if not moved:
            drop(e)
            return labels
