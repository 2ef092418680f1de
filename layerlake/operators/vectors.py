"""Nearest vectors for many queries: vectors in cells, cells skipped by a bound that loses nothing.

A cell is a centroid with the vectors nearest to it, as unit vectors, and the largest distance of one of them. By the triangle
inequality no vector of a cell is nearer to a query than the centroid's distance less that radius."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block: what one step compares with a chunk of queries.
BLOCK_ROWS, CHUNK_QUERIES = 4096, 512
SLACK = 1e-9


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors of a batch in rows; of vectors of other lengths than the first, the excess goes and what lacks is 0."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(size) and (size == size[0]).all():
        return flat.reshape(len(size), -1)
    out = np.zeros((len(size), int(size.max()) if len(size) else 0))
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v or [])] = v or []
    return out


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((m * m).sum(1))
    return m / np.where(norm == 0, 1, norm)[:, None], norm


def _nearest(m: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector its nearest centroid and the distance."""
    d = (m * m).sum(1)[:, None] - 2 * m @ centroids.T + (centroids * centroids).sum(1)[None]
    cell = d.argmin(1)
    return cell, np.sqrt(np.maximum(((m - centroids[cell]) ** 2).sum(1), 0))


def centroids(vectors: DataFrame, vector: str, cells: int, sample: int = 4096, rounds: int = 6) -> np.ndarray:
    """Up to ``cells`` centroids from at most ``sample`` rows, chosen by hash (a documented bound: any centroids give the same results)."""
    rows = vectors.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(vector)).limit(sample).collect()
    m, norm = _unit(_matrix(pa.array([r[0] for r in rows], pa.list_(pa.float64())))) if rows else (np.zeros((0, 1)), np.zeros(0))
    m = np.unique(m[norm > 0], axis=0) if len(m) else m
    if not len(m):
        return np.zeros((1, m.shape[1] or 1))
    c = m[np.linspace(0, len(m) - 1, min(cells, len(m))).astype(int)]
    for _ in range(rounds):
        cell, _ = _nearest(m, c)
        n = np.bincount(cell, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, cell, m)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


class Cells:
    """The vectors of a table in cells, written once to the checkpoint folder: blocks (cell, part, labels, matrix, norms) and
    what each cell holds. ``label`` is unique; null vectors are left out."""

    def __init__(self, vectors: DataFrame, label: str, vector: str, cells: int | None = None):
        self.spark = vectors.sparkSession
        rows = vectors.where(F.col(vector).isNotNull()).select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
        n = rows.count()
        self.kind = rows.schema["label"].dataType
        self.centroids = c = centroids(rows, "v", cells or int(np.clip(np.sqrt(n) / 2, 1, 256)))
        schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType()), T.StructField("label", self.kind), T.StructField("v", T.ArrayType(T.DoubleType()))])

        def assign(batches):
            for b in batches:
                m = _fit(_unit(_matrix(b.column("v")))[0], c.shape[1])
                cell, far = _nearest(m, c)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(far), b.column("label"), b.column("v")], names=schema.names)

        placed = rows.mapInArrow(assign, schema).checkpoint()
        # one row a cell (256 at most); a large cell has several parts
        self.radius, self.parts = np.full(len(c), -np.inf), np.zeros(len(c), np.int64)
        for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
            self.radius[r.cell], self.parts[r.cell] = r.far, -(-r.n // BLOCK_ROWS)
        many = F.element_at(F.lit(self.parts.tolist()), F.col("cell") + 1)
        self.rows = placed.select("cell", F.pmod(F.xxhash64("label"), many).cast("int").alias("part"), "label", "v")

    def _pairs(self, asked: DataFrame, least: DataFrame | None, floor: float, first: bool) -> DataFrame:
        """cell, part, query_id, q: each query beside the blocks of the cells that can hold hits of it: the nearest cell only
        (``first``), or those whose bound reaches the query's threshold (``least(query_id, at)``, else ``floor``)."""
        c, radius, parts = self.centroids, self.radius, self.parts
        asked = asked.withColumn("at", F.lit(floor)) if least is None else asked.join(least, "query_id", "left").withColumn("at", F.greatest(F.coalesce("at", F.lit(floor)), F.lit(floor)))
        schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("part", T.IntegerType()), asked.schema["query_id"], asked.schema["q"]])

        def run(batches):
            for b in batches:
                m = _fit(_unit(_matrix(b.column("q")))[0], c.shape[1])
                d = np.sqrt(np.maximum((m * m).sum(1)[:, None] - 2 * m @ c.T + (c * c).sum(1)[None], 0))
                near = np.maximum(d - radius[None], 0)
                near[:, parts == 0] = np.inf
                # of unit vectors at a distance d the cosine is 1 - d * d / 2; a zero vector has the cosine 0 with all
                high = np.where((m * m).sum(1)[:, None] > 0, 1 - near * near / 2, 0.0)
                high = np.maximum(high, np.where(np.isinf(near), -np.inf, 0.0)) if floor <= 0 else high
                if first:
                    take = np.zeros(high.shape, bool)
                    take[np.arange(len(m)), np.argmin(near, 1)] = True
                else:
                    take = high + SLACK >= b.column("at").to_numpy(zero_copy_only=False)[:, None] - 1e-6
                take &= parts[None] > 0
                i, cell = np.nonzero(take)
                n = parts[cell]
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                i, cell = pa.array(np.repeat(i, n)), pa.array(np.repeat(cell, n), pa.int32())
                yield pa.RecordBatch.from_arrays([cell, pa.array(part, pa.int32()), b.column("query_id").take(i), b.column("q").take(i)], names=schema.names)

        return asked.select("query_id", "q", "at").mapInArrow(run, schema)

    def _scores(self, pairs: DataFrame, k: int, floor: float) -> DataFrame:
        """query_id, label, score (not rounded): the ``k`` best of each block for each query beside it. Rows and queries are packed into
        matrices by block and meet in one equi-join; a block has about ``BLOCK_ROWS`` rows, so no key is large."""
        at = Window.partitionBy("cell", "part").orderBy("query_id")
        chunks = pairs.withColumn("chunk", F.floor((F.row_number().over(at) - 1) / CHUNK_QUERIES)).groupBy("cell", "part", "chunk").agg(F.collect_list(F.struct("query_id", "q")).alias("qs"))
        blocks = self.rows.groupBy("cell", "part").agg(F.collect_list(F.struct("label", "v")).alias("rows"))
        ids = pairs.schema["query_id"].dataType
        schema = T.StructType([T.StructField("query_id", ids), T.StructField("label", self.kind), T.StructField("score", T.DoubleType())])

        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    qs, rows = b.column("qs")[i].values, b.column("rows")[i].values
                    labels, m = rows.field("label"), _matrix(rows.field("v"))
                    q = _fit(_matrix(qs.field("q")), m.shape[1])
                    norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((m * m).sum(1))[None]
                    s = np.where(norm == 0, 0.0, (q @ m.T) / np.where(norm == 0, 1, norm))
                    cut = np.sort(s, 1)[:, -k][:, None] if s.shape[1] > k else floor
                    x, y = np.nonzero((s >= floor) & (s >= cut - 1e-6))  # ties of rounded scores are all kept
                    yield pa.RecordBatch.from_arrays([qs.field("query_id").take(pa.array(x)), labels.take(pa.array(y)), pa.array(s[x, y])], names=schema.names)

        small = self.spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row is a block of vectors
        try:
            return chunks.join(blocks, ["cell", "part"]).select("qs", "rows").mapInArrow(run, schema).checkpoint()
        finally:
            self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)

    def top(self, asked: DataFrame, query_id: str, vector: str, k: int, least: float = 0.35) -> DataFrame:
        """query_id, label, score, rank: the ``k`` most similar rows, at least ``least`` like it, for each of ``asked``; ties
        go by label. Equal to comparing all rows: the k-th best of the nearest cell is a threshold for all others."""
        q = asked.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("q")).checkpoint()
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "label")
        short = F.round("score", 6).alias("score")
        seen = self._scores(self._pairs(q, None, least, True), k, least).select("query_id", "label", short)
        kth = seen.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k).select("query_id", F.col("score").alias("at"))
        found = self._scores(self._pairs(q, kth, least, False), k, least).select("query_id", "label", short)
        return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)

    def near(self, asked: DataFrame, query_id: str, vector: str, least: float = 0.35) -> DataFrame:
        """query_id, label, score of all rows at least ``least`` like each query."""
        q = asked.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("q")).checkpoint()
        return self._scores(self._pairs(q, None, least, False), BLOCK_ROWS * 2, least)


def _fit(m: np.ndarray, size: int) -> np.ndarray:
    """Rows cut or filled with zeros to ``size``."""
    return m[:, :size] if m.shape[1] >= size else np.pad(m, ((0, 0), (0, size - m.shape[1])))


def layered_all(cells: Cells, levels: DataFrame, label: str, level: str, asked: DataFrame, query_id: str, vector: str, k: int, least: float = 0.35, boost: float = 1.0) -> DataFrame:
    """query_id, label, score, rank: the ``k`` best by similarity times 1 + boost * level / highest level (of all rows)."""
    near = cells.near(asked, query_id, vector, least)
    high = levels.agg(F.max(level).alias("_m"))
    of = levels.select(F.col(label).alias("label"), F.col(level).alias("_l"))
    top = F.when(F.coalesce("_m", F.lit(0)) == 0, 1).otherwise(F.col("_m"))
    rows = near.join(of, "label").join(F.broadcast(high)).select("query_id", "label", F.round(F.col("score") * (1 + boost * F.col("_l") / top), 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "label")
    return rows.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def fuse_all(words: DataFrame, near: DataFrame, k: int, c: int = 60) -> DataFrame:
    """query_id, label, score, rank: reciprocal rank fusion of one ranked list ``words(label, rank)`` of any length with a short
    list of each query, ``near(query_id, label, rank)``, cut to ``k``. A row that only the long list has can be among the
    best only if it is among its first, so each query is set beside ``k`` more rows than its own list has."""
    own = near.groupBy("query_id").agg(F.count("*").alias("n"))
    both = near.join(words.select("label", F.col("rank").alias("_w")), "label", "left")
    both = both.select("query_id", "label", (1.0 / (c + F.col("rank")) + F.coalesce(1.0 / (c + F.col("_w")), F.lit(0.0))).alias("s"))
    most = (own.agg(F.max("n")).first()[0] or 0) + k
    first = words.where(F.col("rank") <= most).agg(F.collect_list(F.struct("label", "rank")).alias("first"))  # k + the length of a query's list
    more = own.join(F.broadcast(first)).select("query_id", F.explode("first").alias("x")).select("query_id", "x.label", (1.0 / (c + F.col("x.rank"))).alias("s"))
    more = more.join(near.select("query_id", "label"), ["query_id", "label"], "left_anti")
    rows = both.unionByName(more).select("query_id", "label", F.round("s", 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "label")
    return rows.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
