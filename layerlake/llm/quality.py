"""Quality scores from zstandard dictionaries."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

LEVEL = 3


def train_dictionary(texts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary from sample texts; the texts' own ends where training can't be done
    (too few or too short texts), which zstandard takes as raw content."""
    import zstandard

    if texts:
        try:
            return zstandard.train_dictionary(size, texts, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"\n".join(texts)[-size:]


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def make(raw):
            kind = zstandard.DICT_TYPE_AUTO
            d = zstandard.ZstdCompressionDict(raw, dict_type=kind) if raw else None
            if d:
                d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(
                level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False
            )

        self.good, self.bad, self.plain = make(good), make(bad), make(b"")

    def features(self, raw: bytes) -> tuple[float, float, float]:
        """Normalised difference of the sizes under the bad and the good dictionary, the size saved by the good one, and the
        plain compressed share. How many of them a model takes is chosen on its training rows (``inputs_for``)."""
        n = max(len(raw), 1)
        g, b, p = (len(c.compress(raw)) for c in (self.good, self.bad, self.plain))
        return (b - g) / max(b + g, 1), (p - g) / n, p / (n + 64)


def expand(x: np.ndarray) -> np.ndarray:
    """Inputs of the calibration: the features, their squares and products, and a constant."""
    cols = [np.ones(len(x)), *x.T]
    k = x.shape[1]
    cols += [x[:, i] * x[:, j] for i in range(k) for j in range(i, k)]
    return np.column_stack(cols)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)) * len(x)
        step = np.linalg.solve(h, x.T @ (y - p) - l2 * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def cross_loss(x: np.ndarray, y: np.ndarray, parts: int = 4) -> float:
    """Mean log loss of each part of the rows under weights from the others."""
    of, total = np.arange(len(y)) % parts, 0.0
    for k in range(parts):
        seen, left = of != k, of == k
        if not left.any() or len(set(y[seen])) < 2:
            continue
        mean, scale = x[seen].mean(0), x[seen].std(0) + 1e-9
        w = logistic(expand((x[seen] - mean) / scale), y[seen], 1e-4)
        p = 1 / (1 + np.exp(-np.clip(expand(np.clip((x[left] - mean) / scale, -6, 6)) @ w, -30, 30)))
        total -= float((y[left] * np.log(p) + (1 - y[left]) * np.log(1 - p)).sum())
    return total / max(len(y), 1)


def inputs_for(x: np.ndarray, y: np.ndarray) -> int:
    """How many of the features, the normalised difference first, lose least in cross-validation; fewer where it is equal."""
    return min(range(1, x.shape[1] + 1), key=lambda k: round(cross_loss(x[:, :k], y), 6))


class Model:
    """Dictionaries, scaling and calibration; small, and the same for every row."""

    def __init__(self, texts: list[bytes], y: np.ndarray, dict_bytes: int):
        y = np.asarray(y, float)
        fold = np.arange(len(texts)) % 2
        # Calibrated on texts that the dictionaries have not seen.
        own = [i for i in range(len(texts)) if fold[i] == 0]
        self.good = train_dictionary([texts[i] for i in own if y[i] == 1], dict_bytes)
        self.bad = train_dictionary([texts[i] for i in own if y[i] == 0], dict_bytes)
        rest = [i for i in range(len(texts)) if fold[i] == 1]
        self.mean, self.scale, self.w, self.inputs = np.zeros(3), np.ones(3), None, 3
        if len(set(y[rest])) == 2:
            c = Compressors(self.good, self.bad)
            x = np.array([c.features(texts[i]) for i in rest])
            self.inputs = inputs_for(x, y[rest])
            x = x[:, : self.inputs]
            self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
            self.w = logistic(expand((x - self.mean) / self.scale), y[rest], 1e-4)
        self.prior = float(y.mean()) if len(y) else 0.5

    def score(self, c: Compressors, texts: list[str]) -> np.ndarray:
        if self.w is None or not texts:
            return np.full(len(texts), self.prior)
        x = np.array([c.features(t.encode("utf-8", "surrogatepass"))[: self.inputs] for t in texts])
        z = expand(np.clip((x - self.mean) / self.scale, -6, 6)) @ self.w
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out_column(col: str = "doc_id"):
    """Rows that no fit may see: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = 3000, max_bytes: int = 24_000_000, dict_bytes: int = 65_536
) -> Model:
    """Fits on labelled rows outside the held-out fold.

    ``max_rows`` ids a class (those of smallest id hash) and ``max_bytes`` a class bound the sample of whole
    texts that reaches the driver; only sizes are ordered, and only chosen texts are moved. Without labels of both kinds the score is the share of good ones."""
    known = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .where(~held_out_column())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("quality").alias("quality"))
    )
    picked = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(picked), "doc_id")
    sizes = rows.select("doc_id", "quality", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n")).distinct()
    order = f"n > {max_bytes // 16}, xxhash64(doc_id), doc_id, h"  # very long texts last, so that one does not use up the sample
    w = f"sum(n) OVER (PARTITION BY quality ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    sample = sizes.withColumn("bytes", F.expr(w)).where(F.col("bytes") <= max_bytes).select("doc_id", "h")
    texts = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(sample), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    got = sorted((zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text, r.quality) for r in texts.select("doc_id", "text", "quality").collect())
    return Model([t.encode() for _, _, t, _ in got], np.array([q for *_, q in got]), dict_bytes)


def score_quality(docs: DataFrame, labels: DataFrame, cut: float = 0.7, **kw) -> DataFrame:
    """Scores every whole text of ``docs(doc_id, text)``: doc_id, held_out, score, predicted.

    The only inputs of a score are sizes of the text under compression. Null text: as the empty text.
    Null doc_id: scored, held_out false. Repeated rows: a result each. Empty table: no rows."""
    model = fit(docs, labels, **kw)

    def run(batches):
        c = Compressors(model.good, model.bad)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(model.score(c, b.column(2).to_pylist()), pa.float64())],
                names=["doc_id", "held_out", "score"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out_column().alias("held_out"), text_of(docs).alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= cut).cast("int")
    )
