"""Token ids in patched frame-of-reference blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, text_of
from .encode import encode_batches, vocabulary

BLOCK = 128
MAGIC = b"PFB1"
TABLE_SCHEMA = (
    "part int, chunk int, before long, n_ids long, doc_ids array<long>, doc_lens array<long>, payload binary"
)


def pack_blocks(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """One chunk of ids as bytes.

    Layout (little-endian): magic, uint32 number of ids, uint32 number of blocks, then for each block
    its byte start (uint32), then the blocks. A block of 128 ids: uint32 minimum, uint8 width,
    uint8 number of exceptions, the differences' low ``width`` bits, bit-packed, then the exceptions:
    positions (uint8) and high bits (uint32). The width covers ``percentile`` of the
    differences; what is wider keeps its low bits in place and its high bits in the list."""
    ids = np.asarray(ids, np.uint32)
    n = len(ids)
    nb = -(-n // BLOCK)
    if not n:
        return MAGIC + np.array([0, 0], "<u4").tobytes()
    full = np.concatenate([ids, np.full(nb * BLOCK - n, ids[-1], np.uint32)]).reshape(nb, BLOCK)
    low = full.min(1)
    diff = full - low[:, None]
    at = min(BLOCK - 1, int(BLOCK * percentile))
    cut = np.partition(diff, at, axis=1)[:, at]
    width = np.where(cut > 0, np.floor(np.log2(np.maximum(cut, 1))).astype(np.int64) + 1, 0)
    high = diff >> width[:, None].astype(np.uint32)
    exc = high != 0
    count = exc.sum(1)
    packed: list[bytes] = [b""] * nb
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            bits = (diff[rows][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
            raw = np.packbits(bits.astype(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
            for r, x in zip(rows.tolist(), raw):
                packed[r] = x.tobytes()
    where_row, where_pos = np.nonzero(exc)
    pos, val = where_pos.astype(np.uint8), high[where_row, where_pos].astype("<u4")
    ends = np.cumsum(count)
    head = np.zeros(nb, np.dtype([("min", "<u4"), ("w", "u1"), ("e", "u1")]))
    head["min"], head["w"], head["e"] = low, width, count
    heads, p, v = head.tobytes(), pos.tobytes(), val.tobytes()
    blocks = []
    for r in range(nb):
        e1 = int(ends[r])
        e0 = e1 - int(count[r])
        blocks.append(heads[6 * r : 6 * r + 6] + packed[r] + p[e0:e1] + v[4 * e0 : 4 * e1])
    sizes = np.array([len(b) for b in blocks], np.int64)
    starts = 12 + 4 * nb + np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return b"".join([MAGIC, np.array([n, nb], "<u4").tobytes(), starts.astype("<u4").tobytes(), *blocks])


def unpack_blocks(raw: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks ``first`` to ``last`` (all by default), found by the index of block starts."""
    if raw[:4] != MAGIC:
        raise ValueError("not a block file")
    n, nb = np.frombuffer(raw, "<u4", 2, 4).tolist()
    last = nb if last is None else min(last, nb)
    if last <= first:
        return np.zeros(0, np.uint32)
    buf = np.frombuffer(raw, np.uint8)
    starts = np.frombuffer(raw, "<u4", nb, 12)[first:last].astype(np.int64)
    m = last - first
    low = buf[starts[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    width, count = buf[starts + 4].astype(np.int64), buf[starts + 5].astype(np.int64)
    out = np.zeros((m, BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            body = buf[starts[rows][:, None] + 6 + np.arange(16 * w)]
            bits = np.unpackbits(body, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            room, kind = (16, "<u2") if w <= 16 else (32, "<u4")
            wide = np.zeros((len(rows), BLOCK, room), np.uint8)
            wide[:, :, :w] = bits
            out[rows] = np.packbits(wide, axis=2, bitorder="little").view(kind)[:, :, 0]
    row = np.repeat(np.arange(m), count)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = (starts + 6 + 16 * width)[row]
        value = buf[(at + count[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        out[row, buf[at + nth]] |= value << width[row].astype(np.uint32)
    out += low[:, None]
    return out.reshape(-1)[: min(n - first * BLOCK, m * BLOCK)]


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = 1,
    chunk_ids: int = 500_000,
) -> None:
    """Encodes ``docs(doc_id, text)``, appends ``end_id`` to each document and writes the ids as
    block files in ascending doc_id order: table ``path``, one row for each chunk of whole
    documents (about ``chunk_ids`` ids), in the order of (part, chunk). The table is written by
    Spark, so a lost task is written anew and commits once.

    Null text: empty (only the end id). Null doc_id: first. Rows that share a doc_id
    follow one another, by text. Empty table: an empty table of files."""
    vocab = tokenizer or vocabulary("word_bpe_49k.json")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        names, lens, parts, held, chunk, before = [], [], [], 0, 0, 0

        def out():
            ids = np.concatenate(parts)
            row = {"part": part, "chunk": chunk, "before": before, "n_ids": held, "doc_ids": names, "doc_lens": lens, "payload": pack_blocks(ids)}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = pa.schema(
            [("part", pa.int32()), ("chunk", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("payload", pa.binary())]
        )
        for t, ids, ends in encode_batches(batches, vocab):
            begin = 0
            for d, stop in zip(t.column("doc_id").to_pylist(), ends.tolist()):
                names.append(d)
                parts += (ids[begin:stop], end)
                lens.append(stop - begin + 1)
                held += lens[-1]
                begin = stop
                if held >= chunk_ids:
                    yield out()
                    before += held
                    names, lens, parts, held, chunk = [], [], [], 0, chunk + 1
        if names:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    (
        rows.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, TABLE_SCHEMA)
        .write.parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Reads block files back: doc_id, start (ids of all documents before it), n_tokens, ids (as
    little-endian uint32 bytes). A chunk holds the number of ids before it in its part; only the
    parts' totals meet in one place and are broadcast (their number is that of write tasks)."""
    table = spark.read.schema(TABLE_SCHEMA).parquet(path)
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offs = parts.select(
        "part",
        F.coalesce(
            F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("earlier"),
    )

    def run(batches):
        for b in batches:
            for before, ids_of, lens, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
                ids = unpack_blocks(raw).astype("<u4").tobytes()
                sizes = np.array(lens, np.int64)
                ends = np.cumsum(sizes)
                begin = ends - sizes
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids_of, pa.int64()),
                        pa.array(begin + before, pa.int64()),
                        pa.array(lens, pa.int64()),
                        pa.array([ids[4 * x : 4 * y] for x, y in zip(begin.tolist(), ends.tolist())], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return (
        table.select("part", "before", "doc_ids", "doc_lens", "payload")
        .join(F.broadcast(offs), "part")
        .select((F.col("before") + F.col("earlier")).alias("before"), "doc_ids", "doc_lens", "payload")
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
    )


def token_table(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes and reads back: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
