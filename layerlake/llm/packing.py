"""Sequence packing along a space-filling curve."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prefix_sums, text_of
from .encode import encode_batches, vocabulary

DIMS, BITS = 3, 10
#: Spread of the mean projections before they are cut into 2**BITS cells.
SCALE = 4.0
PIECE_NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def projection(n_buckets: int = 65536, dims: int = DIMS, seed: int = 17) -> np.ndarray:
    """Fixed random directions of the hashed token features."""
    return np.random.default_rng(seed).standard_normal((n_buckets, dims)).astype(np.float32)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer cells [n, dims] (Skilling's transpose form)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def document_cells(ids: list[np.ndarray], proj: np.ndarray, dims: int = DIMS, bits: int = BITS):
    """Cells of documents: mean projection of their hashed tokens, scaled by the square root
    of the length (unit variance for unrelated tokens) and squashed to the cube."""
    out = np.zeros((len(ids), dims))
    for r, x in enumerate(ids):
        if len(x):
            at = x if x.dtype == np.uint16 and len(proj) == 65536 else x.astype(np.int64) % len(proj)
            out[r] = proj[at].sum(0, dtype=np.float64) / np.sqrt(len(x))
    unit = 0.5 + np.arctan(out / SCALE) / np.pi
    return np.clip((unit * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)


def pack(
    docs: DataFrame, tokenizer: str | None = None, length: int = 2048, end_id: int = 1
) -> DataFrame:
    """Packs ``docs(doc_id, text)`` into sequences of ``length`` ids.

    Each document is encoded once, gets ``end_id``, and a key on a Hilbert curve from its hashed
    token vector. Documents are range-sorted by (key, doc_id), global token positions are
    prefix sums along the curve, and the stream is cut every ``length`` ids: every sequence
    but the last is full, and neighbours on the curve share sequences. Returns the pieces:
    doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32 bytes).

    Null text: empty (one id). Null doc_id, repeated rows: documents of their own. Empty table:
    no rows. Other columns are ignored."""
    vocab = tokenizer or vocabulary("byte_bpe_50k.json")

    def encode(batches):
        from pyspark import TaskContext

        proj = projection()
        end = np.array([end_id], narrow)
        uid = TaskContext.get().partitionId() << 40
        for t, flat, ends in encode_batches(batches, vocab):
            n = len(ends)
            ids = np.split(flat.astype(narrow), ends[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(uid, uid + n), pa.int64()),
                    t.column("doc_id").combine_chunks(),
                    pa.array(hilbert_key(document_cells(ids, proj)), pa.int64()),
                    pa.array(np.diff(ends, prepend=0) + 1, pa.int64()),
                    pa.array([np.append(x, end).tobytes() for x in ids], pa.binary()),
                ],
                names=["uid", "doc_id", "hilbert", "doc_tokens", "ids"],
            )
            uid += n

    def cut(batches):
        for b in batches:
            rows = []
            for doc, n, raw, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "ids", "start"))):
                ids = np.frombuffer(raw, narrow).astype("<u4")
                begin = 0
                while begin < n:
                    seq, off = divmod(at + begin, length)
                    k = min(n - begin, length - off)
                    rows.append((doc, begin, k, n, seq, off, ids[begin : begin + k].tobytes()))
                    begin += k
            cols = list(zip(*rows)) or [[]] * len(PIECE_NAMES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary() if x == "ids" else pa.int64()) for x, c in zip(PIECE_NAMES, cols)],
                names=PIECE_NAMES,
            )

    from tokenizers import Tokenizer

    narrow = "<u2" if max(Tokenizer.from_file(vocab).get_vocab_size(), end_id) < 65536 else "<u4"
    # Written once, so that the row numbers given by the tasks hold; encoded only once.
    encoded = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(
            encode, "uid long, doc_id long, hilbert long, doc_tokens long, ids binary"
        ),
        "encoded",
    )
    places = prefix_sums(
        encoded.select("uid", "doc_id", "hilbert", "doc_tokens"), ["hilbert", "doc_id", "uid"], "doc_tokens", "curve"
    ).select("uid", "start")
    return (
        encoded.select("uid", "doc_id", "doc_tokens", "ids")
        .join(places, "uid")
        .mapInArrow(cut, ", ".join(f"{x} {'binary' if x == 'ids' else 'long'}" for x in PIECE_NAMES))
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (array of int), in piece order. A group has
    ``length`` ids at most."""
    return pieces.groupBy("sequence_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]
        ).alias("parts")
    ).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p)).alias("ids"))
