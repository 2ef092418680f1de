"""Best-fit packing: minimum bin slack over the histogram of lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prefix_sums, text_of
from .encode import encode_batches, vocabulary

PIECE_NAMES = ["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"]


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(length, copies) of a combination of available lengths whose sum is as near to ``room`` as any, not over it.

    Bit s of ``reach`` says that some combination sums to s: a length shifts the bits, its copies in powers of two. The
    bits before each step lead back to the combination. Ends as soon as the room is filled. ``lengths`` descend."""
    reach, mask, steps = 1, (2 << room) - 1, []
    for n in lengths:
        left = min(counts[n], room // n)
        copies = 1
        while left and not reach >> room & 1:
            k = min(copies, left)
            steps.append((n, k, reach))
            reach |= reach << (n * k) & mask
            left -= k
            copies *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> total & 1:
            total -= n * k
            used[n] = used.get(n, 0) + k
    return sorted(used.items(), reverse=True)


def combinations(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies)]) of bins: each holds the largest length that is left and the fullest combination of others
    beside it, and is taken as often as the lengths last.

    Work and result depend on the lengths only, not on the number of rows: each entry leaves one of its lengths with fewer
    rows than it has copies, so a length ends 1 + capacity / length entries at most (in all some 40,000 for 4,096)."""
    counts = {n: c for n, c in sorted(histogram.items(), reverse=True) if c > 0}
    out = []
    while counts:
        largest = next(iter(counts))
        room = capacity - largest
        counts[largest] -= 1
        rest = fullest(counts, [n for n, c in counts.items() if c and n <= room], room)
        counts[largest] += 1
        used = dict([(largest, 1)])
        for n, k in rest:
            used[n] = used.get(n, 0) + k
        times = min(counts[n] // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
        out.append((times, sorted(used.items(), reverse=True)))
    return out


def places(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For rows numbered by ascending length: runs of numbers (``first``) that go to bins from ``bin`` on, ``copies`` to each,
    from the place ``offset`` on."""
    runs, at = [], 0
    for times, used in bins:
        offset = 0
        for n, k in used:
            runs.append((n, at, k, offset, times * k))
            offset += n * k
        at += times
    runs.sort(key=lambda r: (r[0], r[1]))
    cols = np.array(runs, np.int64).reshape(-1, 5)
    return {"first": np.cumsum(cols[:, 4]) - cols[:, 4], "length": cols[:, 0], "bin": cols[:, 1], "copies": cols[:, 2], "offset": cols[:, 3]}


def pack_best_fit(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Packs ``docs(doc_id, text)`` whole into as few sequences of at most ``capacity`` ids as minimum bin slack finds.

    Each document is encoded once and gets ``end_id``; only documents over ``capacity`` are cut, into full pieces and a last
    one. The histogram of lengths (``capacity`` rows at most, whatever the data) is all that the bins are made from; pieces
    are numbered by (length, doc_id) with prefix sums over range partitions, so those of one length need not meet in a task,
    and a piece's number gives its bin and place. Returns doc_id, piece, start, length, sequence_id, offset, ids
    (little-endian uint32 bytes); sequence ids are consecutive.

    Null text: empty (one id). Null doc_id, repeated rows: documents of their own. Very long texts: encoded whole, one row
    until they are cut. Ties of length go by doc_id. Empty table: no rows. Other columns are ignored, whatever their names."""
    vocab = tokenizer or vocabulary("word_bpe_49k.json")

    def encode(batches):
        from pyspark import TaskContext

        end = np.array([end_id], narrow)
        uid = TaskContext.get().partitionId() << 40
        for t, flat, ends in encode_batches(batches, vocab):
            n = len(ends)
            ids = np.split(flat.astype(narrow), ends[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(uid, uid + n), pa.int64()),
                    t.column("doc_id").combine_chunks(),
                    pa.array(np.diff(ends, prepend=0) + 1, pa.int64()),
                    pa.array([np.append(x, end).tobytes() for x in ids], pa.binary()),
                ],
                names=["uid", "doc_id", "doc_tokens", "ids"],
            )
            uid += n

    def place(batches):
        for b in batches:
            nth = b.column("nth").to_numpy()
            r = np.searchsorted(runs["first"], nth, "right") - 1
            k = nth - runs["first"][r]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("uid"), b.column("piece"),
                    pa.array(runs["bin"][r] + k // runs["copies"][r], pa.int64()),
                    pa.array(runs["offset"][r] + k % runs["copies"][r] * runs["length"][r], pa.int64()),
                ],
                names=["uid", "piece", "sequence_id", "offset"],
            )

    def cut(batches):
        for b in batches:
            rows = []
            for doc, raw, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "at"))):
                ids = np.frombuffer(raw, narrow)
                for p in at:
                    begin = p["piece"] * capacity
                    part = ids[begin : begin + capacity].astype("<u4")
                    rows.append((doc, p["piece"], begin, len(part), p["sequence_id"], p["offset"], part.tobytes()))
            cols = list(zip(*rows)) or [[]] * len(PIECE_NAMES)
            kinds = {"ids": pa.binary(), "piece": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(x, pa.int64())) for x, c in zip(PIECE_NAMES, cols)], names=PIECE_NAMES)

    from tokenizers import Tokenizer

    narrow = "<u2" if max(Tokenizer.from_file(vocab).get_vocab_size(), end_id) < 65536 else "<u4"
    # Written once, so that the row numbers given by the tasks hold; encoded only once.
    encoded = materialize(
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(
            encode, "uid long, doc_id long, doc_tokens long, ids binary"
        ),
        "encoded",
    )
    pieces = encoded.select("uid", "doc_id", F.posexplode(F.expr(f"transform(sequence(0L, (doc_tokens - 1) div {capacity}), k -> least({capacity}L, doc_tokens - k * {capacity}))")).alias("piece", "length"))
    histogram = pieces.groupBy("length").count().collect()  # one row a length
    runs = places(combinations({r["length"]: r["count"] for r in histogram}, capacity))
    numbered = prefix_sums(pieces, ["length", "doc_id", "uid", "piece"], "length", "lengths").select("uid", "piece", "nth")
    placed = numbered.mapInArrow(place, "uid long, piece int, sequence_id long, offset long")
    # A document's pieces are as many as its length allows; they meet where its ids are.
    at = placed.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("piece", "sequence_id", "offset"))).alias("at"))
    kinds = {"ids": "binary", "piece": "int"}
    return encoded.select("uid", "doc_id", "ids").join(at, "uid").mapInArrow(cut, ", ".join(f"{x} {kinds.get(x, 'long')}" for x in PIECE_NAMES))
