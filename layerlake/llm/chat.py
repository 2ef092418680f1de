"""Chat rendering with token-level loss masks."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import vocabulary

#: A header opens each turn and END closes it; inside texts and roles every control string,
#: and the backslash itself, gets a backslash before it.
HEADER, END = "### {role}\n", "</turn>\n"
PIECE = re.compile(r"\\(.)|### |</turn>\n", re.S)

FORMAT_SCHEMA = (
    "conv_id long, segment int, formatted string, ids array<int>, mask array<boolean>, "
    "loss_spans array<struct<a:int,b:int>>"
)
DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


def escape(text: str, role: bool = False) -> str:
    """Reversible: ``unescape(escape(t)) == t``. Roles also have their line feeds escaped."""
    return re.sub(r"\\|#(?=##)|<(?=/turn>)" + (r"|\n" if role else ""), lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation as one string, and the sorted spans (code points) of its
    assistant texts."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = HEADER.format(role=escape(role, True)), escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Inverse of ``render``."""
    turns, at, body = [], 0, -1
    role = ""
    while at < len(formatted):
        if body < 0:
            m = re.compile(r"### ((?:\\.|[^\\\n])*)\n", re.S).match(formatted, at)
            role, at = unescape(m[1]), m.end()
            body = at
        m = PIECE.search(formatted, at)
        if m[0] == END:
            turns.append((role, unescape(formatted[body : m.start()])))
            body = -1
        at = m.end()
    return turns


def align(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]):
    """Mask of the tokens that meet a span, and the exact intersections in code points.
    Both lists are sorted, so each span finds its first and last token by binary search."""
    at = np.array(offsets, np.int64).reshape(-1, 2)
    a, b = at[:, 0], at[:, 1]
    mask = np.zeros(len(a), bool)
    pieces: list[tuple[int, int]] = []
    for s, e in spans:
        if e <= s:
            continue
        i, j = np.searchsorted(b, s, "right"), np.searchsorted(a, e, "left")
        mask[i:j] = True
        x, y = np.maximum(a[i:j], s), np.minimum(b[i:j], e)
        x, y = x[y > x], y[y > x]
        if len(x):
            end = np.maximum.accumulate(y)  # several byte tokens may share one character
            first = np.flatnonzero(np.r_[True, x[1:] > end[:-1]])
            pieces += zip(x[first].tolist(), end[np.r_[first[1:] - 1, len(x) - 1]].tolist())
    return mask, pieces


def _segments(batches, limit: int):
    """(conv_id, segment number, turns) of rows sorted by conversation and turn; a conversation
    of over ``limit`` characters is cut between turns, so memory stays bounded."""
    conv, seg, turns, size = None, 0, [], 0
    for b in batches:
        for c, role, text in zip(*(b.column(x).to_pylist() for x in ("k", "role", "text"))):
            if c != conv or size > limit:
                if turns:
                    yield conv, seg, turns
                seg = seg + 1 if c == conv else 0
                conv, turns, size = c, [], 0
            turns.append((role, text))
            size += len(text)
    if turns:
        yield conv, seg, turns


NULL_ID = -(2**63)


def format_conversations(
    conversations: DataFrame, tokenizer: str | None = None, limit: int = 2_000_000
) -> DataFrame:
    """Renders ``conversations(conv_id, turn, role, text)``, one row for each conversation (a very long one:
    several numbered segments of whole turns), encodes each rendering once with
    offsets and masks the tokens that meet an assistant text.

    Null text or role: empty. Null turn: sorts first; equal turns go by role, then text;
    repeated rows are turns of their own. Rows of a null conv_id form one conversation.
    Empty table: no rows. Other columns are ignored.
    Rows of one conversation stream through one task in turn order (a rendering has an order), with memory bounded by
    ``limit``. A segment ends with a line feed and the next begins with a mark, where the vocabulary's pre-tokenizer always
    cuts, so the segments' ids are those of the whole rendering encoded at once (tested)."""
    path = tokenizer or vocabulary("byte_bpe_50k.json")

    def table(rows):
        conv, seg, texts, ids, masks, pieces = zip(*rows)

        def lists(values, kind):
            ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else [], kind))

        at = np.array([x for p in pieces for x in p], np.int32).reshape(-1, 2)
        ends = np.cumsum([0, *map(len, pieces)], dtype=np.int32)
        spans = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], names=["a", "b"]))
        return pa.RecordBatch.from_arrays(
            [pa.array([None if c == NULL_ID else c for c in conv], pa.int64()), pa.array(seg, pa.int32()), pa.array(texts, pa.string()),
             lists([np.array(x, np.int32) for x in ids], pa.int32()), lists(masks, pa.bool_()), spans],
            names=["conv_id", "segment", "formatted", "ids", "mask", "loss_spans"],
        )

    def run(batches):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        rows, size = [], 0
        for conv, seg, turns in _segments(batches, limit):
            text, spans = render(turns)
            e = tok.encode(text, add_special_tokens=False)
            rows.append((conv, seg, text, e.ids, *align(e.offsets, spans)))
            size += len(text)
            if size > limit:
                yield table(rows)
                rows, size = [], 0
        if rows:
            yield table(rows)

    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("k"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return (
        rows.repartition("k")
        .sortWithinPartitions("k", "turn", "role", "text")
        .select("k", "role", "text")
        .mapInArrow(run, FORMAT_SCHEMA)
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back: turns, and the text under the loss mask."""

    def run(batches):
        conv, state = None, None

        def row():
            c, n, th, lc, lh, fc = state
            return (None if c == NULL_ID else c, n, th.hexdigest(), lc, lh.hexdigest(), fc)

        for b in batches:
            out = []
            for c, text, spans in zip(*(b.column(x).to_pylist() for x in ("k", "formatted", "loss_spans"))):
                if c != conv:
                    if state:
                        out.append(row())
                    conv, state = c, [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, t in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{t}\n".encode())
                for s in spans:
                    under = unescape(text[s["a"] : s["b"]])
                    state[3] += len(under)
                    state[4].update(under.encode())
                state[5] += len(text)
            yield _digest_batch(out)
        if state:
            yield _digest_batch([row()])

    return (
        formatted.select(
            F.coalesce("conv_id", F.lit(NULL_ID)).alias("k"), "segment", "formatted", "loss_spans"
        )
        .repartition("k")
        .sortWithinPartitions("k", "segment")
        .select("k", "formatted", "loss_spans")
        .mapInArrow(run, DIGEST_SCHEMA)
    )


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in DIGEST_SCHEMA.split(", ")))
    cols = list(zip(*rows)) or [()] * len(names)
    types = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(cols, kinds)], names=list(names))
