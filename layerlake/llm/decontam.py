"""Benchmark decontamination with an FM-index for each training shard."""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prefix_sums, release_memory, row_key, text_of

WINDOW = 10
#: Bytes to words: A-Z to lower case; what may not be in a word becomes a space. Bytes of non-ASCII
#: characters are all above 0x7F and belong to words.
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
WORD = re.compile(rb"[^ ]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


class FMIndex:
    """Full-text index of a sequence of integers 0 to ``sigma - 1``: search and ranks without the sequence itself."""

    STEP = 16

    def __init__(self, seq: np.ndarray, sigma: int):
        t = np.concatenate([np.asarray(seq, np.int64) + 1, [0]])  # 0 ends the text
        n = self.n = len(t)
        sa = self._suffixes(t)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=sigma + 2))])
        x = t[sa - 1].astype(np.int32)  # the transform
        self.levels = []  # wavelet matrix, top bit first: bits, ones before each 64 of them, and the number of zeros
        for b in range(max(1, int(sigma + 1).bit_length()) - 1, -1, -1):
            one = (x >> b & 1).astype(bool)
            self.levels.append((b, *self._packed(one), n - int(np.count_nonzero(one))))
            x = np.concatenate([x[~one], x[one]])
        marked = sa % self.STEP == 0
        self.marks = self._packed(marked)
        self.samples = sa[marked].astype(np.int32)

    @staticmethod
    def _packed(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.packbits(np.pad(bits, (0, 64 - len(bits) % 64)), bitorder="little").view(np.uint64)
        return words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32)

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Ones in the first ``i`` bits."""
        at = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[at] + np.bitwise_count(words[at] & low).astype(np.int64)

    @staticmethod
    def _suffixes(t: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling; suffixes that no other one equals so far are not sorted again."""
        n, h = len(t), 1
        sa = np.argsort(t)
        start = np.flatnonzero(np.r_[True, np.diff(t[sa]) != 0])
        group = np.repeat(start, np.diff(np.r_[start, n]))  # a suffix ranks as the first of its equals
        rank = np.empty(n, np.int64)
        rank[sa] = group
        size = np.diff(np.r_[start, n])
        left = np.flatnonzero(np.repeat(size, size) > 1)
        while len(left):
            rows = sa[left]
            key = rank[rows] * n + rank[rows + h]  # equal suffixes do not reach the end, as it occurs once
            by = np.argsort(key)
            rows, key = rows[by], key[by]
            sa[left] = rows
            new = np.r_[True, np.diff(key) != 0]
            start = np.flatnonzero(new)
            size = np.diff(np.r_[start, len(key)])
            rank[rows] = np.repeat(left[start], size)
            left = left[np.repeat(size, size) > 1]
            h *= 2
        return sa

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each ``c`` in the first ``i`` places of the transform."""
        lo, hi = np.zeros_like(i), i.copy()
        for b, words, before, zeros in self.levels:
            one = ((c >> b) & 1) == 1
            l1, h1 = self._ones(words, before, lo), self._ones(words, before, hi)
            lo = np.where(one, zeros + l1, lo - l1)
            hi = np.where(one, zeros + h1, hi - h1)
        return hi - lo

    def last(self, row: np.ndarray) -> np.ndarray:
        """The transform's symbols at rows, read from the levels."""
        at, c = row.copy(), np.zeros_like(row)
        for b, words, before, zeros in self.levels:
            one = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(words, before, at)
            c |= one.astype(np.int64) << b
            at = np.where(one, zeros + ones, at - ones)
        return c

    def search(self, patterns: np.ndarray, lengths: np.ndarray):
        """Row ranges of the patterns (rows of a padded matrix), by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        at = lengths - 1
        while True:
            live = np.flatnonzero((at >= 0) & (hi > lo))
            if not len(live):
                return lo, hi
            c = patterns[live, at[live]] + 1
            lo[live] = self.first[c] + self.rank(c, lo[live])
            hi[live] = self.first[c] + self.rank(c, hi[live])
            at[live] -= 1

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled suffix."""
        row, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        words, before = self.marks
        while len(live):
            r = row[live]
            done = (words[r >> 6] >> (r & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            d = live[done]
            out[d] = self.samples[self._ones(words, before, row[d])] + steps[d]
            live = live[~done]
            c = self.last(row[live])
            row[live] = self.first[c] + self.rank(c, row[live])
            steps[live] += 1
        return out


class Phrases:
    """The distinct windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        owners: dict[tuple, set] = {}
        self.window = window
        for item, text in items:
            w = words_of(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                owners.setdefault(tuple(w[i : i + window]), set()).add(item)
        self.keys = list(owners)
        self.items = [sorted(owners[k]) for k in self.keys]
        self.lengths = np.array([len(k) for k in self.keys], np.int64)

    def numbered(self, vocab: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Windows all of whose words are in a shard, as numbers of its vocabulary: (which, rows of a padded matrix)."""
        which, rows = [], []
        for n, k in enumerate(self.keys):
            ids = [vocab.get(w, 0) for w in k]
            if all(ids):
                which.append(n)
                rows.append(ids + [0] * (self.window - len(ids)))
        return np.array(which, np.int64), np.array(rows, np.int64).reshape(-1, self.window)


class Shard:
    """The index of some texts: every word of them, numbered from 1, and a 0 after each text."""

    def __init__(self, texts: list[str]):
        vocab: defaultdict = defaultdict(count(1).__next__)
        parts: list[int] = []
        counts = []
        for t in texts:
            w = words_of(t)
            counts.append(len(w))
            parts += map(vocab.__getitem__, w)
            parts.append(0)
        self.counts = np.array(counts, np.int64)
        self.vocab = dict(vocab)
        self.index = FMIndex(np.array(parts, np.int64), len(self.vocab) + 1)

    def search(self, phrases: Phrases):
        """Matches (text, first word, length, pattern)."""
        which, patterns = phrases.numbered(self.vocab)
        lo, hi = self.index.search(patterns, phrases.lengths[which])
        found = np.flatnonzero(hi > lo)
        size = hi[found] - lo[found]
        rows = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(size)[:-1]])[: len(size)], size) + np.arange(size.sum())
        pattern = which[np.repeat(found, size)]
        at = self.index.locate(rows)
        begin = np.concatenate([[0], np.cumsum(self.counts + 1)])
        text = np.searchsorted(begin, at, "right") - 1
        return text, at - begin[text], phrases.lengths[pattern], pattern

    def found(self, phrases: Phrases) -> tuple[list[list], list[list]]:
        """By text: merged spans in words, and sorted items."""
        text, first, length, pattern = self.search(phrases)
        spans: list = [[] for _ in self.counts]
        items: list = [set() for _ in self.counts]
        for t, a, n in zip(text.tolist(), first.tolist(), length.tolist()):
            spans[t].append((a, a + n))
        for t, p in set(zip(text.tolist(), pattern.tolist())):
            items[t].update(phrases.items[p])
        return [merge(s) for s in spans], [sorted(s) for s in items]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPAN = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
FOUND = "n_words long, spans array<struct<a:int,b:int>>, items array<string>"


def _found_columns(counts, spans, items) -> list[pa.Array]:
    return [
        pa.array(counts, pa.int64()),
        pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], SPAN),
        pa.array(items, pa.list_(pa.string())),
    ]


def _shards(batches, shard_bytes: int):
    """Tables of the documents of one shard after the other."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= shard_bytes:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the (merged) spans; what stands between two words of a span goes too."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw.translate(TABLE))]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def _cut(b: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with the spans removed from its texts."""
    texts = b.column("text").to_pylist()
    for i, s in enumerate(b.column("spans").to_pylist()):
        if s:
            texts[i] = remove_spans(texts[i], [(x["a"], x["b"]) for x in s])
    return b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def search_texts(rows: DataFrame, phrases: Phrases, shard_bytes: int, cut: bool = False) -> DataFrame:
    """``rows(text, ...)`` with n_words, spans and items: each shard is indexed, searched and forgotten. ``cut``: the spans are
    removed from the texts in the same pass, so that a task has one Python worker."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        for t in _searched(batches, phrases, shard_bytes):
            for b in t.to_batches():
                yield _cut(b) if cut else b

    return rows.mapInArrow(run, f"{schema}, {FOUND}")


def _searched(batches, phrases: Phrases, shard_bytes: int):
    """Tables of shards with n_words, spans and items."""
    for t in _shards(batches, shard_bytes):
        shard = Shard(t.column("text").to_pylist())
        cols = _found_columns(shard.counts, *shard.found(phrases))
        for name, col in zip(("n_words", "spans", "items"), cols):
            t = t.append_column(name, col)
        del shard, cols
        release_memory()
        yield t


def build_index(rows: DataFrame, shard_bytes: int) -> DataFrame:
    """An index table of ``rows(k1, k2, text)``: a row for each shard with the keys of its texts and the index itself."""

    def run(batches):
        for t in _shards(batches, shard_bytes):
            keys = [pa.array([t.column(k).to_pylist()], pa.list_(pa.int64())) for k in ("k1", "k2")]
            raw = pickle.dumps(Shard(t.column("text").to_pylist()), protocol=5)
            yield pa.RecordBatch.from_arrays([*keys, pa.array([raw], pa.binary())], names=["k1", "k2", "shard"])

    return rows.select("k1", "k2", "text").mapInArrow(run, "k1 array<long>, k2 array<long>, shard binary")


def search_index(index: DataFrame, phrases: Phrases) -> DataFrame:
    """k1, k2, n_words, spans, items of the texts of an index table."""

    def run(batches):
        for b in batches:
            for k1, k2, raw in zip(*(b.column(c) for c in ("k1", "k2", "shard"))):
                shard = pickle.loads(raw.as_py())
                cols = _found_columns(shard.counts, *shard.found(phrases))
                yield pa.RecordBatch.from_arrays([k1.values, k2.values, *cols], names=["k1", "k2", "n_words", "spans", "items"])

    return index.mapInArrow(run, f"k1 long, k2 long, {FOUND}")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shard_bytes: int = 8_000_000,
    block_bytes: int = 16_000_000,
    carry: tuple = (),
    cut: bool = False,
) -> DataFrame:
    """Finds every occurrence of the benchmark's windows in whole texts of ``docs(doc_id, text)``.

    A shard is the documents that a task reads together (about ``shard_bytes``; a longer text is a shard of its own). All
    its words go into an FM-index, whatever the benchmark is; all windows are searched backward in it at once through the
    ranks of a wavelet matrix, and occurrences are located from sampled suffix positions and merged to spans. Nothing of
    the documents is shuffled. A benchmark (the stated query set) of more than ``block_bytes`` is taken in blocks: then
    the shards' indexes are written once to the shared folder, each block is searched in that table, and matches of
    several blocks are merged by document. Only one block at a time is on the driver and in a task.

    Returns doc_id, text, n_words, spans (merged, in words), items (sorted item ids as strings) and the columns named
    in ``carry`` as ``_0``, ``_1``, ... With ``cut`` the texts come without the words of the spans. Null text: no words. Null doc_id: a row as any other. Null item text or id: no
    windows, or the id ``null``. Repeated items add to each other; repeated rows: a result each. Empty tables: no rows,
    or no matches. Other columns of either table are ignored, and may have any names."""
    items = benchmark.select(
        F.coalesce(benchmark["item_id"].cast("string"), F.lit("null")).alias("item_id"), text_of(benchmark).alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    t = text_of(docs)
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), *row_key(t), t.alias("text"), *(docs[c].alias(f"_{i}") for i, c in enumerate(carry))
    )
    names = ["doc_id", "text", "n_words", "spans", "items", *(f"_{i}" for i in range(len(carry)))]
    if total <= block_bytes:
        return search_texts(rows.drop("k1", "k2"), Phrases([tuple(r) for r in items.collect()], window), shard_bytes, cut).select(*names)
    index = materialize(build_index(rows, shard_bytes), "fm-index")
    sized = prefix_sums(items.withColumn("size", F.octet_length("text").cast("long")), ["item_id", "text"], "size", "items")
    sized = materialize(sized.withColumn("block", F.expr(f"start div {block_bytes}")).select("block", "item_id", "text"), "blocks")
    found = None
    for n in range(total // block_bytes + 1):
        p = Phrases([(r.item_id, r.text) for r in sized.where(F.col("block") == n).collect()], window)
        if p.keys or found is None:
            part = materialize(search_index(index, p), "matches")
            found = part if found is None else found.unionByName(part)
    joined = F.expr(
        "aggregate(array_sort(flatten(collect_list(spans))), cast(array() as array<struct<a:int,b:int>>), (m, x) -> "
        "if(size(m) > 0 and x.a <= element_at(m, -1).b, "
        "concat(slice(m, 1, size(m) - 1), array(struct(element_at(m, -1).a as a, greatest(element_at(m, -1).b, x.b) as b))), concat(m, array(x))))"
    )
    merged = found.groupBy("k1", "k2").agg(
        F.max("n_words").alias("n_words"), joined.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    whole = rows.join(merged, ["k1", "k2"]).select(*names)
    return whole.mapInArrow(lambda it: map(_cut, it), whole.schema) if cut else whole


DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination_digest(found: DataFrame) -> DataFrame:
    """Counts and the hash of the item list of each row of ``find_contamination``."""

    def run(batches):
        for b in batches:
            rows = []
            for d, n, s, i in zip(*(b.column(k).to_pylist() for k in range(4))):
                hit = sum(z["b"] - z["a"] for z in s)
                rows.append((d, n, hit, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), hit > 0))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in DIGEST.split(", ")]
            )

    return found.select("doc_id", "n_words", "spans", "items").mapInArrow(run, DIGEST)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs``, all columns (whatever their names), with the words of all matched spans removed from their
    texts. Odd rows and tables: as in ``find_contamination``; a null text becomes an empty one."""
    names = list(docs.columns)
    others = [c for c in names if c not in ("doc_id", "text")]
    found = find_contamination(docs, benchmark, carry=tuple(others), cut=True, **kw)
    held = {"doc_id": "doc_id", "text": "text", **{c: f"_{i}" for i, c in enumerate(others)}}
    return found.select(*(F.col(held[c]).alias(c) for c in names))
