"""SimHash fingerprints and their exact linkage within a Hamming radius."""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BitFilter, components, drop, materialize, row_key, text_of, tidy

BITS, RADIUS = 64, 4
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Buckets of up to this many rows are compared together, larger ones one by one.
SMALL = 64


def shingle_digests(text: str, shingle: int) -> tuple[bytes, bytes]:
    """The lower-case words of one whole text joined by single spaces, and the 8-byte hashes of its word shingles, end
    to end (of all words, if they are no more than a shingle; of no words: none)."""
    from xxhash import xxh64_digest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    norm = b" ".join(words)
    if len(words) <= shingle:
        return norm, xxh64_digest(norm, 42) if words else b""
    ends = list(accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends)]
    return norm, b"".join([xxh64_digest(norm[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])])


def majority(hashed: bytes) -> int:
    """The 64 majority bits (unsigned) of hashes that lie end to end; none: 0."""
    n = len(hashed) // 8
    ones = np.add.reduce(np.unpackbits(np.frombuffer(hashed, np.uint8)).reshape(n, BITS), axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str, shingle: int = 4) -> int:
    """64-bit SimHash (unsigned) of the word shingles of one whole text; no words: 0."""
    return majority(shingle_digests(text, shingle)[1])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every row; null text: no words."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def planes_of(fp: np.ndarray) -> np.ndarray:
    """Bit planes [slabs, 64]: word (s, p) has bit p of the rows 64 s to 64 s + 63."""
    n = -(-len(fp) // 64) * 64
    full = np.zeros(n, np.uint64)
    full[: len(fp)] = fp
    bits = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    words = np.packbits(bits.reshape(-1, 64, 64).transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(words).view(np.uint64)[:, :, 0]


def near_lanes(planes: np.ndarray, slab: np.ndarray, query: np.ndarray, lanes: np.ndarray, radius: int = RADIUS):
    """For pairs of a slab of 64 vertical rows and a query: the word of lanes (of ``lanes``) within
    ``radius`` (at most 6). 64 distances are counted at once: a carry-save adder takes two planes
    and the lowest counter plane, its carry goes up two more. Pairs all of whose
    lanes are beyond the radius are abandoned every eight planes."""
    out = np.zeros(len(slab), np.uint64)
    live = np.arange(len(slab))
    c0, c1, c2, over = (np.zeros(len(slab), np.uint64) for _ in range(4))

    def beyond():  # count > radius, from a three-bit counter
        x = over.copy()
        for v in range(radius + 1, 8):
            x |= (c0 if v & 1 else ~c0) & (c1 if v & 2 else ~c1) & (c2 if v & 4 else ~c2)
        return x

    for p in range(0, BITS, 2):
        a, b = (
            planes[slab[live], p + k] ^ (np.uint64(0) - ((query[live] >> np.uint64(p + k)) & np.uint64(1)))
            for k in (0, 1)
        )
        half = c0 ^ a
        carry = (c0 & a) | (half & b)
        c0 = half ^ b
        up = c1 & carry
        c1 = c1 ^ carry
        over = over | (c2 & up)
        c2 = c2 ^ up
        if p % 8 == 6:
            keep = (lanes[live] & ~beyond()) != 0
            if not keep.all():
                live, c0, c1, c2, over = live[keep], c0[keep], c1[keep], c2[keep], over[keep]
            if not len(live):
                return out
    out[live] = lanes[live] & ~beyond()
    return out


def _link_small(fp: np.ndarray, end: np.ndarray, radius: int) -> np.ndarray:
    """Component labels (row numbers) of rows in buckets of up to SMALL rows; ``end`` is each
    row's end of bucket. Each row is compared with the later rows of its bucket."""
    label = np.arange(len(fp))
    rows = np.flatnonzero(end - label > 1)
    if not len(rows):
        return label
    planes = planes_of(fp)
    first = (rows + 1) // 64
    parts = []
    for step in (0, 1):
        s = first + step
        ok = s * 64 < end[rows]
        q, s = rows[ok], s[ok]
        lo = np.clip(q + 1 - s * 64, 0, 64)
        hi = np.clip(end[q] - s * 64, 0, 64)
        mask = (ALL << lo.astype(np.uint64)) & (ALL >> (64 - hi).astype(np.uint64))
        near = near_lanes(planes, s, fp[q], mask, radius)
        hit = np.flatnonzero(near)
        bits = np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, j = np.nonzero(bits)
        parts.append((q[hit[i]], s[hit[i]] * 64 + j))
    a, b = (np.concatenate(x) for x in zip(*parts))
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (before == label).all():
            break
    return label


def _link_large(fp: np.ndarray, radius: int) -> np.ndarray:
    """Labels of one large bucket. Rows found near a row leave the rest at once and are compared
    with what is left later, so a dense bucket takes few comparisons."""
    label = np.arange(len(fp))
    left = np.arange(len(fp))
    planes, vals = planes_of(fp), fp
    frontier: list[int] = []
    gone = np.zeros(len(fp), bool)
    while True:
        if not frontier:
            alive = left[~gone[left]]
            if len(alive) < 2:
                return label
            if len(alive) <= len(left) * 3 // 4:
                left = alive
                planes, vals = planes_of(fp[left]), fp[left]
            root = int(alive[0])
            gone[root] = True
            frontier, seed = [root], root
        q = frontier.pop()
        if len(left) > 128 and gone[left].mean() > 0.5:
            left = left[~gone[left]]
            planes, vals = planes_of(fp[left]), fp[left]
        n = len(left)
        if not n:
            continue
        mask = np.packbits(np.pad(~gone[left], (0, -n % 64)), bitorder="little").view(np.uint64)
        slabs = np.flatnonzero(mask)
        near = near_lanes(planes, slabs, np.full(len(slabs), fp[q]), mask[slabs], radius)
        hit = np.flatnonzero(near)
        if len(hit):
            bits = np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, j = np.nonzero(bits)
            new = left[slabs[hit[i]] * 64 + j]
            gone[new] = True
            label[new] = seed
            frontier += new.tolist()


def link_buckets(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS):
    """Star links (fp, root fp) of rows sorted by bucket ``key``; whole buckets only."""
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[cut, len(key)])
    end = np.repeat(cut + size, size)
    small = np.repeat(size <= SMALL, size)
    label = _link_small(fp, np.where(small, end, 0), radius)
    for c, n in zip(cut[size > SMALL].tolist(), size[size > SMALL].tolist()):
        label[c : c + n] = c + _link_large(fp[c : c + n], radius)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return fp[linked], fp[label[linked]]


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Bit masks, one for each choice of ``blocks - radius`` of the blocks that 64 bits are cut into. Two
    fingerprints with ``radius`` differing bits or fewer agree on all of at least one of them."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(part[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def link_fingerprints(distinct: DataFrame, n: int, radius: int = RADIUS, tag: str = "simhash") -> DataFrame:
    """Links a, b (star links inside buckets) that connect exactly the ``fp`` values within ``radius``.

    Bucket keys are longer, and tables more, for larger ``n``; the result is the same."""
    blocks = radius + 1
    while n > 4 * 2 ** (BITS * (blocks - radius) // blocks) and blocks < radius + 4:
        blocks += 1
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(blocks, radius)]
    keyed = distinct.select(
        "fp",
        F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("t", "key"),
    )

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def link(last):
            nonlocal held, rows
            t = pa.Table.from_batches(held)
            tab, key, fp = (t.column(c).to_numpy() for c in ("t", "key", "fp"))
            stop = len(key)
            if not last:
                stop = int(np.flatnonzero((key != key[-1]) | (tab != tab[-1]))[-1]) + 1 if (key[0] != key[-1] or tab[0] != tab[-1]) else 0
            if not stop:
                return None
            ids = np.r_[0, np.cumsum((key[1:stop] != key[: stop - 1]) | (tab[1:stop] != tab[: stop - 1]))]
            a, b = link_buckets(ids, fp[:stop].astype(np.int64).view(np.uint64), radius)
            held = t.slice(stop).combine_chunks().to_batches()
            rows = len(key) - stop
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        limit = 100_000
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows > limit:
                out = link(False)
                limit = max(100_000, 2 * rows)
                if out is not None:
                    yield out
        if rows:
            out = link(True)
            if out is not None:
                yield out

    return (
        keyed.repartition("t", "key").sortWithinPartitions("t", "key", "fp").mapInArrow(tidy(run), "a long, b long")
    )


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links of
    ``radius`` differing bits or fewer) of every row of ``docs(doc_id, text)``.

    Texts are reduced to fingerprints where they lie. Copies and equal fingerprints are one node, found by
    a pre-aggregated grouping; nodes are dealt to buckets that agree on enough bit blocks, compared
    bit-sliced inside them, and connected by rounds of joins. Null text or no words: fingerprint zero, linked
    as any other. Null doc_id: counts as no id when the smallest is taken. Repeated rows: a
    result each. Empty table: no rows. Other columns are ignored."""
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    links = link_fingerprints(nodes.select("fp"), nodes.count(), radius)
    roots = components(links, "simhash")
    member = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    smallest = member.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = materialize(member.join(smallest, "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def prefix_length(n, share: tuple[int, int]):
    """How many of ``n`` shingles, in one order for all texts, two texts must look at to share one if they are similar."""
    return n + 1 + (-share[0] * n // share[1])


#: Set in the key of a common shingle, so that it comes after all others.
LATE = 1 << 62


def ordered_keys(hashed: bytes, common: np.ndarray) -> np.ndarray:
    """Distinct 62-bit keys of shingle hashes in the one order of all texts: ``common`` (sorted) ones last."""
    own = np.unique(np.frombuffer(hashed, np.uint64) >> np.uint64(2)).astype(np.int64)
    if not len(common):
        return own
    late = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
    return np.concatenate((own[~late], own[late] | LATE))


#: Names of the four longs of a sketch.
SKETCH = ["x0", "x1", "x2", "x3"]


def sketch(keys: np.ndarray) -> np.ndarray:
    """256 bits, as four longs: whether the number of keys with these eight last bits is odd. Sets differ in at least as many
    keys as their sketches in bits."""
    odd = np.bincount(keys & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _prints(batches, shingle, share, common):
    """The print of each text: a hash of its words, its SimHash, number of distinct shingles and of common ones, their sketch,
    and the first in the order."""
    from xxhash import xxh3_64_intdigest

    for b in batches:
        rows = []
        for t in b.column("text").to_pylist():
            norm, hashed = shingle_digests(t, shingle)
            keys = ordered_keys(hashed, common)
            rows.append((xxh3_64_intdigest(norm), majority(hashed), len(keys), int(np.count_nonzero(keys & LATE)), sketch(keys), keys[: prefix_length(len(keys), share)] if len(keys) else keys))
        node, fp, n, late, odd, first = zip(*rows) if rows else ((), (), (), (), (), ())
        odd = np.array(odd, np.int64).reshape(-1, len(SKETCH))
        yield pa.RecordBatch.from_arrays(
            [b.column("k0"), b.column("k1"), b.column("k2"), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)),
             pa.array(n, pa.int32()), pa.array(late, pa.int32()), *(pa.array(x) for x in odd.T.copy()),
             pa.array(first, pa.list_(pa.int64()))],
            names=["k0", "k1", "k2", "node", "fp", "n", "late", *SKETCH, "first"],
        )


def _common_shingles(texts: DataFrame, shingle: int, most: int = 100_000) -> np.ndarray:
    """Keys of shingles frequent in a sixteenth of the texts, ``most`` at most. Any set gives the same links; this one keeps
    lines and passages that many texts share from being joined on."""

    def run(batches):
        for b in batches:
            own = [ordered_keys(shingle_digests(t, shingle)[1], np.zeros(0, np.int64)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))], names=["s"])

    seen = texts.where("k2 & 15 = 0").select("text").mapInArrow(tidy(run), "s long").groupBy("s").agg(F.count("*").alias("c"))
    return np.sort(seen.where("c > 2").orderBy(F.desc("c"), "s").limit(most).select("s").toPandas()["s"].to_numpy(np.int64))


def _similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, share: tuple[int, int], tag: str) -> DataFrame:
    """Those of ``pairs(a, b)`` of ``nodes`` whose sets of shingles have a Jaccard similarity of ``share``. Only texts in
    pairs are shuffled, and each of them becomes its set once."""

    def sets(batches):
        for b in batches:
            own = [np.unique(np.frombuffer(shingle_digests(t, shingle)[1], np.int64)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(own, pa.binary())], names=["node", "set"])

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                both = np.concatenate((np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)))
                both.sort()
                n = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(share[1] * n >= share[0] * (len(both) - n))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    asked = materialize(asked.join(nodes.select("node", "low.*"), "node"), f"{tag}-asked")
    keys = ["k0", "k1", "k2"]
    bodies = BitFilter(asked, "k2").split(texts)[0].join(asked, keys).groupBy(*keys, "node").agg(F.first("text").alias("text"))
    bodies = materialize(bodies.select("node", "text").mapInArrow(tidy(sets), "node long, set binary"), f"{tag}-sets")
    sa, sb = (bodies.select(F.col("node").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")
    found = materialize(pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(tidy(run), "a long, b long"), tag)
    drop(bodies)
    return found


def _partners(pairs: DataFrame, least: str = "1") -> DataFrame:
    """Of ``pairs(a, b)`` with repeats: for each a the b that it is met with most often, ``least`` (of a's columns) times."""
    times = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.expr(least).alias("least")).where("c >= least")
    return times.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))


def _of_several_roots(rows: DataFrame) -> DataFrame:
    """Of ``rows(s, node, n, root, ...)`` those whose s several roots have, with its commonest root (main) and fewest n."""
    most = (
        rows.groupBy("s", "root").agg(F.count("*").alias("c"), F.min("n").alias("n"))
        .groupBy("s").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.min("n").alias("fewest"), F.count("*").alias("k"))
    )
    return rows.join(most.where("k > 1").select("s", "main", "fewest"), "s")


def _between_roots(shared: DataFrame, roots: DataFrame, nodes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs a, b of nodes of different roots that share some of their first shingles, and enough of them to be similar.

    The first shingle that two similar texts share has, in either of them, as many left from there on (itself included) as
    they must share: a row (node, shingle) that lies too late for that with any other row of its shingle is left out before
    the join. So the far ends of a group of near copies do not meet the whole group in the passage that all of them hold. All
    rows of a shingle are joined with those not of its commonest root, so rows of one root do not meet each other either. Pairs
    whose sketches differ too much are no pairs."""
    up, down = share
    rows = shared.join(roots, "node", "left").select("s", "node", "n", "at", F.coalesce("root", "node").alias("root"))
    rows = _of_several_roots(rows)
    order = Window.partitionBy("node").orderBy("at")
    # how many of a node's first shingles that other roots have too come up to this one, and after it
    upto = F.row_number().over(order)
    rows = rows.withColumn("upto", upto).withColumn("after", F.count("*").over(Window.partitionBy("node")) - F.col("upto"))
    least = F.greatest("fewest", F.ceil(up * F.col("n") / down))
    rows = rows.where((up + down) * (F.col("n") - F.col("at")) >= up * (F.col("n") + least)).drop("main", "fewest")
    more = nodes.where("n > 0").select("node", F.element_at("first", -1).alias("last"), *SKETCH)
    rows = materialize(_of_several_roots(rows.join(more, "node")), "between")
    names = ("node", "n", "last", "at", "upto", "after", "root", *SKETCH)
    p, q = (rows.select("s", "main", *(F.col(c).alias(f"{c}{k}") for c in names)) for k in "ab")
    both = F.col("na") + F.col("nb")
    left = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    # Of the text whose first shingles end earlier, m in all, each of these that the other has is met in both.
    m = F.when(F.col("lasta") < F.col("lastb"), F.col("na")).when(F.col("lasta") > F.col("lastb"), F.col("nb")).otherwise(F.least("na", "nb"))
    rest = F.floor((up * m + down - 1) / down) - 1
    after = F.least("aftera", "afterb")
    differ = sum((F.bit_count(F.col(f"{x}a").bitwiseXOR(F.col(f"{x}b"))) for x in SKETCH), F.lit(0))
    # b is of another root than the main one; if a is too, each pair is taken once
    pairs = (
        p.join(q.where("rootb <> main").drop("main"), "s").where("roota <> rootb and (roota = main or nodea < nodeb)")
        .where(f"{down} * na >= {up} * nb and {down} * nb >= {up} * na")
        .where((up + down) * left >= up * both).where((up + down) * (rest + F.least("uptoa", "uptob") + after) >= up * both)
        .where((up + down) * differ <= (down - up) * both)
        .select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b"), rest.alias("rest"), both.alias("all"), after.alias("after"))
        .groupBy("a", "b", "rest", "all").agg(F.count("*").alias("c"), F.min("after").alias("after"))
    )
    # The c shingles are the first that both have; what else both have lies after the last of them.
    return pairs.where(f"{up + down} * (rest + c + after) >= {up} * all").select("a", "b")


def keep_dissimilar(docs: DataFrame, shingle: int = 5, share: tuple[int, int] = (4, 5), radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, with one (smallest doc_id, then hash of the text) of each component of texts
    linked by a Jaccard similarity of ``share`` (a fraction) or more of their sets of ``shingle`` words.

    1. Texts of equal words are one node. Each node's nearest one by SimHash (links inside ``radius``, bit-sliced) and the
       most central one that shares a third of its first shingles are checked exactly; links that hold connect groups of
       near copies with two checks a node.
    2. SimHash distance proves nothing about the rest, so nodes that are not yet connected are joined on the first
       shingles of each (prefix filter): no similar pair shares none. Pairs that share too few of them to be similar
       are left out; the others are checked exactly.

    Texts in pairs and rows that may go are shuffled, chosen by bit filters (the result does not depend on
    them). Rows without an id stay only where their component has none; of repeated rows (id and text) one stays. Null
    text or no words: equal to each other. Very long texts: whole. Empty table: no rows. Extra columns may have any names
    but ``_k0``, ``_k1``, ``_k2``."""
    t = text_of(docs)
    keys = [docs["doc_id"].cast("long").isNull().alias("k0"), *row_key(t)]
    texts = docs.select(*keys, t.alias("text"))
    common = _common_shingles(texts, shingle)
    prints = materialize(
        texts.mapInArrow(tidy(lambda it: _prints(it, shingle, share, common)), "k0 boolean, k1 long, k2 long, node long, fp long, n int, late int, x0 long, x1 long, x2 long, x3 long, first array<long>"),
        "prints",
    )
    one = F.min(F.struct("k0", "k1", "k2"))
    nodes = materialize(
        prints.groupBy("node").agg(one.alias("low"), *(F.first(c).alias(c) for c in ("fp", "n", "late", *SKETCH, "first"))), "nodes"
    )

    entries = nodes.where("n > 0").select("node", F.posexplode("first").alias("at", "s"))
    often = entries.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    met = materialize(entries.join(often, "s"), "met")
    # how common a node's first shingles are, then how many of all its shingles are common: the original of many near
    # copies shares more with them than they do with each other
    weight = met.groupBy("node").agg(F.sum("f").alias("f")).join(nodes.select("node", "n", "late"), "node")
    weight = weight.select("node", "n", F.struct((F.col("f") / F.col("n")).alias("weight"), (F.col("late") / F.col("n")).alias("late"), "node").alias("weight"))
    shared = met.join(weight, "node")
    pivots = shared.groupBy("s").agg(F.max_by("node", "weight").alias("pivot"))
    shared = materialize(shared.join(pivots, "s").select("s", "node", "n", "at", "pivot"), "shared")

    heads = materialize(nodes.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    x, y = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"h{c}")) for c in "ab")
    near = _partners(link_fingerprints(heads.select("fp"), heads.count(), radius)).join(x, "a").join(y, "b").select("ha", "hb").toDF("a", "b")
    equal = nodes.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    third = f"(max(n) + 1 - (max(n) * {share[0]} + {share[1] - 1}) div {share[1]}) div 3"
    stars = _partners(shared.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"), "n"), third)
    links = _similar(materialize(near.union(equal).union(stars).distinct(), "near"), nodes, texts, shingle, share, "links")
    roots = components(links, "similar")

    pairs = materialize(_between_roots(shared, roots, nodes, share), "pairs")
    if pairs.limit(1).count():
        links = links.union(_similar(pairs, nodes, texts, shingle, share, "links"))
        roots = components(links, "similar")

    member = nodes.select("node", "low").join(roots, "node", "left").select("low", F.coalesce("root", "node").alias("root"))
    kept = member.groupBy("root").agg(F.min("low").alias("low")).select("low.*")
    # a key of a row that goes, or of several rows of which one stays
    counts = prints.groupBy("k0", "k1", "k2").agg(F.count("*").alias("rows")).join(kept.withColumn("stays", F.lit(True)), ["k0", "k1", "k2"], "left")
    names = ["_k0", "_k1", "_k2"]
    gone = materialize(counts.where("stays is null or rows > 1").select("k0", "k1", "k2", "stays").toDF(*names, "_stays"), "gone")
    maybe, sure = BitFilter(gone, "_k2").split(docs.select("*", *(k.alias(n) for k, n in zip(keys, names))))
    checked = maybe.join(gone.where("_stays is null"), names, "left_anti")
    if gone.where("_stays").limit(1).count():
        checked = checked.dropDuplicates(names)
    return sure.unionByName(checked).drop(*names)
