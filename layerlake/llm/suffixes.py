"""Removal of long repeated strings, of bytes or of words, with suffix arrays of candidate regions."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, materialize, row_key, text_of, tidy

CHUNK = 1 << 17  # windows handled at a time; a run of windows never crosses a chunk
HOT_WINDOWS = 400_000  # windows of distinct regions that one task sorts together at most

BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
LOW = np.uint64((1 << 20) - 1)
SALT = 0x632BE59BD9B4E019


def word_bytes(raw: bytes) -> bytes:
    """The 4-byte hashes of the words of a text, end to end."""
    from xxhash import xxh32_digest

    return b"".join([xxh32_digest(w) for w in raw.split()])


@dataclass(frozen=True)
class Rule:
    """Which repeated strings are looked for: ``window`` units (bytes, or with ``words`` the hashes of words) and longer.
    ``gram`` units are hashed together; each window keeps the smallest of these hashes."""

    window: int
    gram: int
    words: bool = False

    @property
    def size(self) -> int:
        """Bytes of a unit."""
        return 4 if self.words else 1

    def units(self, raw: bytes) -> bytes:
        return word_bytes(raw) if self.words else raw

    def numbers(self, units: bytes) -> np.ndarray:
        """The units as numbers in the order of their bytes."""
        return np.frombuffer(units, ">u4" if self.words else np.uint8)


BYTES, PASSAGES = Rule(400, 50), Rule(51, 7, True)


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A mixed polynomial hash of each ``k`` successive bytes, built by doubling."""
    with np.errstate(over="ignore"):
        part, size, base = raw.astype(np.uint64) + np.uint64(1), 1, BASE
        out, done = None, 0
        while True:
            if k & 1:
                if out is None:
                    out, done = part, size
                else:
                    n = len(part) - done
                    out = out[:n] * base + part[done : done + n]
                    done += size
            k >>= 1
            if not k:
                break
            part = part[:-size] * base + part[size:]
            size, base = 2 * size, base * base
        out = (out ^ (out >> np.uint64(29))) * MIX
        return out ^ (out >> np.uint64(32))


def window_runs(raw: bytes, window: int, gram: int):
    """Cuts the windows of one text (or array of words) into runs whose smallest gram hash lies at one place.

    Equal windows, wherever they are, have equal smallest hashes at the same place inside (the first, among
    equal hashes). Returns for each run the hash, first window, number of windows, and the place of the gram."""
    keys, firsts, sizes, grams = [], [], [], []
    whole = raw if isinstance(raw, np.ndarray) else np.frombuffer(raw, np.uint8)
    for at in range(0, max(0, len(raw) - window + 1), CHUNK):
        h = gram_hashes(whole[at : at + CHUNK + window - 1], gram)
        packed = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
        m, size, width = packed, 1, window - gram + 1
        while 2 * size <= width:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < width:
            m = np.minimum(m[: len(m) - width + size], m[width - size :])
        first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
        keys.append((m[first] >> np.uint64(20)).astype(np.int64))
        firsts.append(first + at)
        sizes.append(np.diff(np.r_[first, len(m)]))
        grams.append((m[first] & LOW).astype(np.int64) + at)
    if not keys:
        return (np.zeros(0, np.int64),) * 4
    return tuple(map(np.concatenate, (keys, firsts, sizes, grams)))


def larger_than_next(a: np.ndarray) -> np.ndarray:
    """Whether each suffix of ``a`` is larger than the one after it; the last one is."""
    n = len(a)
    if not n:
        return np.zeros(0, bool)
    differs = np.where(a[:-1] != a[1:], np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(np.r_[differs, n - 1][::-1])[::-1]
    return np.where(at < n - 1, a[at] > a[np.minimum(at + 1, n - 1)], True)


def two_stage_suffixes(regions: list[tuple[bytes, int]], rule: Rule) -> np.ndarray:
    """Sorted suffixes (rows region, place) of the first places of some regions (units, number of places), to
    ``rule.window`` units at least.

    Stage one sorts directly only suffixes that are smaller than their successors. Stage two
    scans the buckets (by first unit) once from the smallest: each suffix met places its
    predecessor, if that is the larger one, at the next free place of its bucket. Places after a region's first
    ones are taken along only up to the next directly sorted one."""
    units, larger, ends, last = [], [], [], []
    for s, n in regions:
        a = rule.numbers(s)
        kind = larger_than_next(a)
        smaller = np.flatnonzero(~kind[n:])
        end = min(n + int(smaller[0]) + 1, len(a)) if len(smaller) else len(a)
        units.append(a[:end])
        larger.append(kind[:end])
        ends.append(end)
        last.append(end == len(a) and kind[end - 1])
    begin = np.cumsum([0, *ends])
    region = np.repeat(np.arange(len(ends)), ends)
    place = np.arange(begin[-1]) - begin[region]
    kind, symbol = np.concatenate(larger), np.concatenate(units)
    bucket = np.unique(symbol, return_inverse=True)[1] if rule.words else symbol.astype(np.int64)
    induced, sizes = np.bincount(bucket[kind], minlength=bucket.max() + 1), np.bincount(bucket)
    head = np.cumsum(sizes) - sizes
    order = np.full(begin[-1], -1, np.int64)
    direct = np.flatnonzero(~kind)
    if len(direct):
        pad = bytes(rule.window * rule.size)  # so that every suffix has a whole window
        at = np.cumsum([0, *(len(s) // rule.size + rule.window for s, _ in regions)])[region[direct]] + place[direct]
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join([s + pad for s, _ in regions]), np.uint8), rule.window * rule.size)
        keys = np.ascontiguousarray(windows[at * rule.size]).view(f"S{rule.window * rule.size}")[:, 0]
        direct = direct[np.argsort(keys, kind="stable")]
        own = bucket[direct]
        nth = np.arange(len(own)) - np.searchsorted(own, own)
        order[head[own] + induced[own] + nth] = direct
    free, bucket, order = head.tolist(), bucket.tolist(), order.tolist()
    before = (np.r_[False, kind[:-1]] & (place > 0)).tolist()  # whether a suffix has a larger predecessor
    for r in np.flatnonzero(last).tolist():  # the empty suffix at a region's end comes before all
        t = int(begin[r + 1]) - 1
        order[free[bucket[t]]] = t
        free[bucket[t]] += 1
    for t in order:
        if before[t]:
            c = bucket[t - 1]
            order[free[c]] = t - 1
            free[c] += 1
    order = np.array(order, np.int64)
    region, place = region[order], place[order]
    wanted = place < np.array([n for _, n in regions])[region]
    return np.column_stack((region[wanted], place[wanted]))


def adjacent_prefixes(regions: list[tuple[bytes, int]], order: np.ndarray, rule: Rule) -> np.ndarray:
    """Common prefixes, in units and up to ``rule.window``, of each sorted suffix and the one before it (the first: 0)."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    begin = np.cumsum([0, *(len(s) // rule.size for s, _ in regions)])
    at = begin[order[:, 0]] + order[:, 1]
    windows = np.lib.stride_tricks.sliding_window_view(rule.numbers(b"".join([s for s, _ in regions])), rule.window)
    for i in range(1, len(at), 4096):
        rows = windows[at[i - 1 : i + 4096]]
        differ = rows[1:] != rows[:-1]
        first = differ.argmax(axis=1)
        out[i : i + 4096] = np.where(differ[np.arange(len(first)), first], first, rule.window)
    return out


def repeated_places(regions: list[tuple[bytes, int, int]], rule: Rule) -> list[np.ndarray]:
    """For regions (units, number of windows, number of occurrences of the region): which of their windows start
    elsewhere too. Neighbours in the suffix array with a common prefix of a window form a set; its windows
    are repeated if the set has two occurrences or more."""
    texts = [(raw, n) for raw, n, _ in regions]
    order = two_stage_suffixes(texts, rule)
    begin = np.cumsum([0, *(n for _, n in texts)])
    flags = np.zeros(begin[-1], bool)
    if len(order):
        sets = np.cumsum(adjacent_prefixes(texts, order, rule) < rule.window)
        weight = np.array([w for *_, w in regions], np.int64)[order[:, 0]]
        again = np.bincount(sets, weight)[sets] > 1
        flags[(begin[order[:, 0]] + order[:, 1])[again]] = True
    return [flags[x:y] for x, y in zip(begin, begin[1:])]


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


SPANS = "array<struct<a:int,b:int>>"
SPAN_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _runs(batches, rules):
    """The runs of each text under each rule ``r``; ``c``: hash of all units of the run."""
    from xxhash import xxh3_64_intdigest

    names, kinds = ["h", "c", "k1", "k2", "r", "p", "n", "g"], [pa.int64()] * 4 + [pa.int32()] * 4
    for b in batches:
        cols = [[] for _ in names]
        for k1, k2, t in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "text"))):
            raw = t.encode("utf-8", "surrogatepass")
            for i, rule in enumerate(rules):
                units = rule.units(raw)
                h, p, n, g = window_runs(rule.numbers(units), rule.window, rule.gram)
                m = len(h)
                if m:
                    h = h ^ (i * SALT & (1 << 63) - 1)
                    view, size, more = memoryview(units), rule.size, rule.window - 1
                    c = [xxh3_64_intdigest(view[size * x : size * (x + y + more)]) for x, y in zip(p.tolist(), n.tolist())]
                    for col, v in zip(cols, (h, np.array(c, np.uint64).view(np.int64), np.full(m, k1), np.full(m, k2), np.full(m, i), p, n, g)):
                        col.append(v)
        data = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
        yield pa.RecordBatch.from_arrays([pa.array(d.astype(k.to_pandas_dtype()), k) for d, k in zip(data, kinds)], names=names)


REGION_TYPES = {"h": pa.int64(), "c": pa.int64(), "weight": pa.int64(), "r": pa.int32(), "n": pa.int32(), "g": pa.int32(), "units": pa.binary()}
REGION = "h long, c long, weight long, r int, n int, g int, units binary"
#: Widths in windows that the regions of a too frequent hash are cut to, one after the other.
WIDTHS = (64, 16, 4, 1)


def _record(rows: list[tuple], types: dict) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types.values())], names=list(types))


def _cut_regions(batches, rules):
    """The wanted regions of each text with their units; ``g``: place of the smallest gram in the region."""
    for b in batches:
        rows = []
        for t, want in zip(b.column("text").to_pylist(), b.column("want").to_pylist()):
            raw = t.encode("utf-8", "surrogatepass")
            units = {i: rules[i].units(raw) for i in {w["r"] for w in want}}
            for w in want:
                size, p = rules[w["r"]].size, w["p"]
                piece = units[w["r"]][size * p : size * (p + w["n"] + rules[w["r"]].window - 1)]
                rows.append((w["h"], w["c"], w["weight"], w["r"], w["n"], w["g"] - p, piece))
        yield _record(rows, REGION_TYPES)


def _narrow(batches, rules, width):
    """Cuts regions to pieces of up to ``width`` windows, at places counted from the smallest gram, so that equal
    windows fall in pieces alike. A piece's new hash is that of the units all its possible windows share."""
    from xxhash import xxh3_64_intdigest

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    types = {"h0": pa.int64(), "c0": pa.int64(), "at": pa.int32(), **REGION_TYPES}
    for b in batches:
        rows = []
        for h, c, w, r, n, g, units in zip(*(b.column(x).to_pylist() for x in REGION_TYPES)):
            size, window = rules[r].size, rules[r].window
            for j in range((g - n + 1) // width, g // width + 1):
                # windows p with g - p in [j * width, (j + 1) * width)
                first, last = max(0, g - (j + 1) * width + 1), min(n - 1, g - j * width)
                if first > last:
                    continue
                core = units[size * (g - j * width) : size * max(0, g - (j + 1) * width + 1 + window)]
                piece = units[size * first : size * (last + window)]
                key = signed(xxh3_64_intdigest(b"%d %d " % (h, j) + core))
                rows.append((h, c, first, key, signed(xxh3_64_intdigest(piece)), w, r, last - first + 1, g - first, piece))
        yield _record(rows, types)


def _repeated(regions: DataFrame, rules: tuple, hot_windows: int, level: int = 0) -> DataFrame:
    """h, c, places (spans of repeated windows) of distinct ``regions``. Hashes with at most ``hot_windows``
    windows are sorted in one task each; regions of others are narrowed, merged where equal, and sorted again
    by the hashes of their pieces."""
    sizes = regions.groupBy("h").agg(F.sum("n").alias("windows")).where(F.col("windows") > hot_windows)
    hot = None
    if level < len(WIDTHS):
        sizes = materialize(sizes.select("h"), "hot")
        if sizes.limit(1).count():
            hot = regions.join(sizes, "h", "left_semi")
            regions = regions.join(sizes, "h", "left_anti")
    places = (
        regions.select("h", "c", "weight", "r", "n", "units").repartition("h").sortWithinPartitions("h", "c")
        .mapInArrow(tidy(lambda it: _sort_groups(it, rules)), f"h long, c long, places {SPANS}")
    )
    if hot is None:
        return places
    width = WIDTHS[level]
    pieces = materialize(
        hot.select(*REGION_TYPES).mapInArrow(lambda it: _narrow(it, rules, width), f"h0 long, c0 long, at int, {REGION}"), "pieces"
    )
    merged = pieces.groupBy("h", "c").agg(
        F.sum("weight").alias("weight"), *(F.first(x).alias(x) for x in ("r", "n", "g", "units"))
    )
    often = pieces.groupBy("h").agg(F.sum("weight").alias("seen")).where("seen > 1").select("h")
    merged = materialize(merged.join(often, "h", "left_semi"), "pieces")
    found = _repeated(merged, rules, hot_windows, level + 1)
    back = (
        pieces.select("h0", "c0", "at", "h", "c").join(found, ["h", "c"])
        .groupBy(F.col("h0").alias("h"), F.col("c0").alias("c"))
        .agg(F.flatten(F.collect_list(F.expr("transform(places, x -> struct(x.a + at AS a, x.b + at AS b))"))).alias("places"))
    )
    return places.unionByName(back)


def _sort_groups(batches, rules):
    """Repeated windows (as spans of places) of each region; rows come sorted by (h, c)."""

    def finish(h, group):
        flags = repeated_places([(units, n, w) for _, n, w, units, _ in group], rules[group[0][-1]])
        return [(h, g[0], s) for g, f in zip(group, flags) if (s := spans_of(f))]

    def batch(rows):
        h, c, s = zip(*rows) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array([[{"a": a, "b": b} for a, b in x] for x in s], SPAN_TYPE)],
            names=["h", "c", "places"],
        )

    key, group, out = None, [], []
    for b in batches:
        for h, c, w, n, units, r in zip(*(b.column(x).to_pylist() for x in ("h", "c", "weight", "n", "units", "r"))):
            if h != key:
                if group:
                    out += finish(key, group)
                key, group = h, []
                if len(out) > 2000:
                    yield batch(out)
                    out = []
            if not group or group[-1][0] != c:  # a repeated row brings its regions twice
                group.append((c, n, w, units, r))
    if group:
        out += finish(key, group)
    yield batch(out)


def merged_spans(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _of_rule(spans, i: int, rule: Rule, raw: bytes) -> list[tuple[int, int]]:
    """Merged spans, in bytes of ``raw``, of the found strings of the rule of number ``i``."""
    found = merged_spans((x["a"], x["b"]) for x in spans or () if x["r"] == i)
    if not found or not rule.words:
        return found
    ends = [m.span() for m in re.finditer(rb"\S+", raw)]
    return [(ends[a][0], ends[b - 1][1]) for a, b in found]


OUT = {"doc_id": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "spans": SPANS, "n_noted": "long", "kept": "binary"}


def remove_repeats(
    docs: DataFrame, rule: Rule = BYTES, note: Rule | None = None, hot_windows: int = HOT_WINDOWS, carry: tuple = ()
) -> DataFrame:
    """Removes everything of ``docs(doc_id, text)`` that is covered by a string of ``rule.window`` units that also starts
    elsewhere: of 400 bytes, or of words whatever stands between them (then what stands between them goes too).

    1. Each text's windows are cut into runs of one smallest gram hash where the text lies; only hashes and
       places leave it. Equal windows are in runs of equal hash. Runs whose units are equal count as one
       region with a number of occurrences, so groups of copies shrink before any shuffle of texts.
    2. Regions whose hash occurs once are dropped. Of hashes with several regions one copy of each region is cut from its
       text and dealt by hash; each task sorts the suffixes of a hash's regions in two stages, computes the
       common prefixes of neighbours and joins neighbours that share a window. Regions of a hash with over
       ``hot_windows`` windows are narrowed first (see ``_repeated``), so a very common line or passage does not
       meet in one task.
    3. Repeated windows go back to all occurrences of their region and are joined with the texts.

    Only texts with regions to sort, and then those with something to cut, are shuffled (chosen by bit filters of a fixed
    size; the result does not depend on them). Strings are judged on the input. Words are told apart by 32-bit hashes: a wrong
    find needs two passages that are equal but for words whose hashes collide. Returns doc_id, n_bytes, n_removed, n_spans, spans (bytes), n_noted, kept (binary; a cut may fall
    inside a character). With ``carry``, those columns of ``docs`` follow (under ``_0``, ``_1``, ... , whatever their
    names), and ``kept`` is a string without characters that a cut has broken. With ``note``, strings of a second rule are
    found in the same pass: ``n_noted`` is their number of bytes; they are not removed.

    Null text: empty. Null doc_id: a row as any other. Repeated rows are elsewhere to each other, so all
    their windows go. Texts of under a window are kept whole; very long ones are taken in chunks of 131,072 windows.
    Empty table: no rows. Other columns are ignored, and may have any names."""
    rules = (rule, note) if note else (rule,)
    t = text_of(docs)
    own = [docs[c].alias(f"_{i}") for i, c in enumerate(carry)]
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *row_key(t), t.alias("text"), *own)
    least = min(r.window if not r.words else 2 * r.window - 1 for r in rules)
    runs = materialize(
        texts.where(F.octet_length("text") >= least).select("k1", "k2", "text").mapInArrow(
            tidy(lambda it: _runs(it, rules)), "h long, c long, k1 long, k2 long, r int, p int, n int, g int"
        ),
        "runs",
    )
    # runs whose hash occurs again, and some others that the bit filter lets through
    keyed = runs.withColumn("x", F.xxhash64("h"))
    often = materialize(runs.groupBy("h").agg(F.count("*").alias("seen")).where("seen > 1").select(F.xxhash64("h").alias("x")), "often")
    again = BitFilter(often, "x").split(keyed)[0].drop("x")
    regions = materialize(
        again.groupBy("h", "c").agg(F.count("*").alias("weight"), F.min(F.struct("k1", "k2", "r", "p", "n", "g")).alias("one")), "regions-of-runs"
    )
    seen = regions.groupBy("h").agg(F.sum("weight").alias("seen"), F.count("*").alias("kinds")).where("seen > 1")
    regions = materialize(regions.join(seen, "h").select("h", "c", "weight", "kinds", "one.*"), "repeated")
    lists = materialize(
        regions.where("kinds > 1").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "c", "weight", "r", "p", "n", "g")).alias("want")), "lists"
    )
    wanted, _ = BitFilter(lists, "k2").split(texts.select("k1", "k2", "text"))
    cut = wanted.join(lists, ["k1", "k2"]).select("text", "want").mapInArrow(tidy(lambda it: _cut_regions(it, rules)), REGION)
    # repeated rows bring their regions twice; the sort takes one of each
    places = _repeated(materialize(cut, "regions"), rules, hot_windows)
    # a region that is the only one of its hash has nothing to be sorted against, and all of it is seen again
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").cast("int").alias("b")))
    places = places.unionByName(regions.where("kinds = 1").select("h", "c", whole.alias("places")))
    more = F.element_at(F.array(*(F.lit(r.window - 1) for r in rules)), F.col("r") + 1)
    spans = (
        again.select("h", "c", "k1", "k2", "r", "p").join(places, ["h", "c"])
        .withColumn("more", more)
        .select("k1", "k2", F.explode(F.expr("transform(places, x -> struct(r, x.a + p AS a, x.b + p + more AS b))")).alias("s"))
        .groupBy("k1", "k2").agg(F.collect_set("s").alias("spans"))
    )
    spans = materialize(spans, "spans")
    kinds = [pa.int64()] * 4 + [SPAN_TYPE, pa.int64(), pa.string() if carry else pa.binary()]

    def strip(batches):
        for b in batches:
            rows = []
            for d, t, s in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                raw = t.encode("utf-8", "surrogatepass")
                gone = _of_rule(s, 0, rule, raw)
                noted = sum(y - x for x, y in _of_rule(s, 1, note, raw)) if note else 0
                edges = [0, *(x for span in gone for x in span), len(raw)]
                kept = b"".join([raw[x:y] for x, y in zip(edges[::2], edges[1::2])])
                rows.append((
                    d, len(raw), len(raw) - len(kept), len(gone), [{"a": x, "b": y} for x, y in gone], noted,
                    kept.decode("utf-8", "ignore") if carry else kept,
                ))
            cols = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(cols, kinds)), *(b.column(f"_{i}") for i in range(len(carry)))],
                names=[*OUT, *(f"_{i}" for i in range(len(carry)))],
            )

    schema = ", ".join(f"{c} {'string' if carry and c == 'kept' else k}" for c, k in OUT.items())
    schema += "".join(f", _{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    names = ["doc_id", "text", "spans", *(f"_{i}" for i in range(len(carry)))]
    maybe, sure = BitFilter(spans, "k2").split(texts)
    out = maybe.join(spans, ["k1", "k2"], "left").select(*names).unionByName(sure.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)).select(*names))
    return out.mapInArrow(tidy(strip), schema)
