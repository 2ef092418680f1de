"""Ingest: the same functions serve batch frames and streams where the semantics allow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup(df: DataFrame, key: str, order: str) -> DataFrame:
    """Batch: the first row of each key."""
    first = df.groupBy(key).agg(F.min(F.struct(order, *[c for c in df.columns if c not in (key, order)])).alias("x"))
    return first.select(key, "x.*")


def dedup_stream(df: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Stream: state of a key is dropped when the watermark passes."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sessions(df: DataFrame, key: str, time: str, gap: str = "30 minutes") -> DataFrame:
    """Debounced batches: a key's events with pauses under ``gap``. Batch or stream (with a watermark)."""
    return df.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n_events")).select(
        key, F.col("w.start").alias("started"), "n_events"
    )


def count_windows(df: DataFrame, key: str, order: list[str], is_user, size: int) -> DataFrame:
    """Numbers the part of a conversation that each row is flushed with: a part ends at ``size`` user turns."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(is_user.cast("long")).over(w), F.lit(0))
    return df.withColumn("part", F.floor(before / size).cast("long"))


def positions(df: DataFrame, time: str) -> DataFrame:
    """Queue position: rows at or before each row's time. Times are counted, put in range partitions and summed in each; only
    one total for each partition meets in one place."""
    times = df.groupBy(time).agg(F.count("*").alias("_c")).repartitionByRange(time)
    times = times.withColumn("_p", F.spark_partition_id()).checkpoint()
    totals = times.groupBy("_p").agg(F.sum("_c").alias("_t"))
    before = totals.select("_p", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = F.sum("_c").over(Window.partitionBy("_p").orderBy(time))
    at = times.withColumn("_in", inside).join(F.broadcast(before), "_p").select(time, (F.col("_b") + F.col("_in")).alias("position"))
    return df.join(at, time)


def health(df: DataFrame, key: str, time: str, now: str, interval_s: int) -> DataFrame:
    """Heartbeats missed since the last one: 3 dead, 1 suspect."""
    last = df.groupBy(key).agg(F.max(time).alias("last"))
    missed = F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))) / interval_s)
    return last.select(key, missed.cast("long").alias("missed"), F.when(missed >= 3, "dead").when(missed >= 1, "suspect").otherwise("healthy").alias("health"))


def upsert(table: DataFrame, arrivals: DataFrame, keys: list[str], digest: str, order: str) -> DataFrame:
    """The table after arrivals: the newest row of each key, ``processed`` false again where its content changed; content
    that the table holds under any key adds nothing. Both have the same columns, ``processed`` among them."""
    fresh = arrivals.join(table.select(digest).distinct(), digest, "left_anti").select(*table.columns)
    rest = [c for c in table.columns if c not in keys]
    both = table.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)).withColumn("processed", F.lit(False)))
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", order, digest)).alias("x"))
    return newest.select(*keys, "x.*").select(*table.columns)


def debounce(df: DataFrame, by: str, quiet_s: float = 60, longest_s: float = 1800) -> DataFrame:
    """Stream: ``by``, n_events, why (quiet or delay) whenever a key's pending arrivals are due, by processing time.

    State of a key is its count and the times of its first and last arrival; it goes when the build is due. Needs the
    RocksDB state store."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    quiet, longest = int(quiet_s * 1000), int(longest_s * 1000)

    class Debouncer(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.pending = handle.getValueState("pending", "n long, first long, due long")

        def handleInputRows(self, key, rows, timerValues):
            now = timerValues.getCurrentProcessingTimeInMs()
            n = sum(len(r) for r in rows)
            had = self.pending.get() if self.pending.exists() else None
            first = had[1] if had else now
            due = min(now + quiet, first + longest)
            if had and had[2] != due:
                self.handle.deleteTimer(had[2])
            self.pending.update(((had[0] if had else 0) + n, first, due))
            self.handle.registerTimer(due)
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.pending.exists():
                n, first, due = self.pending.get()
                self.pending.clear()
                yield pd.DataFrame({by: [key[0]], "n_events": [n], "why": ["delay" if due - first >= longest else "quiet"]})

        def close(self):
            pass

    kind = df.schema[by].dataType.simpleString()
    return df.groupBy(by).transformWithStateInPandas(
        Debouncer(), outputStructType=f"`{by}` {kind}, n_events long, why string", outputMode="append", timeMode="ProcessingTime"
    )


def due(now, first, last, built, quiet_s: float = 60, longest_s: float = 1800, interval_s: float = 0):
    """Batch form of the rule on second columns: whether pending arrivals are to be built now."""
    return (F.coalesce(now - built, F.lit(float(interval_s))) >= interval_s) & ((now - last >= quiet_s) | (now - first >= longest_s))


def count_windows_stream(df: DataFrame, by: str, is_user: str, size: int = 4, idle_s: float = 120) -> DataFrame:
    """Stream: ``by``, part, n_rows, n_turns, why (turns or idle) of each flushed part of a session. A part is flushed when it
    has ``size`` rows with ``is_user`` (a boolean column), or after ``idle_s`` seconds without a row, by processing time; its rows are
    those since the last flush. State of a key is four numbers. Needs the RocksDB state store."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    idle = int(idle_s * 1000)

    class Counter(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.open = handle.getValueState("open", "part long, n long, turns long, due long")

        def flushed(self, key, part, n, turns, why):
            return pd.DataFrame({by: [key[0]], "part": [part], "n_rows": [n], "n_turns": [turns], "why": [why]})

        def handleInputRows(self, key, rows, timerValues):
            part, n, turns, due = self.open.get() if self.open.exists() else (0, 0, 0, 0)
            if due:
                self.handle.deleteTimer(due)
            for pdf in rows:
                for user in pdf[is_user]:
                    n, turns = n + 1, turns + bool(user)
                    if turns >= size:
                        yield self.flushed(key, part, n, turns, "turns")
                        part, n, turns = part + 1, 0, 0
            due = timerValues.getCurrentProcessingTimeInMs() + idle if n else 0
            if due:
                self.handle.registerTimer(due)
            self.open.update((part, n, turns, due))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            part, n, turns, _ = self.open.get()
            if n:
                yield self.flushed(key, part, n, turns, "idle")
                self.open.update((part + 1, 0, 0, 0))

        def close(self):
            pass

    kind = df.schema[by].dataType.simpleString()
    return df.groupBy(by).transformWithStateInPandas(
        Counter(), outputStructType=f"`{by}` {kind}, part long, n_rows long, n_turns long, why string", outputMode="append", timeMode="ProcessingTime"
    )


def _opened(seconds: DataFrame, window_s: int) -> DataFrame:
    """s, batch of distinct ``seconds(s)``: the arrival that opened the window which each is claimed in.

    Arrivals lie in range partitions. Each one's successor is the first a window later; it is in the partition or among the
    first ``window_s`` seconds of the ones after it, which alone are collected. An arrival with a pause of a window before it
    always opens a batch; the others that do are found from these by jumping twice as many batches each round. The
    last opening is carried over partitions."""
    place = seconds.repartitionByRange("s").sortWithinPartitions("s").select("s", F.spark_partition_id().alias("p")).checkpoint()
    ends = place.groupBy("p").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    first = place.join(F.broadcast(ends), "p").where(F.col("s") <= F.col("lo") + window_s).select("p", "s")
    next_ = place.join(F.broadcast(ends), "p").where(F.col("s") > F.col("lo") + window_s).groupBy("p").agg(F.min("s").alias("s"))
    heads = np.array(sorted(r.s for r in first.unionByName(next_).collect()), np.int64)  # window_s + 2 a partition at most
    bounds = {r.p: (r.lo, r.hi) for r in ends.collect()}

    def sorted_part(batches):
        parts = [(b.column("s").to_numpy(), b.column("p")[0].as_py()) for b in batches if b.num_rows]
        return (np.sort(np.concatenate([x for x, _ in parts])), parts[0][1]) if parts else (np.zeros(0, np.int64), 0)

    def link(batches):
        s, p = sorted_part(batches)
        if not len(s):
            return
        all_ = np.unique(np.concatenate([s, heads[heads > s[-1]]]))
        at = np.searchsorted(all_, s + window_s)
        before = max((hi for q, (_, hi) in bounds.items() if q < p), default=None)
        gap = np.diff(s, prepend=before if before is not None else s[0] - window_s)
        nxt = pa.array(all_[np.minimum(at, len(all_) - 1)], mask=at >= len(all_))
        yield pa.RecordBatch.from_arrays([pa.array(s), nxt, pa.array(gap >= window_s)], names=["s", "nxt", "opens"])

    links = place.mapInArrow(link, "s long, nxt long, opens boolean").checkpoint()
    opened = links.where("opens").select("s").checkpoint()
    jump = links.where("nxt is not null").select("s", "nxt")
    while True:
        new = opened.join(jump, "s").select(F.col("nxt").alias("s")).distinct().join(opened, "s", "left_anti").checkpoint()
        if not new.limit(1).count():
            break
        opened = opened.unionByName(new).checkpoint()
        jump = jump.join(jump.select(F.col("s").alias("nxt"), F.col("nxt").alias("n2")), "nxt").select("s", F.col("n2").alias("nxt")).checkpoint()
    marked = place.join(opened.withColumn("o", F.lit(True)), "s", "left").select("s", "p", "o").checkpoint()
    latest = sorted((r.p, r.s) for r in marked.where("o").groupBy("p").agg(F.max("s").alias("s")).collect())  # one row a partition

    def carry(batches):
        for b in batches:
            s, p, o = b.column("s").to_numpy(), b.column("p")[0].as_py() if b.num_rows else 0, b.column("o").fill_null(False).to_numpy(zero_copy_only=False)
            if not len(s):
                continue
            own = np.sort(np.concatenate([s[o], [x for q, x in latest if q < p][-1:]])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(own[np.searchsorted(own, s, "right") - 1])], names=["s", "batch"])

    return marked.repartition("p").sortWithinPartitions("p", "s").mapInArrow(lambda it: _by_part(it, carry), "s long, batch long")


def _by_part(batches, run):
    """``run`` over each run of rows of one ``p``, put together."""
    held = []
    for b in batches:
        p = b.column("p").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
        for x, y in zip(edges, edges[1:]):
            if held and held[-1].column("p")[0] != b.column("p")[x]:
                yield from run([pa.Table.from_batches(held).combine_chunks().to_batches()[0]])
                held = []
            if y > x:
                held.append(b.slice(x, y - x))
    if held:
        yield from run([pa.Table.from_batches(held).combine_chunks().to_batches()[0]])


def claim_batches(df: DataFrame, time: str, window_s: int = 30) -> DataFrame:
    """Rows with ``batch``: the first pending row opens a window of ``window_s`` seconds and all that arrive in it are claimed
    together; the next one after it opens another. Rows without a time are in none."""
    d = df.withColumn("_t", F.unix_seconds(F.col(time).cast("timestamp")))
    opened = _opened(d.where("_t is not null").select(F.col("_t").alias("s")).distinct(), window_s)
    return d.join(opened, F.col("_t") == F.col("s")).select(*df.columns, F.timestamp_seconds("batch").alias("batch"))


def claim_batches_stream(df: DataFrame, build, window_s: int = 30):
    """Stream writer: all that arrived since the last trigger is one batch for ``build(rows, batch id)``; a batch that is run again
    after a failure has the id it had, so ``build`` can be made idempotent by it."""
    return df.writeStream.trigger(processingTime=f"{window_s} seconds").foreachBatch(build)


# Which event takes a queue row from which state to which.
MOVES = (("claim", "pending", "processing"), ("built", "processing", "built"), ("released", "built", "released"), ("failed", "processing", "failed"), ("requeue", "failed", "pending"))


def queue_states(events: DataFrame, key: str, order: str) -> DataFrame:
    """``key``, status, n_refused after all ``events(key, order, event)`` in order: rows begin pending; an event that the state does not
    allow (a second claim, a release of what is not built) changes nothing and is counted. Events of one row are few."""
    table = {f"{name}|{a}": b for name, a, b in MOVES}
    steps = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    start = F.struct(F.lit("pending").alias("status"), F.lit(0).cast("long").alias("n_refused"))

    def step(acc, x):
        to = F.try_element_at(steps, F.concat_ws("|", x["event"], acc["status"]))
        return F.struct(F.coalesce(to, acc["status"]).alias("status"), (acc["n_refused"] + F.when(to.isNull(), 1).otherwise(0)).alias("n_refused"))

    rows = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "event"))).alias("x"))
    return rows.select(key, F.aggregate("x", start, step).alias("r")).select(key, "r.status", "r.n_refused")
