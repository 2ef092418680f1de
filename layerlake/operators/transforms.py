"""Row-cardinality operators: map 1:1, chunk 1:N, group N:M, fold N:1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, slug


def chunk_fixed(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``; empty text gives one empty chunk."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    cut = F.transform(starts, lambda i: F.substring(F.col(text), i + 1, F.lit(size)))
    return df.withColumn("_chunks", cut).select(
        *df.columns, F.size("_chunks").cast("long").alias("chunk_total"), F.posexplode("_chunks").alias("chunk_index", "chunk")
    )


def chunk_separator(df: DataFrame, text: str, separator: str) -> DataFrame:
    """Literal separator; blank segments go, none left gives one empty chunk; segments are not trimmed."""
    parts = F.filter(F.split(F.col(text), r"\Q" + separator + r"\E", -1), lambda x: ~is_blank(x))
    parts = F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(parts)
    return df.select(*df.columns, F.posexplode(parts).alias("chunk_index", "chunk"))


def chunk_by(df: DataFrame, text: str, split) -> DataFrame:
    """Chunks of a caller's own ``split`` (a column of texts to a column of arrays of texts); no chunk gives one empty one."""
    parts = split(F.col(text))
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("")))
    return df.withColumn("_chunks", parts).select(
        *df.columns, F.size("_chunks").cast("long").alias("chunk_total"), F.posexplode("_chunks").alias("chunk_index", "chunk")
    )


def chunk_labels(chunks: DataFrame, name: str, source: str) -> DataFrame:
    """``name-source-hash8``; repeats inside a source get -1, -2, ..."""
    digest = F.substring(F.sha2("chunk", 256), 1, 8)
    w = Window.partitionBy(source, digest).orderBy("chunk_index")
    nth = F.row_number().over(w) - 1
    base = F.concat_ws("-", F.lit(name), F.col(source).cast("string"), digest)
    return chunks.withColumn("label", F.when(nth > 0, F.concat_ws("-", base, nth.cast("string"))).otherwise(base))


def group_body(df: DataFrame, key, label: str, content: str, order: str) -> DataFrame:
    """Synthesis groups: sections ``### label`` joined in ``order``; a group is one prompt, so a bounded unit."""
    section = F.concat(F.lit("### "), F.col(label), F.lit("\n"), F.coalesce(F.col(content), F.lit("")))
    rows = df.select(key.alias("group_key"), F.struct(F.col(order), F.col(label), section.alias("s")).alias("x"))
    return rows.groupBy("group_key").agg(F.array_sort(F.collect_list("x")).alias("xs")).select(
        "group_key",
        F.concat(F.lit("g-"), slug(F.col("group_key"))).alias("label"),
        F.size("xs").cast("long").alias("input_count"),
        F.array_join("xs.s", "\n\n---\n\n").alias("body"),
    )


def group_key(df: DataFrame, key, on_missing: str = "group") -> DataFrame:
    """Rows with ``group_key``; where ``key`` is null: ``_ungrouped`` (``group``), dropped (``skip``) or an error (``error``)."""
    if on_missing == "group":
        return df.withColumn("group_key", F.coalesce(key.cast("string"), F.lit("_ungrouped")))
    if on_missing == "skip":
        return df.withColumn("group_key", key.cast("string")).where("group_key is not null")
    if on_missing == "error":
        return df.withColumn("group_key", F.coalesce(key.cast("string"), F.raise_error(F.lit("row without a group key")).cast("string")))
    raise ValueError(f"unknown policy {on_missing}")


# Metadata that a chunk's own metadata may not replace.
RESERVED = ("source_label", "chunk_index", "chunk_total")


def chunk_metadata(chunks: DataFrame, source: str, own=None) -> DataFrame:
    """Chunks with ``metadata``: the source's, over them ``own``, over them source_label, chunk_index and chunk_total."""
    from .prompts import overlay

    fixed = F.create_map(F.lit("source_label"), F.col(source).cast("string"), F.lit("chunk_index"), F.col("chunk_index").cast("string"), F.lit("chunk_total"), F.col("chunk_total").cast("string"))
    base = F.col("metadata") if own is None else overlay(F.col("metadata"), F.map_filter(own, lambda k, _: ~k.isin(*RESERVED)))
    return chunks.withColumn("metadata", overlay(base, fixed))


def flat_text(df: DataFrame, key: str, label: str, content: str, part_chars: int = 1_000_000) -> DataFrame:
    """``key``, part, content: contents in label order with blank lines between, cut between rows into parts of about
    ``part_chars``, so that no key must fit in one row; a short key is one part."""
    at = F.sum("_n").over(Window.partitionBy(key).orderBy(label).rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn(content, F.coalesce(F.col(content), F.lit("")))
    sized = df.select(key, label, F.length(content).cast("long").alias("_n")).select(key, label, F.floor(F.coalesce(at, F.lit(0)) / part_chars).cast("long").alias("part"))
    rows = df.select(key, label, content).join(sized, [key, label]).groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col(content).alias("c")))).alias("x"))
    return rows.select(key, "part", F.array_join("x.c", "\n\n").alias("content"))


def month_key(date) -> object:
    """``YYYY-MM`` of an ISO date string, ``undated`` without a dash."""
    m = F.substring(F.coalesce(date, F.lit("")), 1, 7)
    return F.when(m.contains("-"), m).otherwise("undated")


def fold(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Every step of an ordered fold with a running sum and maximum, by key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(
        key, *order, F.count("*").over(w).alias("step"), F.sum(value).over(w).alias("accumulated"), F.max(value).over(w).alias("largest")
    )


def heading(month, topic, label):
    """Section heading of a core synthesis: month, else topic, else label."""
    return F.coalesce(month, topic, label)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``nth``, their place (from 0) in a total ``order``: range partitions are numbered on their own, and only their
    sizes meet in one place."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")).checkpoint()
    before = rows.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return rows.join(F.broadcast(before), "_p").select(*df.columns, (F.col("_b") + F.col("_i")).cast("long").alias("nth"))


def reduce_tree(df: DataFrame, complete, fan_in: int = 100) -> DataFrame:
    """N:1 in levels: rows ``(label, content)`` are put in order of (hash of the content, label) and each ``fan_in`` of them become
    one prompt, so copies are spread over as many prompts as their number asks for; ``complete`` (DataFrame(label, prompt,
    input_count) -> DataFrame(label, content)) answers all of a level at once, until one row is left. Null contents count
    as empty. Each level is checkpointed, so an answer is asked for once."""
    own = df.select(F.col("label").cast("string").alias("label"), F.coalesce("content", F.lit("")).alias("content"))
    rows, total, level = numbered(own.withColumn("at", F.sha2("content", 256)), ["at", "label"]).drop("at"), None, 0
    while total is None or total > 1:
        total = -(-(rows.count() if total is None else total) // fan_in)
        section = F.concat(F.lit("### "), F.col("label"), F.lit("\n"), F.col("content"))
        prompts = rows.groupBy(F.expr(f"nth div {fan_in}").alias("nth")).agg(F.array_sort(F.collect_list(F.struct(F.col("nth").alias("at"), section.alias("s")))).alias("xs"))
        label = F.concat(F.lit(f"reduce-{level}-"), F.col("nth"))
        prompts = prompts.select("nth", label.alias("label"), F.array_join("xs.s", "\n\n---\n\n").alias("prompt"), F.size("xs").cast("long").alias("input_count")).checkpoint()
        rows = complete(prompts.select("label", "prompt", "input_count")).join(prompts.select("label", "nth"), "label").select("label", F.coalesce("content", F.lit("")).alias("content"), "nth").checkpoint()
        level += 1
    return rows.select("label", "content")


def fold_states(inputs: DataFrame, seen: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """``key``, state of each fold: ``resume`` where all that was seen is there unchanged and all new rows come after it,
    ``unchanged`` without new rows, else ``recompute``. ``inputs``/``seen(key, label, artifact_id, at)``;
    ``done(key, fresh)``: whether the transform and the stored content are as they were."""
    s = seen.select(key, "label", F.col("artifact_id").alias("_id"), F.col("at").alias("_at"))
    both = inputs.select(key, "label", "artifact_id", "at").join(s, [key, "label"], "full_outer")
    g = both.groupBy(key).agg(
        F.count_if(F.col("_id").isNotNull() & ~F.col("_id").eqNullSafe(F.col("artifact_id"))).alias("lost"),
        F.max(F.when(F.col("_id").isNotNull(), F.col("at"))).alias("last"),
        F.min(F.when(F.col("_id").isNull(), F.col("at"))).alias("first"),
    )
    state = (
        F.when(~F.coalesce("fresh", F.lit(False)) | (F.col("lost") > 0), "recompute").when(F.col("first").isNull(), "unchanged")
        .when(F.col("first") > F.col("last"), "resume").otherwise("recompute")
    )
    return g.join(done, key, "left").select(key, state.alias("state"))


def fold_rest(inputs: DataFrame, seen: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """The inputs still to be folded: new rows of resumed folds, all rows of recomputed ones."""
    rows = inputs.join(states.where("state <> 'unchanged'"), key)
    known = seen.select(key, "label", F.lit(True).alias("_known"))
    return rows.join(known, [key, "label"], "left").where("state = 'recompute' or _known is null").drop("_known")


def with_reference(df: DataFrame, reference: DataFrame, name: str, body, max_rows: int = 1000, max_chars: int = 4_000_000) -> DataFrame:
    """Each row with all of a small reference layer as one text (policies, specs), which is broadcast. More than ``max_rows`` rows
    or ``max_chars`` characters are an error: such a layer is no prompt."""
    some = reference.select(body.alias("b")).limit(max_rows + 1)
    n, chars = F.count("*"), F.coalesce(F.sum(F.length("b")), F.lit(0))
    text = F.when((n <= max_rows) & (chars <= max_chars), F.array_join(F.array_sort(F.collect_list("b")), "\n\n")).otherwise(F.raise_error(F.lit(f"over {max_rows} rows or {max_chars} characters of reference")))
    return df.join(F.broadcast(some.agg(text.alias(name))))
