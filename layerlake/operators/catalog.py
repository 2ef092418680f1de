"""Listings over artifact tables: versions, prefixes, pages, layers, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, latest (the value of the newest row), versions."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("latest"), F.count("*").alias("versions"))


def as_of(df: DataFrame, key: str, version: str, at, values: list[str]) -> DataFrame:
    """The row of each key that was newest at version ``at``."""
    newest = df.where(F.col(version) <= at).groupBy(key).agg(F.max_by(F.struct(version, *values), version).alias("x"))
    return newest.select(key, "x.*")


def next_version(df: DataFrame, key: str, version: str) -> DataFrame:
    return df.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def newest(df: DataFrame, time: str, tie: str, k: int) -> DataFrame:
    """The ``k`` newest rows, newest first."""
    return df.orderBy(F.desc(time), F.desc(tie)).limit(k)


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page (from 1, of up to 200 rows) in ``order`` (a total one) with ``total``, the number of all rows."""
    size = min(size, 200)
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.join(F.broadcast(df.agg(F.count("*").alias("total"))))


def resolve_prefix(artifacts: DataFrame, asked: DataFrame) -> DataFrame:
    """prefix, label, state for ``asked(prefix)`` over ``artifacts(label, artifact_id)``: the label itself, else the only label that
    begins so, else the only artifact whose hash does. ``state``: found, ambiguous (no label then) or absent.

    Names are cut to each length that a prefix has (as many as there are different lengths) and joined on what is left, so
    neither side needs to be small."""
    bare = F.regexp_replace("prefix", "^sha256:", "")
    q = asked.select("prefix", bare.alias("_h")).distinct()
    a = artifacts.select("label", "artifact_id", F.regexp_replace("artifact_id", "^sha256:", "").alias("_id"))

    def begins(name: str, wanted: str, kind: str) -> DataFrame:
        lengths = [r[0] for r in q.select(F.length(wanted)).distinct().collect()]
        cut = F.filter(F.array(*(F.when(F.length(name) >= n, F.substring(name, 1, n)) for n in lengths)), lambda x: x.isNotNull())
        parts = a.select("label", "artifact_id", F.explode(cut).alias("_cut")) if lengths else a.withColumn("_cut", F.lit("")).limit(0)
        return parts.join(q, F.col("_cut") == F.col(wanted)).select("prefix", "label", "artifact_id", F.lit(kind).alias("_kind"))

    hits = begins("label", "prefix", "label").unionByName(begins("_id", "_h", "hash"))
    by_label, by_hash = F.col("_kind") == "label", F.col("_kind") == "hash"
    g = hits.groupBy("prefix").agg(
        F.max(F.when(F.col("label") == F.col("prefix"), F.col("label"))).alias("exact"),
        F.count_if(by_label).alias("n1"), F.min(F.when(by_label, F.col("label"))).alias("l1"),
        F.count_if(by_hash).alias("n2"), F.min(F.when(by_hash, F.col("label"))).alias("l2"),
    )
    g = asked.select("prefix").distinct().join(g, "prefix", "left")
    label = F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("n1") == 1, F.col("l1")).when((F.col("n1") == 0) & (F.col("n2") == 1), F.col("l2"))
    many = (F.col("n1") > 1) | ((F.col("n1") == 0) & (F.col("n2") > 1))
    state = F.when(label.isNotNull(), "found").when(many, "ambiguous").otherwise("absent")
    return g.select("prefix", label.alias("label"), state.alias("state"))


def labels_of(ids: DataFrame, artifacts: DataFrame) -> DataFrame:
    """child, labels (sorted) for ``ids(child, artifact_id)``: an id that more than one label has, or none, leaves its child's
    whole list empty."""
    names = artifacts.groupBy("artifact_id").agg(F.countDistinct("label").alias("k"), F.min("label").alias("name"))
    rows = ids.join(names, "artifact_id", "left")
    g = rows.groupBy("child").agg(F.count_if(F.coalesce("k", F.lit(0)) != 1).alias("bad"), F.array_sort(F.collect_set("name")).alias("all"))
    return g.select("child", F.when(F.col("bad") == 0, F.col("all")).otherwise(F.array().cast("array<string>")).alias("labels"))


def layers(df: DataFrame, layer: str, time: str, id_: str) -> DataFrame:
    """layer, n, first_id, newest."""
    return df.groupBy(layer).agg(F.count("*").alias("n"), F.min(id_).alias("first_id"), F.max(time).alias("newest"))


def dag(nodes: DataFrame, edges: DataFrame, counts: DataFrame) -> DataFrame:
    """kind (node, edge), source, target, n: layers with their numbers of artifacts, and the edges between them.
    ``nodes(layer)``, ``edges(source, target)``, ``counts(layer, n)``."""
    n = nodes.join(counts, "layer", "left").select(F.lit("node").alias("kind"), F.col("layer").alias("source"), F.lit(None).cast("string").alias("target"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    e = edges.distinct().select(F.lit("edge").alias("kind"), "source", "target", F.lit(None).cast("long").alias("n"))
    return n.unionByName(e)


def status_counts(df: DataFrame, status: str, by: str | None = None, done: str = "processed") -> DataFrame:
    """total, processed, pending rows (of each ``by``)."""
    n = F.count_if(F.col(status) == done)
    return df.groupBy(*([by] if by else [])).agg(F.count("*").alias("total"), n.alias("processed"), (F.count("*") - n).alias("pending"))


def run_rollup(log: DataFrame) -> DataFrame:
    """layer, artifacts, calls, tokens, seconds of ``log(layer, event, tokens, seconds)``; events: artifact, call."""
    return log.groupBy("layer").agg(
        F.count_if(F.col("event") == "artifact").alias("artifacts"), F.count_if(F.col("event") == "call").alias("calls"),
        F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.round(F.sum(F.coalesce("seconds", F.lit(0.0))), 4).alias("seconds"),
    )


def by_extension(files: DataFrame, path: str) -> DataFrame:
    """extension (lower case, empty without one), n, depth (folders above the deepest file)."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))
    return files.groupBy(ext.alias("extension")).agg(F.count("*").alias("n"), F.max(F.size(F.split(path, "/")) - 1).cast("long").alias("depth"))


def previous_run(runs: DataFrame, head: str) -> DataFrame:
    """The newest run (by name) of another state than ``head``, the current one. ``runs(run, state)``."""
    return runs.where(F.col("state") != head).orderBy(F.desc("run")).limit(1)


def input_key(ids: Column) -> Column:
    """Sorted input ids as one key of a join."""
    return F.array_join(F.array_sort(ids), ",")


def search_matches(index: DataFrame, artifacts: DataFrame) -> DataFrame:
    """check, missing, unexpected, passed: labels of a search surface against those it was made from."""
    a, b = artifacts.select("label").distinct(), index.select("label").distinct()
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "label", "full_outer")
    m, u = F.count_if(F.col("b").isNull()), F.count_if(F.col("a").isNull())
    return both.agg(m.alias("missing"), u.alias("unexpected"), ((m == 0) & (u == 0)).alias("passed"))


def merge_integrity(merged: DataFrame, sources: DataFrame, field: str) -> DataFrame:
    """cluster, n_values of merged groups whose sources hold more than one value of a field that must not be mixed.
    ``merged(cluster, label)``; ``sources(label, field)``."""
    rows = merged.join(sources.select("label", F.col(field).alias("_f")), "label")
    return rows.groupBy("cluster").agg(F.countDistinct("_f").alias("n_values")).where("n_values > 1")
