"""Validators, diffs and cache decisions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank

#: Fixed patterns of personal data.
PII = {
    "credit_card": r"\b(?:4[0-9]{3}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}|5[1-5][0-9]{2}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}|3[47][0-9]{1}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{3,4}|6(?:011|5[0-9]{2})[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4})\b",
    "ssn": r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b",
    "email": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b",
}


def pii(df: DataFrame, label: str, text: str, patterns: tuple = tuple(PII)) -> DataFrame:
    """One row a finding: label, pattern, value."""
    found = F.array(*[
        F.struct(F.lit(p).alias("pattern"), F.regexp_extract_all(F.col(text), F.lit(PII[p]), F.lit(0)).alias("hits")) for p in patterns
    ])
    rows = df.select(F.col(label).alias("label"), F.explode(found).alias("f"))
    return rows.select("label", "f.pattern", F.explode("f.hits").alias("value"))


def required(df: DataFrame, label: str, field: str) -> DataFrame:
    return df.where(is_blank(F.col(field))).select(F.col(label).alias("label"), F.lit(field).alias("field"))


def mutual_exclusion(df: DataFrame, group: str, field: str) -> DataFrame:
    """Groups whose rows hold more than one value of a field."""
    return df.groupBy(group).agg(F.countDistinct(field).alias("n_values"), F.min(field).alias("first_value")).where("n_values > 1")


def diff(old: DataFrame, new: DataFrame, label: str, content: str) -> DataFrame:
    """label, change: added, removed or changed; unchanged rows go."""
    a = old.select(label, F.sha2(content, 256).alias("_a"))
    b = new.select(label, F.sha2(content, 256).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, label, "full_outer").select(label, change.alias("change")).where("change is not null")


def cache_split(inputs: DataFrame, cache: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Rows with ``state``: cached (same fingerprint), stale (another one) or new."""
    c = cache.select(key, F.col(fingerprint).alias("_had"))
    state = F.when(F.col("_had").isNull(), "new").when(F.col("_had") == F.col(fingerprint), "cached").otherwise("stale")
    return inputs.join(c, key, "left").withColumn("state", state).drop("_had")


def mask_keys(text):
    """A text with the middle of every service key masked."""
    return F.regexp_replace(text, r"\b((?:sk|pk|rk|ghp|gho|xox[abp])[-_])[A-Za-z0-9_-]{12,}([A-Za-z0-9_-]{4})\b", "$1****$2")


def mask_key(key):
    """A service key as it is shown: its first and last four characters; keys of up to eight are not shown at all."""
    return F.when(F.length(key) <= 8, F.lit("****")).otherwise(F.concat(F.substring(key, 1, 4), F.lit("..."), F.right(key, F.lit(4))))


# How much of a finding is shown.
def redact(pattern, value):
    """A finding with only a few of its characters shown."""
    digits = F.regexp_replace(value, r"[\s-]", "")
    return (
        F.when(pattern == "credit_card", F.concat(F.substring(digits, 1, 4), F.lit("****"), F.right(digits, F.lit(2))))
        .when(pattern == "ssn", F.concat(F.lit("***-**-"), F.right(value, F.lit(4))))
        .when(pattern == "email", F.concat(F.substring(F.split_part(value, F.lit("@"), F.lit(1)), 1, 2), F.lit("***@"), F.split_part(value, F.lit("@"), F.lit(2))))
        .when(pattern == "phone", F.concat(F.lit("***-***-"), F.right(value, F.lit(4))))
        .otherwise("****")
    )


def violation_id(kind, label, a, b):
    """16 digits that do not depend on the order, case and outer blanks of the two claims."""
    claims = F.array_sort(F.array(F.lower(F.trim(a)), F.lower(F.trim(b))))
    return F.substring(F.sha2(F.concat_ws("|", kind, label.cast("string"), F.element_at(claims, 1), F.element_at(claims, 2)), 256), 1, 16)


def violation_states(log: DataFrame) -> DataFrame:
    """Newest state of each violation from ``log(violation_id, at, event, content_hash)``; events: seen, ignored, resolved.
    Seen again is active, but one ignored at the same content stays ignored."""
    newest = log.groupBy("violation_id").agg(
        F.max(F.when(F.col("event") == "seen", F.struct("at", "content_hash"))).alias("seen"),
        F.max(F.when(F.col("event") != "seen", F.struct("at", "event", "content_hash"))).alias("act"),
    )
    same = F.col("act.content_hash").eqNullSafe(F.col("seen.content_hash"))
    state = (
        F.when(F.col("act").isNull(), "active").when((F.col("act.event") == "ignored") & (same | F.col("seen").isNull()), "ignored")
        .when(F.col("seen").isNotNull() & (F.col("seen.at") > F.col("act.at")), "active").otherwise(F.col("act.event"))
    )
    return newest.select("violation_id", state.alias("status"), F.coalesce("seen.content_hash", "act.content_hash").alias("content_hash"))


def expire(states: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Active violations whose content is no more are expired. ``artifacts(content_hash)``."""
    now = artifacts.select("content_hash").distinct().withColumn("_there", F.lit(True))
    gone = (F.col("status") == "active") & F.col("_there").isNull()
    return states.join(now, "content_hash", "left").withColumn("status", F.when(gone, "expired").otherwise(F.col("status"))).drop("_there")


def fingerprint(text):
    """16 digits of a text with unified line ends and no blanks at its end."""
    return F.substring(F.sha2(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?U)\s+\z", ""), 256), 1, 16)


def inputs_fingerprint(ids):
    """16 digits of an array of input ids, in any order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), "|"), 256), 1, 16)


def explain(old, new):
    """Sorted keys on which two maps of fingerprint parts differ."""
    keys = F.array_union(F.map_keys(old), F.map_keys(new))
    return F.array_sort(F.filter(keys, lambda k: ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k))))


def stale(edges: DataFrame, current: DataFrame) -> DataFrame:
    """child, parent of ``edges(child, parent, parent_hash)`` whose parent has another content now, or is gone.
    ``current(label, content_hash)``."""
    c = current.select(F.col("label").alias("parent"), "content_hash")
    return edges.join(c, "parent", "left").where(~F.col("content_hash").eqNullSafe(F.col("parent_hash"))).select("child", "parent")


def missing(manifest: DataFrame, local: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a manifest not held here with the same key and content."""
    return manifest.join(local.select(*keys).distinct(), keys, "left_anti")


def closure_check(expected: DataFrame, found: DataFrame) -> DataFrame:
    """label, state: missing (expected, not found) or unexpected (found, not expected)."""
    a, b = expected.select("label").distinct(), found.select("label").distinct()
    return a.join(b, "label", "left_anti").withColumn("state", F.lit("missing")).unionByName(b.join(a, "label", "left_anti").withColumn("state", F.lit("unexpected")))


def metadata_changes(old, new):
    """Sorted keys of two metadata maps whose values differ, each as ``key: old -> new`` (nothing where absent)."""
    keys = F.array_union(F.map_keys(old), F.map_keys(new))
    differ = F.array_sort(F.filter(keys, lambda k: ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k))))
    return F.transform(differ, lambda k: F.concat(k, F.lit(": "), F.coalesce(F.try_element_at(old, k), F.lit("")), F.lit(" -> "), F.coalesce(F.try_element_at(new, k), F.lit(""))))


def line_changes(old: DataFrame, new: DataFrame, label: str, content: str) -> DataFrame:
    """``label``, added, removed: lines that each changed content gained and lost, as multisets; computed by a join of line counts,
    so long contents are no single task's work."""
    def lines(df, sign):
        return df.select(label, F.explode(F.split(content, "\n", -1)).alias("line"), F.lit(sign).alias("s"))

    n = lines(new, 1).unionByName(lines(old, -1)).groupBy(label, "line").agg(F.sum("s").alias("d")).where("d <> 0")
    return n.groupBy(label).agg(F.sum(F.greatest("d", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("removed"))


def unified_diff(old: DataFrame, new: DataFrame, label: str, content: str) -> DataFrame:
    """``label``, diff: the unified diff of each changed content that both have."""

    @F.pandas_udf("string")
    def diff_of(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(["".join(difflib.unified_diff(x.splitlines(True), y.splitlines(True), f"a/{z}", f"b/{z}", lineterm="")) for x, y, z in zip(a, b, n)])

    both = old.select(label, F.coalesce(content, F.lit("")).alias("_a")).join(new.select(label, F.coalesce(content, F.lit("")).alias("_b")), label).where("_a <> _b")
    return both.select(label, diff_of("_a", "_b", F.col(label).cast("string")).alias("diff"))


def unresolved(edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Closure check: parents that no artifact has."""
    return edges.select("parent").distinct().join(artifacts.select(F.col("label").alias("parent")), "parent", "left_anti")


def verify(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """check, failed, passed over ``artifacts(label, content, artifact_id)`` and ``edges(child, parent)``."""
    wrong = artifacts.where(F.col("artifact_id") != F.concat(F.lit("sha256:"), F.sha2("content", 256)))
    empty = artifacts.where(is_blank(F.col("content")))
    twice = artifacts.groupBy("label").agg(F.countDistinct("artifact_id").alias("n")).where("n > 1")
    parts = {"content_hashes": wrong, "contents": empty, "labels": twice, "provenance": unresolved(edges, artifacts)}
    out = None
    for name, bad in parts.items():
        row = bad.agg(F.count("*").alias("failed")).select(F.lit(name).alias("check"), "failed", (F.col("failed") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def cost(plan: DataFrame, in_tokens: int = 2000, out_tokens: int = 500, in_price: float = 3.0, out_price: float = 15.0) -> DataFrame:
    """Calls, tokens and price (a million tokens) of the rows of ``plan(layer, state)`` that are not cached, by layer."""
    calls = F.count_if(F.col("state") != "cached")
    return plan.groupBy("layer").agg(
        calls.alias("calls"), F.count_if(F.col("state") == "cached").alias("cached"), (calls * (in_tokens + out_tokens)).alias("tokens"),
        F.round(calls * (in_tokens * in_price + out_tokens * out_price) / 1e6, 6).alias("price"),
    )
