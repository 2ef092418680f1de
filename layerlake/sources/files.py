"""File sources: text and markdown with front matter, tree and flat chat exports, line sessions.

Each reader takes a folder and gives one row an artifact: label, content, source_path and metadata columns. Files
are found by Spark's own recursive listing. What does not parse is kept with its path (``malformed``)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import middle_cut, word_count

# Formats of the labels, roles and markers.
TURN = r"(?m)^(User|Human|Assistant|AI|System):\s*"
CUT_MARKER = "\n\n[... middle truncated ...]\n\n"
ROLES = ("user", "assistant")

EXPORT = (
    "conversation_id string, id string, title string, create_time double, current_node string, customer_id string, "
    "mapping variant, conversations variant, _corrupt_record string"
)


def files(spark: SparkSession, folder: str, glob: str = "*", exclude: str | None = None) -> DataFrame:
    """path, source_path, value (whole text) of the files below ``folder`` whose names match ``glob``; paths that
    match the regular expression ``exclude`` are left out. One row a file: for formats of bounded files."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), "value")
    if exclude:
        rows = rows.where(~F.col("path").rlike(exclude))
    root = F.regexp_replace(F.lit(folder), r"^\w+:/*|/+$", "")
    return rows.withColumn("source_path", _relative(F.col("path"), root))


def _relative(path: Column, root: Column) -> Column:
    at = F.instr(path, F.concat(F.ltrim(root, F.lit("/")), F.lit("/")))
    return F.when(at > 0, F.substring(path, at + F.length(F.ltrim(root, F.lit("/"))) + 1, F.lit(1 << 30))).otherwise(path)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.url_decode(F.element_at(F.split(path, "/"), -1)), r"(?<=.)\.[^.]*$", "")


def title_from(name: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, r"^\d{4}-\d{2}-\d{2}[-_]?", ""), r"[-_]+", " "))
    return F.when(bare == "", name).otherwise(F.initcap(bare))


def date_from(name: Column) -> Column:
    return F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})", 1)


def safe_id(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9_-]", "-"), "-+", "-"), "^-|-$", "")


def front_matter(text: Column) -> tuple[Column, Column]:
    """(map of keys to scalar strings, body). Values keep their text; quotes around them go; the last of equal keys wins."""
    block = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?\n)---\s*\n", 1)
    body = F.regexp_replace(text, r"(?s)\A---\s*\n.*?\n---\s*\n", "")
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[^#:][^:]*:"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.trim(F.substring_index(x, ":", 1)).alias("key"),
            F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r"""^"(.*)"$|^'(.*)'$""", "$1$2").alias("value"),
        ),
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = F.transform(
        keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value"))
    )
    return F.map_from_entries(last), body


def typed(value: Column) -> Column:
    """The kind a front matter value has: list, bool, int, float, date or string."""
    return (
        F.when(value.rlike(r"^\[.*\]$"), "list").when(F.lower(value).isin("true", "yes", "false", "no"), "bool")
        .when(value.rlike(r"^[+-]?\d+$"), "int").when(value.rlike(r"^[+-]?(\d+\.\d*|\.?\d+)([eE][+-]?\d+)?$"), "float")
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date").otherwise("string")
    )


def list_items(value: Column) -> Column:
    """Items of ``[a, "b"]`` or ``a, b``; blank ones go."""
    bare = F.transform(F.split(F.regexp_replace(value, r"^\[(.*)\]$", "$1"), ","), lambda x: F.trim(x))
    return F.transform(F.filter(bare, lambda x: x != ""), lambda x: F.regexp_replace(x, r"""^"(.*)"$|^'(.*)'$""", "$1$2"))


def parse_text(rows: DataFrame) -> DataFrame:
    """Text artifacts of ``rows(path, value)``; files without a body give none."""
    fields, body = front_matter(F.col("value"))
    name = stem(F.col("path"))
    found = rows.withColumn("_f", fields).withColumn("_b", body).where(F.col("_b").rlike(r"(?U)\S"))
    content = F.concat(F.regexp_replace("_b", r"(?U)^\s+|\s+\z", ""), F.lit("\n"))
    turns = F.regexp_count("_b", F.lit(TURN)).cast("long")
    return found.select(
        F.concat(F.lit("t-text-"), safe_id(name)).alias("label"), content.alias("content"), "path",
        F.coalesce(F.col("_f")["title"], title_from(name)).alias("title"), F.coalesce(F.col("_f")["date"], date_from(name)).alias("date"),
        list_items(F.coalesce(F.col("_f")["tags"], F.lit(""))).alias("tags"), word_count(content).alias("word_count"), turns.alias("message_count"),
    )


def read_text(spark: SparkSession, folder: str) -> DataFrame:
    return parse_text(files(spark, folder, "*.{md,txt}"))


def read_exports(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """Rows of JSON exports: a list of conversations, or an object with ``conversations``, told apart by their fields."""
    reader = spark.read.schema(EXPORT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.json(folder).withColumn("path", F.col("_metadata.file_path"))


def malformed(exports: DataFrame) -> DataFrame:
    """path, error of files that are no JSON (they give no artifact)."""
    return exports.where("_corrupt_record is not null and mapping is null and conversations is null").select("path", F.lit("malformed json").alias("error"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _order(ids: pd.Series, parents: pd.Series, firsts: pd.Series, current: pd.Series) -> pd.Series:
    def walk(ids, parents, firsts, current):
        at = {k: i for i, k in enumerate(ids)}
        step, node = (parents, current) if current in at else (firsts, next((k for k, p in zip(ids, parents) if p is None), None))
        out = []
        while node in at and len(out) < len(at):  # a cycle ends after as many steps as there are nodes
            out.append(at[node])
            node = step[at[node]]
        return out[::-1] if step is parents else out

    return pd.Series([walk(*x) for x in zip(ids, parents, firsts, current)])


def _day(seconds: Column) -> Column:
    """UTC day of seconds since 1970 (of the session's zone, which is UTC here); missing or zero: empty."""
    return F.when(seconds.isNull() | (seconds == 0), "").otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"))


def tree_chats(exports: DataFrame, prefix: str = "t-chatgpt") -> DataFrame:
    """Transcripts of conversations kept as message trees: the branch that ends in ``current_node``, else first children."""
    node = "struct<parent:string,children:array<string>,message:variant>"
    trees = exports.where("mapping is not null").select(
        "path", F.coalesce("conversation_id", "id").alias("conv_id"), F.coalesce("title", F.lit("Untitled")).alias("title"),
        "create_time", "current_node", "customer_id",
        F.map_entries(F.try_variant_get("mapping", "$", f"map<string,{node}>")).alias("nodes"),
    )
    order = _order(
        F.col("nodes.key"), F.transform("nodes", lambda n: n["value"]["parent"]),
        F.transform("nodes", lambda n: F.try_element_at(n["value"]["children"], F.lit(1))), "current_node",
    )
    picked = F.filter(F.transform("_o", lambda i: F.get("nodes", i)["value"]["message"]), lambda m: m.isNotNull() & ~F.is_variant_null(m))

    def line(m):
        parts = F.filter(F.coalesce(F.try_variant_get(m, "$.content.parts", "array<variant>"), F.array().cast("array<variant>")), lambda p: F.schema_of_variant(p) == "STRING")
        return F.struct(
            F.try_variant_get(m, "$.author.role", "string").alias("role"),
            F.array_join(F.transform(parts, lambda p: F.try_variant_get(p, "$", "string")), "").alias("text"),
            F.try_variant_get(m, "$.create_time", "double").alias("at"),
        )

    said = F.filter("_m", lambda m: m["role"].isin(*ROLES) & m["text"].rlike(r"(?U)\S"))
    rows = trees.withColumn("_o", order).withColumn("_m", F.transform(picked, line)).withColumn("_s", said).where(F.size("_s") > 0)
    return rows.select(
        F.concat_ws("-", F.lit(prefix), "conv_id").alias("label"),
        F.concat(F.array_join(F.transform("_s", lambda m: F.concat_ws(": ", m["role"], m["text"])), "\n\n"), F.lit("\n")).alias("content"),
        "path", F.col("conv_id").alias("source_conversation_id"), "title", _day(F.col("create_time")).alias("date"),
        _day(F.array_max(F.col("_m.at"))).alias("last_message_date"), F.size("_s").cast("long").alias("message_count"), "customer_id",
    )


def _iso_day(stamp: Column) -> Column:
    """Day as written in an ISO time; otherwise its first ten characters."""
    return F.when(F.length(stamp) >= 10, F.substring(stamp, 1, 10)).otherwise("")


def flat_chats(exports: DataFrame, prefix: str = "t-claude") -> DataFrame:
    """Transcripts of conversations kept as flat message lists; ``message_count`` counts all messages, kept or not."""
    msg = "array<struct<sender:string,text:string,content:variant,created_at:string>>"
    conv = exports.where("conversations is not null").select("path", F.explode(F.try_variant_get("conversations", "$", "array<variant>")).alias("c"))
    got = lambda p, t="string": F.try_variant_get("c", p, t)
    rows = conv.select(
        "path", got("$.uuid").alias("conv_id"), F.coalesce(got("$.name"), got("$.title"), F.lit("Untitled")).alias("title"),
        got("$.created_at").alias("created_at"), got("$.chat_messages", msg).alias("_m"),
    )

    def text(m):
        blocks = F.transform(F.try_variant_get(m["content"], "$", "array<variant>"), lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string")), F.lit("")))
        plain = F.when(F.schema_of_variant(m["content"]) == "STRING", F.try_variant_get(m["content"], "$", "string"))
        return F.coalesce(m["text"], plain, F.array_join(blocks, " "), F.lit(""))

    def line(m):
        who = F.when(m["sender"].isin("human", "Human"), "user").otherwise(F.coalesce(m["sender"], F.lit("unknown")))
        return F.struct(who.alias("role"), text(m).alias("text"))

    said = F.filter(F.transform("_m", line), lambda m: m["text"].rlike(r"(?U)\S"))
    rows = rows.withColumn("_s", said).where(F.size("_s") > 0)
    newest = F.array_max(F.transform("_m", lambda m: F.struct(F.try_to_timestamp(m["created_at"]).alias("t"), m["created_at"].alias("s"))))
    return rows.select(
        F.concat_ws("-", F.lit(prefix), "conv_id").alias("label"),
        F.concat(F.array_join(F.transform("_s", lambda m: F.concat_ws(": ", m["role"], m["text"])), "\n\n"), F.lit("\n")).alias("content"),
        "path", F.col("conv_id").alias("source_conversation_id"), "title", _iso_day(F.coalesce("created_at", F.lit(""))).alias("date"),
        F.when(newest["t"].isNull(), "").otherwise(_iso_day(newest["s"])).alias("last_message_date"),
        F.size("_m").cast("long").alias("message_count"), F.lit(None).cast("string").alias("customer_id"),
    )


def line_sessions(rows: DataFrame, prefix: str = "t-claude-code", max_chars: int = 80_000) -> DataFrame:
    """Transcripts of JSON-lines sessions ``rows(path, value)``: user and assistant entries, text blocks only, at least two
    turns, the middle cut out of long ones. Malformed lines are passed over; the first value of each field counts."""
    lines = rows.select("path", F.posexplode(F.split("value", "\n")).alias("nth", "line")).select(
        "path", "nth", F.try_parse_json("line").alias("v")
    )
    got = lambda p, t="string": F.try_variant_get("v", p, t)
    content = F.try_variant_get("v", "$.message.content", "variant")
    blocks = F.transform(
        F.filter(F.try_variant_get(content, "$", "array<struct<type:string,text:string>>"), lambda b: (b["type"] == "text") & b["text"].rlike(r"(?U)\S")),
        lambda b: F.regexp_replace(b["text"], r"(?U)^\s+|\s+\z", ""),
    )
    text = F.when(F.schema_of_variant(content) == "STRING", F.regexp_replace(F.try_variant_get(content, "$", "string"), r"(?U)^\s+|\s+\z", "")).otherwise(
        F.coalesce(F.array_join(blocks, "\n\n"), F.lit(""))
    )
    kept = lines.where(got("$.type").isin(*ROLES) & F.schema_of_variant(F.try_variant_get("v", "$.message", "variant")).startswith("OBJECT"))
    kept = kept.select(
        "path", "nth", text.alias("text"), F.coalesce(got("$.message.role"), got("$.type")).alias("role"),
        F.nullif(got("$.slug"), F.lit("")).alias("slug"), F.nullif(got("$.gitBranch"), F.lit("")).alias("git_branch"),
        F.nullif(got("$.cwd"), F.lit("")).alias("cwd"), F.when(F.try_to_timestamp(got("$.timestamp")).isNotNull(), F.substring(got("$.timestamp"), 1, 10)).alias("date"),
    )
    turn = F.when(F.col("text") != "", F.struct("nth", F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), "text").alias("t")))
    first = [F.coalesce(F.min(F.when(F.col(c).isNotNull(), F.struct("nth", c)))[c], F.lit("")).alias(c) for c in ("slug", "git_branch", "cwd", "date")]
    g = kept.groupBy("path").agg(F.array_sort(F.collect_list(turn)).alias("ts"), *first).where(F.size("ts") >= 2)
    name = stem(F.col("path"))
    return g.select(
        F.concat_ws("-", F.lit(prefix), name).alias("label"), middle_cut(F.array_join("ts.t", "\n\n"), max_chars, CUT_MARKER).alias("content"),
        "path", name.alias("session_id"), F.when(F.col("slug") == "", name).otherwise(F.col("slug")).alias("title"), "date", "cwd", "git_branch",
        F.size("ts").cast("long").alias("message_count"),
    )


def read_sessions(spark: SparkSession, folder: str, glob: str = "*.{jsonl,jsonl.gz}") -> DataFrame:
    """Sessions of ``*.jsonl`` and of gzip archives; a content that occurs under several paths is read once."""
    rows = files(spark, folder, glob)
    once = rows.withColumn("_h", F.sha2("value", 256)).groupBy("_h").agg(F.min("path").alias("path"), F.first("value").alias("value")).drop("_h")
    return line_sessions(once)


#: Readers by extension; ``read_all`` unites what they give on common columns.
READERS = {
    "text": read_text,
    "tree": lambda spark, folder: tree_chats(read_exports(spark, folder)),
    "flat": lambda spark, folder: flat_chats(read_exports(spark, folder)),
    "lines": read_sessions,
}


def read_all(spark: SparkSession, folder: str, readers: dict | None = None) -> DataFrame:
    """Artifacts of every registered reader: label, content, artifact_id, artifact_type, title, date, path."""
    out = None
    for read in (readers or READERS).values():
        part = read(spark, folder).select(
            "label", "content", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("artifact_id"),
            F.lit("transcript").alias("artifact_type"), "title", "date", "path",
        )
        out = part if out is None else out.unionByName(part)
    return out
