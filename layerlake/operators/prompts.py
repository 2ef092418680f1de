"""Prompt operators: rows, groups and fold steps become prompts, a completer answers them, answers become artifacts.

An artifact row is (label, artifact_type, content, artifact_id, input_ids, prompt_id, metadata map<string,string>).
``complete`` takes (label, prompt) rows to (label, content) rows; write its result before it is used twice. A label without
an answer gives no artifact."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_id, render
from .completer import Answers

Complete = Callable[[DataFrame], DataFrame]


def prompt_id(name: str, template: str) -> str:
    return f"{name}_v{hashlib.sha256(template.encode()).hexdigest()[:8]}"


def overlay(under: Column, over: Column) -> Column:
    """A map with the entries of ``over`` in place of those of ``under``."""
    return F.map_concat(F.map_filter(under, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def without(metadata: Column, names: list[str]) -> Column:
    """A map without some keys (what is not searched or shown)."""
    return F.map_filter(metadata, lambda k, _: ~k.isin(*names))


def artifacts(df: DataFrame, label: Column, kind: str, content: Column, metadata: Column | None = None, inputs: Column | None = None, prompt: str | None = None) -> DataFrame:
    none = F.create_map().cast("map<string,string>")
    return df.select(
        label.cast("string").alias("label"), F.lit(kind).alias("artifact_type"), content.alias("content"), content_id(content).alias("artifact_id"),
        (F.array().cast("array<string>") if inputs is None else inputs).alias("input_ids"), F.lit(prompt).cast("string").alias("prompt_id"),
        (none if metadata is None else metadata).alias("metadata"),
    )


def map_synthesis(rows: DataFrame, name: str, template: str, complete: Complete, kind: str = "synthesis", label: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """One artifact for each artifact: ``template`` may name {artifact}, {label} and {artifact_type}. Metadata are the input's, over
    them ``metadata``, over them ``source_label``. ``label`` and ``metadata`` are expressions on the input; labels are unique."""
    said = render(template, artifact=F.col("content"), label=F.col("label"), artifact_type=F.col("artifact_type"))
    answered = complete(rows.select("label", said.alias("prompt"))).select("label", F.col("content").alias("_said"))
    own = F.col("metadata") if metadata is None else overlay(F.col("metadata"), metadata)
    own = overlay(own, F.create_map(F.lit("source_label"), F.col("label")))
    out = F.concat(F.lit(f"{name}-"), F.col("label")) if label is None else label
    return artifacts(rows.join(answered, "label"), out, kind, F.col("_said"), own, F.array("artifact_id"), prompt_id(name, template))


def episodes(transcripts: DataFrame, template: str, complete: Complete) -> DataFrame:
    """One episode for each transcript, named by its conversation (else its label); keeps date, title and customer."""
    conv = F.coalesce(F.col("metadata")["source_conversation_id"], F.col("label"))
    said = render(template, transcript=F.col("content"))
    answered = complete(transcripts.select("label", said.alias("prompt"))).select("label", F.col("content").alias("_said"))
    none = F.lit("")
    kept = F.create_map(
        F.lit("source_conversation_id"), conv, F.lit("date"), F.coalesce(F.col("metadata")["date"], none), F.lit("title"), F.coalesce(F.col("metadata")["title"], none)
    )
    kept = F.map_concat(kept, F.map_filter("metadata", lambda k, v: (k == "customer_id") & (v != "")))
    rows = transcripts.join(answered, "label")
    return artifacts(rows, F.concat(F.lit("ep-"), conv), "episode", F.col("_said"), kept, F.array("artifact_id"), prompt_id("episode_summary", template))


def topical_units(inputs: DataFrame, hits: DataFrame, topics: list[str]) -> DataFrame:
    """topic and the columns of ``inputs(label, ...)``: the rows each topic's search ``hits(topic, label)`` found among them,
    or all rows where it found none. The hits are written once."""
    found = inputs.join(hits.select("topic", "label").distinct().checkpoint(), "label")
    seen = {r.topic for r in found.select("topic").distinct().collect()}  # one value a topic at most
    for t in topics:
        if t not in seen:
            found = found.unionByName(inputs.withColumn("topic", F.lit(t)))
    return found.select("topic", *inputs.columns)


def fold_synthesis(rows: DataFrame, key: str, order: list, template: str, ask: Callable[[str], str], initial: str = "", saved: str | None = None) -> DataFrame:
    """key, content, steps: each key's rows ``(key, label, content, ...)`` are folded in ``order``, a total order inside a key; a step's
    prompt may name {accumulated}, {artifact}, {label}, {step} and {total}.

    One shuffle whatever the longest fold: rows are dealt by key, sorted by (key, order), and a task streams them, holding
    one accumulated text. ``ask`` (a prompt to its answer) runs in the tasks. With ``saved``, a folder that all workers can open,
    each answer is kept under (key, step, prompt) as it comes: a task that starts again, or a later run, asks only for steps
    that are not there. Null contents count as empty."""
    import pyarrow as pa

    texts = rows.select(F.col(key), F.coalesce("label", F.lit("")).alias("label"), F.coalesce("content", F.lit("")).alias("content"), *[F.col(c) for c in order if c not in (key, "label", "content")])
    totals = texts.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("total"))
    counted = texts.join(totals, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    names = [f"_o{i}" for i in range(len(order))]
    kind = T.StructType([rows.schema[key], T.StructField("content", T.StringType()), T.StructField("steps", T.LongType())])
    dealt = counted.select(key, "label", "content", "total", *[F.col(c).alias(n) for c, n in zip(order, names)])
    dealt = dealt.repartition(key).sortWithinPartitions(key, *names).select(key, "label", "content", "total")

    def run(batches):
        memory = Answers(saved) if saved else None
        now, said, step, done = None, initial, 0, []
        for b in batches:
            for k, label, content, total in zip(*(b.column(i).to_pylist() for i in range(4))):
                if step == 0 or k != now:
                    now, said, step = k, initial, 0
                step += 1
                given = {"accumulated": said, "artifact": content, "label": label, "step": str(step), "total": str(total)}
                prompt = filled(template, given)
                name = hashlib.sha256(f"{k!r}|{step}|{prompt}".encode()).hexdigest()
                known = memory.read(name) if memory else None
                said = ask(prompt) if known is None else known
                if memory and known is None:
                    memory.write(name, said)
                if step == total:
                    done.append((k, said, step))
                    step = 0
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], b.schema.field(0).type), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())], names=kind.names)
            done = []

    return dealt.mapInArrow(run, kind)


def filled(template: str, given: dict[str, str]) -> str:
    """``render`` for one prompt inside a task: inserted text is never scanned again."""
    return re.sub(r"\{(\w+)\}", lambda m: given[m[1]], template)
