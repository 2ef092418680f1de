"""Completions of prompts: requests with stable ids, recorded answers, retries, and what becomes of errors.

A completer takes ``requests(request_id, label, prompt)`` to rows (request_id, content, error). Write its result before
it is used twice: what an outside service answers may differ each time."""

from __future__ import annotations

import queue
import random
import re
import threading
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Error texts by verdict, in the order they are tried.
VERDICTS = (
    ("fatal", ("invalid.*auth", "invalid.*api.?key", "authentication.*failed", "unauthorized", "error code: 401")),
    ("dlq", ("content.?filter", "high.?risk", "content.?moderation", "safety.?system", "rejected.*prompt", "flagged.*content")),
    ("dlq", ("context.?length.*exceeded", "maximum.*tokens", "too.?many.?tokens", "input.*too.*long", "prompt.*too.*long")),
)


def requests(df: DataFrame, label: str, prompt: Column, model: str = "extract", max_tokens: int = 1024, temperature: float = 0.0) -> DataFrame:
    """One request a row. The id covers model, settings and the prompt (line ends unified, blanks at its end off)."""
    text = F.regexp_replace(F.replace(prompt, F.lit("\r\n"), F.lit("\n")), r"(?U)\s+\z", "")
    key = F.to_json(F.struct(F.lit(max_tokens).alias("max_tokens"), F.lit(model).alias("model"), text.alias("prompt"), F.lit(temperature).alias("temperature")))
    return df.select(F.sha2(key, 256).alias("request_id"), F.col(label).alias("label"), prompt.alias("prompt"))


def extractive(reqs: DataFrame, n_chars: int = 200) -> DataFrame:
    """The deterministic default: the prompt's first characters."""
    return reqs.select("request_id", F.substring("prompt", 1, n_chars).alias("content"), F.lit(None).cast("string").alias("error")).dropDuplicates(["request_id"])


def pending(reqs: DataFrame, results: DataFrame) -> DataFrame:
    """Requests not answered yet, each once: what a resumed run has to send."""
    return reqs.dropDuplicates(["request_id"]).join(results.select("request_id"), "request_id", "left_anti")


def replay(reqs: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded answers; a request without one is an error row."""
    got = recorded.select("request_id", "content").dropDuplicates(["request_id"])
    miss = F.when(F.col("content").isNull(), "no recorded answer")
    return reqs.select("request_id").distinct().join(got, "request_id", "left").withColumn("error", miss)


def call(
    reqs: DataFrame, send: Callable[[str], str], retries: int = 3, pause_s: float = 1.0, workers: int = 10, deadline_s: float = 120.0, saved: str | None = None
) -> DataFrame:
    """Answers of a function run in tasks: request_id, content, error, in the order of the requests of each batch.

    At most ``workers`` requests of a task are out at a time. One that takes over ``deadline_s`` seconds becomes an error row, and
    its worker is replaced. Rate limits are retried with growing pauses, other errors become rows. With ``saved``, a folder that
    all workers can open, each answer is kept as it comes, and a task or run that starts again sends only what is lacking."""

    def run(batches):
        for b in batches:
            ids, prompts = (b.column(c).to_pylist() for c in ("request_id", "prompt"))
            memory = Answers(saved) if saved else None
            known = {i: memory.read(i) for i in ids} if memory else {}
            todo = [(i, p) for i, p in zip(ids, prompts) if known.get(i) is None]
            got = _pooled(todo, lambda p: _retried(send, p, retries, pause_s), workers, deadline_s, memory)
            rows = [(i, known[i], None) if known.get(i) is not None else (i, *got[i]) for i in ids]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["request_id", "content", "error"])

    once = reqs.dropDuplicates(["request_id"]).select("request_id", "prompt")
    return once.mapInArrow(run, "request_id string, content string, error string")


def _retried(send: Callable[[str], str], prompt: str, retries: int, pause_s: float) -> tuple[str | None, str | None]:
    for attempt in range(retries + 1):
        try:
            return send(prompt), None
        except Exception as e:  # the service's errors are data here
            said = str(e)
            if not re.search("rate|429", said.lower()) or attempt == retries:
                return None, said or type(e).__name__
            time.sleep(pause_s * 2**attempt + pause_s * random.random() / 2)
    return None, "not sent"


def _pooled(todo: list[tuple[str, str]], ask: Callable, workers: int, deadline_s: float, memory: Answers | None) -> dict[str, tuple]:
    """Answers by id. Threads take the next request when they are done; a request over its deadline is given up with its thread."""
    out: dict[str, tuple] = {}
    waiting, done, begun = list(reversed(todo)), queue.Queue(), {}

    def work(i: str, prompt: str) -> None:
        done.put((i, ask(prompt)))

    while waiting or begun:
        while waiting and len(begun) < max(1, workers):
            i, prompt = waiting.pop()
            begun[i] = time.monotonic()
            threading.Thread(target=work, args=(i, prompt), daemon=True).start()
        try:
            i, answer = done.get(timeout=max(0.0, min(begun.values()) + deadline_s - time.monotonic()))
            if begun.pop(i, None) is not None:  # not one that was given up
                out[i] = answer
                if memory and answer[1] is None:
                    memory.write(i, answer[0])
        except queue.Empty:
            late = [i for i, t in begun.items() if time.monotonic() - t >= deadline_s]
            for i in late:
                del begun[i]
                out[i] = (None, f"timed out after {deadline_s:g} s")
    return out


class Answers:
    """Answers kept in a folder, a file each, that is there whole or not at all."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        self.fs.create_dir(self.folder, recursive=True)

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name[:2]}/{name}"

    def read(self, name: str) -> str | None:
        if not self.fs.get_file_info(self._path(name)).is_file:
            return None
        with self.fs.open_input_stream(self._path(name)) as f:
            return f.read().decode()

    def write(self, name: str, said: str) -> None:
        self.fs.create_dir(f"{self.folder}/{name[:2]}", recursive=True)
        part = f"{self._path(name)}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(said.encode())
        self.fs.move(part, self._path(name))


def verdict(error: Column) -> Column:
    """null for no error; fatal for failed authentication; dlq for refused or too long inputs; fatal for the rest."""
    out = F.when(error.isNull(), None)
    for name, patterns in VERDICTS:
        out = out.when(error.rlike("(?i)" + "|".join(patterns)), name)
    return out.otherwise("fatal")


def answers(reqs: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, content) of what was answered; (label, error, verdict) of what was not."""
    rows = reqs.join(results, "request_id")
    bad = rows.where("error is not null").select("label", "error", verdict(F.col("error")).alias("verdict"))
    return rows.where("error is null").select("label", "content"), bad
