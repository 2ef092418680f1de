"""Spelling variants: words one edit apart, found by running automata over tries."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, gathered, materialize, text_of

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Letters of the words of a trie (a longer word is a trie of its own): a trie takes some 10 bytes a letter.
TRIE_LETTERS = 1_000_000
#: Letters of the tries that are sent to the tasks at once.
ROUND_LETTERS = 4_000_000
#: Words whose automata a task runs together.
BLOCK = 4_000


def _count_words(batches, least_length: int, every: int):
    """word, n: a task's words are added up in a table that is written whenever it is full."""
    table: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        lowered = pc.ascii_lower(b.column("text"))
        for i, doc in enumerate(b.column("doc").to_pylist()):
            seed = zlib.crc32(f"{doc}:".encode())
            for w, n in Counter(RUN.findall(lowered[i].as_py())).items():
                if len(w) >= least_length:
                    h = zlib.crc32(w.encode(), seed)
                    if not h % every:
                        w = w[: h % len(w)] + w[h % len(w) + 1 :]
                        if len(w) < least_length:
                            continue
                    table[w] += n
            if len(table) > 400_000:
                yield out()
                table.clear()
    if table:
        yield out()


def word_counts(docs: DataFrame, least_length: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """word, n: lower-cased runs of letters of all texts, after the noise that deletes a letter from one (document, run) in
    ``every``; those of ``least_length`` letters and ``least`` occurrences."""
    rows = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("doc"), text_of(docs).alias("text"))
    counted = rows.mapInArrow(lambda it: _count_words(it, least_length, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Trie:
    """Sorted words of Latin-1 letters in flat arrays. Nodes are numbered by depth, then in word order, so a node's children
    are neighbours: ``first`` and ``size`` say which, ``letter`` is the letter that leads to a node, ``word`` the word that ends there."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.words, self.n = words, np.asarray(counts, np.int64)
        raw = "".join(words).encode("latin-1")
        letters = np.frombuffer(raw, np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        shared = np.zeros(len(words), np.int64)  # letters shared with the word before
        at = np.arange(1, len(words))
        while len(at):
            d = shared[at]
            at = at[(d < size[at]) & (d < size[at - 1])]
            d = shared[at]
            at = at[letters[start[at] + d] == letters[start[at - 1] + d]]
            shared[at] += 1
        fresh = size - shared  # nodes that a word adds
        base = np.cumsum(fresh) - fresh
        owner = np.repeat(np.arange(len(words)), fresh)
        depth = np.arange(len(owner)) - base[owner] + shared[owner] + 1
        order = np.argsort(depth, kind="stable")
        number = np.empty(len(owner) + 1, np.int64)  # of the nodes in word order; the root comes first
        number[0] = 0
        number[1 + order] = 1 + np.arange(len(order))
        bounds = np.searchsorted(depth[order], np.arange(1, (depth.max() if len(depth) else 0) + 2))
        parent = np.zeros(len(owner) + 1, np.int64)
        for d in range(1, len(bounds) - 1):  # a node's parent is the last node before it that is one less deep
            above, below = order[bounds[d - 1] : bounds[d]], order[bounds[d] : bounds[d + 1]]
            parent[1 + bounds[d] : 1 + bounds[d + 1]] = 1 + bounds[d - 1] + np.searchsorted(above, below) - 1
        self.letter = np.zeros(len(owner) + 1, np.int64)
        self.letter[1:] = letters[(start[owner] + depth - 1)[order]]
        self.size = np.bincount(parent[1:], minlength=len(parent))
        self.first = 1 + np.cumsum(self.size) - self.size
        self.edge = parent[1:] * 256 + self.letter[1:]  # ascending: finds a child by its letter
        self.word = np.full(len(parent), -1, np.int64)
        ends = base + fresh - 1
        self.word[number[1 + ends]] = np.arange(len(words))

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child by each letter, -1 where there is none."""
        want = node * 256 + letter
        at = np.minimum(np.searchsorted(self.edge, want), len(self.edge) - 1)
        return np.where(self.edge[at] == want, at + 1, -1)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): word j of the trie is one edit from ``words[i]``.

        The automata of all words go down together, depth first: a state that has used its edit is followed to its end
        before the states without one go a letter deeper."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.append(np.frombuffer("".join(words).encode("latin-1"), np.uint8), 0).astype(np.int64)
        start = np.cumsum(size) - size
        found = []

        def follow(q, node, at):
            """Accepts what is left of the words exactly."""
            while len(q):
                over = at == size[q]
                hit = self.word[node[over]]
                found.append(np.stack([q[over], hit])[:, hit >= 0])
                q, node, at = q[~over], node[~over], at[~over]
                node = self.step(node, letters[start[q] + at])
                there = node >= 0
                q, node, at = q[there], node[there], at[there] + 1

        q, node, at = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        while len(q):
            more = at < size[q]
            here = letters[start[q] + np.minimum(at, size[q])]
            # of a run of equal letters the last is left out, and a letter is put in after its like: each edit is met once
            left = more & ((at + 1 >= size[q]) | (letters[start[q] + np.minimum(at + 1, size[q])] != here))
            follow(q[left], node[left], at[left] + 1)
            n = self.size[node]
            each = np.repeat(np.arange(len(q)), n)
            child = np.repeat(self.first[node] - np.cumsum(n) + n, n) + np.arange(len(each))
            same = more[each] & (self.letter[child] == here[each])
            other = ~same
            follow(q[each[other]], child[other], at[each[other]])  # put in
            other &= more[each]
            follow(q[each[other]], child[other], at[each[other]] + 1)  # replaced
            q, node, at = q[each[same]], child[same], at[each[same]] + 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j = np.divmod(np.unique(np.concatenate([f[0] * len(self.words) + f[1] for f in found])), len(self.words))
        return i, j


def _shards(batches, most: int):
    """first, letters, words, counts: neighbouring words of a sorted partition, up to ``most`` letters together (or one word)."""
    held: list[str] = []
    counts: list[int] = []
    letters = 0

    def out():
        names = ["first", "letters", "words", "counts"]
        return pa.RecordBatch.from_arrays(
            [pa.array([held[0]]), pa.array([letters], pa.int64()), pa.array(["\n".join(held)], pa.string()), pa.array([np.array(counts, np.int64).tobytes()], pa.binary())], names=names
        )

    for b in batches:
        for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
            if held and letters + len(w) > most:
                yield out()
                held, counts, letters = [], [], 0
            held.append(w)
            counts.append(n)
            letters += len(w)
    if held:
        yield out()


def _neighbours(batches, shards):
    """word, n_near, form, form_n: how many words of the tries are near, and the most frequent (then first) of them."""
    tries = [Trie(w.split("\n"), np.frombuffer(n, np.int64)) for w, n in shards.value]
    for b in gathered(batches, BLOCK * 1000, BLOCK):
        block = b.column("word").to_pylist()
        n_near, form_n = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
        form: list[str | None] = [None] * len(block)
        for t in tries:  # ascending, so the first of equal counts stays
            i, j = t.near(block)
            n_near += np.bincount(i, minlength=len(block))
            order = np.lexsort([j, -t.n[j], i])
            i, j = i[order], j[order]
            best = np.flatnonzero(np.diff(i, prepend=-1))
            i, j = i[best], j[best]
            better = t.n[j] > form_n[i]
            form_n[i[better]] = t.n[j[better]]
            for x, y in zip(i[better].tolist(), j[better].tolist()):
                form[x] = t.words[y]
        at = pa.array(np.flatnonzero(n_near))
        yield pa.RecordBatch.from_arrays(
            [pa.array(block, pa.string()).take(at), pa.array(n_near).take(at), pa.array(form, pa.string()).take(at), pa.array(form_n).take(at)], names=["word", "n_near", "form", "form_n"]
        )


def near_words(words: DataFrame, trie_letters: int = TRIE_LETTERS, round_letters: int = ROUND_LETTERS) -> DataFrame:
    """word, n_near, form, form_n of each of ``words(word, n)`` that has near ones; ``form`` is the most frequent of them.

    Sorted words are cut into tries of at most ``trie_letters`` letters (or one word). Tries of ``round_letters`` letters are
    broadcast at a time, whatever the number of words; each word's automaton is run over all tries of the round,
    and leaves those after a few steps whose words begin otherwise. A round's result is a table; the rounds are reduced."""
    spark = words.sparkSession
    ordered = words.repartitionByRange("word").sortWithinPartitions("word")
    shards = materialize(ordered.mapInArrow(lambda it: _shards(it, trie_letters), "first string, letters long, words string, counts binary"), "tries")
    rounds: list[list[str]] = []
    room = 0
    for r in shards.select("first", "letters").orderBy("first").toLocalIterator():  # one row for a million letters
        if not rounds or r.letters > room:
            rounds.append([])
            room = round_letters
        rounds[-1].append(r.first)
        room -= r.letters
    kind = "word string, n_near long, form string, form_n long"
    out = None
    for firsts in rounds:
        held = shards.where(F.col("first").between(firsts[0], firsts[-1])).select("first", "words", "counts").orderBy("first").collect()
        sent = spark.sparkContext.broadcast([(r.words, bytes(r.counts)) for r in held])
        part = words.select("word").repartition("word").mapInArrow(lambda it, sent=sent: _neighbours(it, sent), kind)
        part = materialize(part, "near")
        sent.unpersist()
        out = part if out is None else out.unionByName(part)
    drop(shards)
    if out is None:
        return spark.createDataFrame([], kind)
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), "form"))
    return out if len(rounds) == 1 else out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.*")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of ``forms(word, form)``: the last word that forms lead to. Each round follows twice as many steps; counts
    grow along the way, so it ends."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        new = materialize(now.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        drop(now)
        now = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return now


def spelling_variants(docs: DataFrame, least_length: int = 6, least: int = 5, every: int = 199, times: int = 5) -> DataFrame:
    """Groups the words of ``docs(doc_id, text)`` by their most frequent spelling: word, form, root, n, n_near, form_n.

    Two words are near if they differ by exactly one inserted, deleted or replaced letter; a word's form is its most frequent
    near word (ties: the smallest) if that occurs ``times`` as often, and its root is where forms end.

    Null text: no words. Null doc_id: named by the empty string in the noise. Repeated rows: each counts. Very long texts and
    words: whole. Empty table, texts without words: no rows. Other columns are ignored, whatever their names."""
    words = materialize(word_counts(docs, least_length, least, every), "words")
    near = near_words(words)
    rows = materialize(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(F.col("form_n") >= times * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")]
        ),
        "forms",
    )
    ends = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
