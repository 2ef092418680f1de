"""Phrases whose words occur together more often than apart: suffix counting in one sorted pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BitFilter, gathered, materialize, release_memory, text_of, tidy

#: Bytes of text that a task looks at together; equal rows of it are counted before they are shuffled.
CHUNK = 2_000_000
#: A word with at least this share of all words (so there are at most 1,000 of them) is dealt by its whole suffix.
HOT_SHARE = 1000
SPACE, NOTHING, LINE = (pa.scalar(x, pa.large_string()) for x in (" ", "", "\n"))
BREAK = r"[.,;:!?\x0A-\x0D]"


class Words:
    """The words of a table of ``lang, text``: ``ids`` into ``words`` in text order, -1 between pieces and after each text,
    with the ``lang`` (id into ``langs``) of each."""

    def __init__(self, t: pa.Table):
        langs = t.column("lang").combine_chunks().dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        text = pc.ascii_lower(t.column("text").combine_chunks().cast(pa.large_string()))
        text = pc.replace_substring(pc.replace_substring_regex(text, BREAK, " \n "), "\t", " ")
        text = pc.binary_join_element_wise(text, LINE, SPACE)  # one more break, after the text
        cut = pc.split_pattern(text, " ")
        coded = cut.flatten().dictionary_encode()
        ids, offsets, self.words = coded.indices.to_numpy(), cut.offsets.to_numpy(), coded.dictionary
        lang = np.repeat(langs.indices.to_numpy(), np.diff(offsets))
        blank, mark = (pc.index(self.words, x).as_py() for x in ("", "\n"))
        there = ids != blank
        self.ids, self.lang = ids[there], lang[there]
        self.ids[self.ids == mark] = -1

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (lang, word) as lang * number of words + word, how often each occurs, and each place's index (-1: a break)."""
        at = np.flatnonzero(self.ids >= 0)
        pair, place, count = np.unique(self.lang[at].astype(np.int64) * len(self.words) + self.ids[at], return_inverse=True, return_counts=True)
        which = np.full(len(self.ids), -1, np.int32)
        which[at] = place
        return pair, count, which


def _count_words(batches):
    """lang, word, n of each chunk."""
    for t in gathered(batches, CHUNK):
        w = Words(t)
        pair, count, _ = w.pairs()
        lang, word = np.divmod(pair, max(len(w.words), 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(w.langs, pa.string()).take(pa.array(lang)), w.words.take(pa.array(word)).cast(pa.string()), pa.array(count, pa.int64())], names=["lang", "word", "n"]
        )
        del w, pair, count, lang, word
        release_memory()


def _suffixes(batches, max_n: int, keys: BitFilter, hot: set):
    """lang, word, rest (the words after it, each with a space behind), n, hot: the distinct suffixes of a chunk, cut to ``max_n``
    words and at words that are surely too rare."""
    for t in gathered(batches, CHUNK):
        w = Words(t)
        pair, _, which = w.pairs()
        lang, word = np.divmod(pair, max(len(w.words), 1))
        names = w.words.take(pa.array(word)).to_pylist()
        seeds = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w.langs]
        hashes = np.fromiter((xxhash.xxh64_intdigest(x.encode(), seeds[i]) for x, i in zip(names, lang.tolist())), np.uint64, len(names))
        may = np.append(keys.passes(hashes.view(np.int64)), False)
        ids = np.where(may[which], which, -1)  # which = -1 takes the last entry
        first = np.flatnonzero(ids >= 0)
        if not len(first):
            continue
        base, code, here = len(names) + 1, ids[first], np.ones(len(first), bool)
        columns = [code]
        for j in range(1, max_n):
            nxt = first + j
            follows = here & (nxt < len(ids))
            follows[follows] = ids[nxt[follows]] >= 0
            here = follows
            columns.append(np.where(here, ids[np.minimum(nxt, len(ids) - 1)], base - 1))
        group = columns[0].astype(np.int64)
        for j in range(1, max_n):  # equal numbers: equal suffixes
            group = group * base + columns[j]
            if j < max_n - 1 and int(group.max()) > (1 << 62) // base:
                group = np.unique(group, return_inverse=True)[1]
        _, at, count = np.unique(group, return_index=True, return_counts=True)
        spaced = pa.array([x + " " for x in names] + [""], pa.large_string())
        rest = pc.binary_join_element_wise(*[spaced.take(pa.array(c[at])) for c in columns[1:]], NOTHING).cast(pa.string())
        one = columns[0][at]
        is_hot = np.fromiter(((w.langs[i], x) in hot for i, x in zip(lang.tolist(), names)), bool, len(names))
        table = pa.table(
            [pa.array(w.langs, pa.string()).take(pa.array(lang[one])), pa.array(names, pa.string()).take(pa.array(one)), rest, pa.array(count, pa.int64()), pa.array(is_hot[one])],
            names=["lang", "word", "rest", "n", "hot"],
        )
        del w, which, ids, first, columns, group, at, spaced, rest, one
        yield from table.to_batches(max_chunksize=20_000)
        del table
        release_memory()


class Stack:
    """Counts all prefixes of suffixes that come in reverse-lexicographic order (those of a first word by language): the open prefix of each length is kept with its
    count; where a word changes, it and all longer ones are done. A batch is one push: its runs of equal
    prefixes are summed together, and only the last of each length stays open."""

    def __init__(self, max_n: int):
        self.max_n = max_n
        self.open: list[tuple[str, str, int, bool] | None] = [None] * max_n  # lang, prefix, count, hot by length

    def push(self, t: pa.Table) -> list[tuple]:
        n = t.column("n").to_numpy()
        lang, first = t.column("lang").combine_chunks(), t.column("word").combine_chunks().cast(pa.large_string())
        hot = t.column("hot").combine_chunks().to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(t.column("rest").combine_chunks().cast(pa.large_string()), " ")
        at, flat = cut.offsets.to_numpy(), cut.flatten()
        words = np.diff(at)  # with the first; the last space leaves an empty part
        change = np.ones(len(n), bool)
        change[1:] = pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)
        done, prefix = [], None
        for k in range(1, self.max_n + 1):
            has = words >= k
            word = first if k == 1 else flat.take(pa.array(at[:-1] + np.minimum(k - 2, words - 1)))  # where there is none: the empty part
            prefix = word if prefix is None else pc.binary_join_element_wise(prefix, word, SPACE)
            change = change.copy()
            change[1:] |= pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(change)
            sums = np.add.reduceat(n, starts)
            keep = has[starts]
            ended = self.open[k - 1]
            same = ended and keep[0] and (lang[0].as_py(), prefix[0].as_py()) == ended[:2]
            if same:
                sums[0] += ended[2]
            elif ended:
                done.append((k, [ended[0]], [ended[1]], [ended[2]], [ended[3]]))
            self.open[k - 1] = None
            if keep[-1]:
                i = int(starts[-1])
                self.open[k - 1] = (lang[i].as_py(), prefix[i].as_py(), int(sums[-1]), bool(hot[i]))
                keep[-1] = False
            i = starts[keep]
            done.append((k, lang.take(pa.array(i)), prefix.take(pa.array(i)), sums[keep], hot[i]))
        return done

    def close(self) -> list[tuple]:
        return [(k + 1, [o[0]], [o[1]], [o[2]], [o[3]]) for k, o in enumerate(self.open) if o]


def _count_prefixes(batches, max_n: int, least: int):
    """lang, words, phrase, f: prefixes with ``least`` occurrences, and those that other tasks may count too (prefixes of hot
    words that are shorter than the longest)."""
    stack = Stack(max_n)

    def out(done):
        for k, lang, prefix, count, hot in done:
            count = np.asarray(count, np.int64)
            keep = count >= least
            if k < max_n:
                keep |= np.asarray(hot, bool)
            i = pa.array(np.flatnonzero(keep))
            cols = [pa.array(lang, pa.string()).take(i), pa.array(np.full(len(i), k, np.int32)), pa.array(prefix, pa.large_string()).take(i).cast(pa.string()), pa.array(count).take(i)]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "words", "phrase", "f"])

    for t in gathered(batches, CHUNK, 50_000):
        yield from out(stack.push(t))
    yield from out(stack.close())


def count_phrases(docs: DataFrame, max_n: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases of up to ``max_n`` words with ``least`` occurrences, and (lang, n) of all words.

    Words are counted first: suffixes end at words too rare to be in any such phrase (a bit table of the others, sized by
    their number, is sent to the tasks; what it lets through wrongly is only counted for nothing). Suffixes are added up for
    each chunk of text, dealt by language and first word (those of hot first words by all their words), sorted
    reverse-lexicographically where they arrive, and their prefixes counted with one stack."""
    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), text_of(docs).alias("text"))
    counted = rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialize(counted.where("word is not null"), "words")
    totals = materialize(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    frequent = words.where(F.col("n") >= least)
    keys = BitFilter(frequent.select(F.xxhash64("lang", "word").alias("h")), "h")
    total = totals.agg(F.sum("n")).first()[0] or 0
    hot = {(r.lang, r.word) for r in frequent.where(F.col("n") * HOT_SHARE >= total).collect()}  # at most HOT_SHARE rows
    suffixes = rows.mapInArrow(lambda it: _suffixes(it, max_n, keys, hot), "lang string, word string, rest string, n long, hot boolean")
    # there are more rows than the text has words: smaller parts than usual are sorted
    parts = 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = suffixes.repartition(parts, "lang", "word", F.when(F.col("hot"), F.col("rest")))
    counts = dealt.sortWithinPartitions(F.desc("word"), "lang", F.desc("rest")).mapInArrow(tidy(lambda it: _count_prefixes(it, max_n, least)), "lang string, words int, phrase string, f long")
    spark = docs.sparkSession
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    small = [spark.conf.get(x) for x in names]
    for x, value in zip(names, ("10000", str(CHUNK))):  # rows of a few words; the same plan reads whole texts, which the bytes bound
        spark.conf.set(x, value)
    try:
        phrases = materialize(counts.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "phrases")
    finally:
        for x, value in zip(names, small):
            spark.conf.set(x, value)
    return phrases, totals


def mine_phrases(docs: DataFrame, max_n: int = 3, least: int = 10, keep: int = 2000, absorb: int = 50) -> DataFrame:
    """The ``keep`` best collocations of each language: lang, rank, phrase, a, l, r, n, score.

    A candidate has 2 to ``max_n`` words and ``a >= least`` occurrences. Its score is that of its weakest cut into two parts,
    floor(1000000 * a * a / (l * r)), in decimals of 38 digits. A candidate inside a longer one with at least ``absorb``
    percent of its occurrences goes. Parts are joined afterwards by (lang, phrase); the counts of hot single words, of which
    there are at most 1,000, are broadcast, so they are no join key.

    Null text: no words. Null lang: ``und``. Null doc_id, repeated rows: rows as any other. Very long texts: whole. Texts without
    words, empty table: no rows. Ties: score, then a, then phrase in byte order. Other columns are ignored, whatever their
    names."""
    phrases, totals = count_phrases(docs, max_n, least)
    total = totals.agg(F.sum("n")).first()[0] or 0
    hot = phrases.where((F.col("words") == 1) & (F.col("f") * HOT_SHARE >= total)).select("lang", F.col("phrase").alias("part"), F.col("f").alias("hot_f"))
    part = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    candidates = phrases.where("words >= 2").withColumnRenamed("f", "a")
    ws = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))

    def joined(rows, side, value):
        rows = rows.withColumn("part", side).join(F.broadcast(hot), ["lang", "part"], "left")
        rows = rows.withColumn("part", F.when(F.col("hot_f").isNull(), F.col("part")).otherwise(F.col("phrase")))
        return rows.join(part, ["lang", "part"]).withColumn(value, F.coalesce("hot_f", "part_f")).drop("part", "hot_f", "part_f")

    cuts = joined(cuts, F.array_join(F.slice(ws, F.lit(1), F.col("k")), " "), "l")
    cuts = joined(cuts, F.array_join(F.slice(ws, F.col("k") + 1, F.col("words")), " "), "r")
    score = F.expr("(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000BD) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").alias("score")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # what lies inside a longer candidate
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    longer = candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * longer < {absorb} * a"))
    rows = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
