"""Search: postings, BM25, cosine, rank fusion. Corpus statistics are global; filters come after scoring."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, PLAIN, search_tokens

# Words dropped from longer queries.
STOPWORDS = set(
    "a an the is are was were be been being do does did have has had i me my we you your he she it they them this that what which "
    "who whom how when where why and or but not no if of in on at to for with by from about into through so than too very can will just".split()
)


def folded(word: str) -> list[str]:
    """The index's tokens of a word, as ``search_tokens`` makes them of a text."""
    return re.findall(r"[^\W_]+", word.lower().translate(str.maketrans(ACCENTED[: len(PLAIN)], PLAIN, ACCENTED[len(PLAIN) :])))


def parse_query(query: str, any_word: bool = False) -> tuple[list[list[str]], bool]:
    """Phrases (tokens that must follow each other; most are of one), and whether all must occur: up to three words AND,
    more OR without stopwords. Words without letters or digits are dropped; a query of such words finds nothing. With ``any_word`` (for
    excerpts of texts, which nobody typed) one word is always enough."""
    words = [w for w in (w.replace('"', "") for w in query.split()) if w]
    every = len(words) <= 3
    if not every:
        kept = [w for w in (w.rstrip("?!.,;:") for w in words) if w and w.lower() not in STOPWORDS]
        words, every = (kept, False) if kept else (words, True)
    return [p for p in map(folded, words) if p], every and not any_word


def _score(rows: DataFrame, n_phrases: int, every: bool, stats: DataFrame) -> DataFrame:
    """label, keyword_score of ``rows(label, dl, t0, t1, ...)``: a phrase's frequency in each row; ``stats(n, avgdl, n0,
    n1, ...)`` is one row."""
    score, match = F.lit(0.0), None
    for i in range(n_phrases):
        idf = F.greatest(F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(1e-6))
        t = F.col(f"t{i}")
        score = score + idf * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
        hit = t > 0
        match = hit if match is None else (match & hit) if every else (match | hit)
    return rows.where(match).join(F.broadcast(stats)).select("label", F.round(score, 6).alias("keyword_score"))


def _nothing(docs: DataFrame, label: str) -> DataFrame:
    return docs.select(F.col(label).alias("label"), F.lit(0.0).alias("keyword_score")).limit(0)


def _times(ts, phrase: list[str]):
    """How often a phrase occurs in an array of tokens."""
    if len(phrase) == 1:
        return F.size(ts) - F.size(F.array_remove(ts, phrase[0]))
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ts) - len(phrase), F.lit(0))), lambda i: _all(F.get(ts, i + k) == t for k, t in enumerate(phrase)))
    return F.when(F.size(ts) >= len(phrase), F.size(at)).otherwise(0)


def _all(conditions):
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return F.coalesce(out, F.lit(False))


def bm25(docs: DataFrame, label: str, text: str | list[str], query: str) -> DataFrame:
    """label, keyword_score of the rows that match, without an index. ``text`` names the searched columns (all weigh
    alike; a phrase lies in one of them). Frequencies are counted where a row lies, so nothing but matching rows is
    shuffled. Null texts have no tokens; a query without tokens finds nothing."""
    columns = [text] if isinstance(text, str) else list(text)
    phrases, every = parse_query(query)
    if not phrases:
        return _nothing(docs, label)

    def of(*ts):
        dl = sum((F.size(t) for t in ts[1:]), F.size(ts[0]))
        return F.struct(dl.alias("dl"), *[sum((_times(t, p) for t in ts[1:]), _times(ts[0], p)).alias(f"t{i}") for i, p in enumerate(phrases)])

    # one generated row keeps the tokenizer from being evaluated again in the filter and for each term
    tokens = F.array(F.struct(*[F.coalesce(search_tokens(F.col(c)), F.array().cast("array<string>")).alias(f"c{i}") for i, c in enumerate(columns)]))
    counts = F.transform(tokens, lambda x: of(*[x[f"c{i}"] for i in range(len(columns))]))
    rows = docs.select(F.col(label).alias("label"), F.inline(counts))
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"n{i}") for i in range(len(phrases))])
    return _score(rows, len(phrases), every, stats)


def surface(layers: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """The rows of the declared layers with ``layer``; an error where one of them is not there yet."""
    absent = [n for n in names if n not in layers]
    if absent:
        raise ValueError(f"layers not ready: {', '.join(absent)}")
    out = None
    for n in names:
        part = layers[n].withColumn("layer", F.lit(n))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def top(df: DataFrame, score: str, k: int) -> DataFrame:
    """The ``k`` best rows with their 1-based rank; ties go by label. Ranked after the limit."""
    best = df.orderBy(F.desc(score), "label").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "label")).cast("long"))


def ranked(df: DataFrame, score: str) -> DataFrame:
    """label, rank of every row: range partitions by (score, label) are numbered on their own, and only their sizes meet in
    one place, so neither the list nor rows of one score are in one task."""
    spread = df.select("label", score).repartitionByRange(F.desc(score), "label").sortWithinPartitions(F.desc(score), "label")
    rows = spread.select("label", F.spark_partition_id().alias("_p"), (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("_i")).checkpoint()
    before = rows.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return rows.join(F.broadcast(before), "_p").select("label", (F.col("_b") + F.col("_i") + 1).cast("long").alias("rank"))


def _dot(x, y):
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm_of(x):
    return F.sqrt(_dot(x, x))


def cosine(a, b, norm_b=None):
    """0 for a zero vector. ``norm_b``: the length of ``b`` where it is known."""
    norm = norm_of(a) * (norm_of(b) if norm_b is None else norm_b)
    return F.when(norm == 0, 0.0).otherwise(_dot(a, b) / norm)


def semantic(vectors: DataFrame, label: str, vector: str, query: DataFrame, least: float = 0.35) -> DataFrame:
    """label, similarity of rows at least ``least`` like the query vector (one row, broadcast; ``vectors.Cells`` takes many).
    More than one query row is an error."""
    one = query.limit(2).agg(F.first(vector).alias("_q"), F.count("*").alias("_c")).where("_c > 0")
    one = one.select(F.when(F.col("_c") > 1, F.raise_error(F.lit("one query row is asked for"))).otherwise(F.col("_q")).alias("_q"))
    q = F.broadcast(one.select("_q", norm_of(F.col("_q")).alias("_n")))
    sim = vectors.join(q).select(F.col(label).alias("label"), *[c for c in vectors.columns if c not in (label, vector)], cosine(F.col(vector), F.col("_q"), F.col("_n")).alias("similarity"))
    return sim.where(F.col("similarity") >= least)


def layered(vectors: DataFrame, label: str, vector: str, level: str, query: DataFrame, least: float = 0.35, boost: float = 1.0) -> DataFrame:
    """label, score: similarity times 1 + boost * level / highest level. The highest level is that of all rows, also of those
    under ``least``; where it is 0 it counts as 1."""
    high = vectors.agg(F.max(level).alias("_m"))
    near = semantic(vectors, label, vector, query, least).join(F.broadcast(high))
    high = F.when(F.coalesce("_m", F.lit(0)) == 0, 1).otherwise(F.col("_m"))
    return near.select("label", F.round(F.col("similarity") * (1 + boost * F.col(level) / high), 6).alias("score"))


def fuse(*ranked: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (label, rank)."""
    rows = None
    for r in ranked:
        part = r.select("label", (1.0 / (k + F.col("rank"))).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("label").agg(F.round(F.sum("s"), 6).alias("score"))


def cut(results: DataFrame, content: str = "content", score: str = "score") -> DataFrame:
    """Results as shown: contents of up to 500 characters, scores of three places."""
    return results.withColumn(content, F.substring(content, 1, 500)).withColumn(score, F.round(score, 3))


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def snippet(content, query: str, size: int = 200):
    """``size`` characters around the first place where a word of ``query`` occurs, HTML-escaped, words in ``<mark>``."""
    words = sorted(query.split(), key=len, reverse=True)
    if not words:
        return _escaped(F.substring(content, 1, size))
    any_of = "(?iu)" + "|".join(re.escape(w) for w in words)
    shown = "(?iu)" + "|".join(re.escape(_html(w)) for w in words)
    at = F.regexp_instr(content, F.lit(any_of))
    end = F.least(F.length(content), F.greatest(at - 1 - size // 2, F.lit(0)) + size)
    window = F.substring(content, F.greatest(end - size, F.lit(0)) + 1, F.lit(size))
    marked = F.regexp_replace(_escaped(window), shown, "<mark>$0</mark>")
    return F.when(at == 0, _escaped(F.substring(content, 1, size))).otherwise(marked)


def _html(word: str) -> str:
    import html

    return html.escape(word)


def line_snippet(content, query: str, head: int = 4, around: int = 2):
    """The first ``head`` lines and ``around`` lines on both sides of each line with a word of ``query``; blocks with a gap of one line
    are joined, others set apart by ``...``; words are in ``**``."""
    words = [w for w in query.lower().split() if w]
    lines = F.split(content, r"\r\n|\r|\n", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    if not words:
        first = F.array_join(F.slice(lines, 1, 2 * head), "\n")
        return F.concat(first, F.when(F.size(lines) > 2 * head, "\n...").otherwise(""))

    def has(line):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(line), F.lit(w))
        return hit

    def shown(line):
        for w in words:
            line = F.regexp_replace(line, "(?iu)" + re.escape(w), "**$0**")
        return line

    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    hits = F.transform(F.filter(numbered, lambda r: has(r["x"])), lambda r: r["i"])
    near = F.filter(numbered, lambda r: (r["i"] < head) | F.exists(hits, lambda h: F.abs(h - r["i"]) <= around))
    gap = F.filter(numbered, lambda r: F.exists(near, lambda n: n["i"] == r["i"]) | (F.exists(near, lambda n: n["i"] == r["i"] - 1) & F.exists(near, lambda n: n["i"] == r["i"] + 1)))
    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<string>").alias("out"))
    body = F.aggregate(
        gap, start,
        lambda a, r: F.struct(r["i"].alias("last"), F.concat(a["out"], F.when((a["last"] >= 0) & (r["i"] > a["last"] + 1), F.array(F.lit("..."))).otherwise(F.array().cast("array<string>")), F.array(shown(r["x"]))).alias("out")),
    )
    tail = F.when(body["last"] < F.size(lines) - 1, "\n...").otherwise("")
    return F.concat(F.array_join(body["out"], "\n"), tail)


def embed(texts: DataFrame, text: str, encode, model: str = "hash-64", cache: DataFrame | None = None) -> DataFrame:
    """content_hash, embedding of each distinct text: hashes of (model, text) that ``cache(content_hash, embedding)`` holds are not
    encoded again. ``encode`` takes a list of texts to a list of vectors and runs in tasks, batch by batch."""
    import pyarrow as pa

    key = F.sha2(F.concat_ws(":", F.lit(model), F.coalesce(F.col(text), F.lit(""))), 256)
    asked = texts.select(key.alias("content_hash"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["content_hash"])
    fresh = asked if cache is None else asked.join(cache.select("content_hash"), "content_hash", "left_anti")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("content_hash"), pa.array(encode(b.column("text").to_pylist()), pa.list_(pa.float32()))], names=["content_hash", "embedding"])

    new = fresh.mapInArrow(run, "content_hash string, embedding array<float>")
    return new if cache is None else new.unionByName(cache.join(asked.select("content_hash"), "content_hash", "left_semi").select("content_hash", "embedding"))


def hash_vectors(texts: list[str], size: int = 64) -> list[list[float]]:
    """The deterministic default encoder: signed counts of hashed words."""
    out = []
    for t in texts:
        v = [0.0] * size
        for w in re.findall(r"[^\W_]+", t.lower()):
            h = zlib.crc32(w.encode())
            v[h % size] += 1.0 if h >> 16 & 1 else -1.0
        out.append(v)
    return out


def citations(df: DataFrame, label: str, content: str, scheme: str = "lake") -> DataFrame:
    """source_label, target_label of each ``scheme://label`` in the contents, once."""
    found = F.explode(F.regexp_extract_all(F.col(content), F.lit(f"(?:{scheme})" + r"://([\w.~-]+)"), F.lit(1)))
    return df.select(F.col(label).alias("source_label"), found.alias("target_label")).distinct()


def run(docs: DataFrame, label: str, text: str, query: str, mode: str = "keyword", k: int = 10, vectors: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """One search in a mode: keyword, semantic, hybrid or layered (the last two: keyword where no vectors are given; layered
    over a table of vectors without rows finds nothing). ``vectors(label, embedding)``, with ``level`` for layered; ``asked(embedding)``. Returns label, score, rank."""
    if mode not in ("keyword", "semantic", "hybrid", "layered"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "semantic" and vectors is None:
        raise ValueError("semantic search needs vectors")
    words = None
    if mode != "semantic":
        words = bm25(docs, label, text, query).withColumnRenamed("keyword_score", "score")
        if mode == "keyword" or vectors is None:
            return top(words, "score", k)
    if mode == "layered":
        if not vectors.limit(1).count():
            return top(words.limit(0), "score", k)
        near = layered(vectors, "label", "embedding", "level", asked)
    else:
        near = semantic(vectors, "label", "embedding", asked).select("label", F.round("similarity", 6).alias("score"))
    if mode == "semantic":
        return top(near, "score", k)
    return top(fuse(ranked(words, "score"), top(near, "score", 2 * k)), "score", k)
