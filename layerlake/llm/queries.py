"""The numbered corpus queries: thin digests of the operators' real outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binpack, chat, decontam, licenses, packing, phrases, quality, rules, sharding, simhash, spelling, suffixes, tokenbin
from .common import materialize, read


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(read(spark, sf_dir, "documents"), suffixes.BYTES)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_table(read(spark, sf_dir, "documents"))


def op4_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_digest(
        decontam.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    formatted = materialize(chat.format_conversations(rows.unionByName(more)), "chat")
    return chat.digest(formatted)


def op8_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op10_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(read(spark, sf_dir, "documents"), 8)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(read(spark, sf_dir, "documents"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.pack_best_fit(read(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_simhash_components,
        op3_token_blocks,
        op4_quality_score,
        op5_decontaminate,
        op6_quality_rules,
        op7_chat_format,
        op8_curve_packing,
        op9_license_scan,
        op10_balanced_shards,
        op11_phrase_collocations,
        op12_best_fit_packing,
        op13_spelling_variants,
    )
}
#: The other operators have no SQL: tests compare them with brute force, exact round trips or held-out labels.
ORACLES: dict[str, str] = {
    "op10_balanced_shards": r"""WITH tab AS (SELECT list(c ORDER BY i) AS l FROM (SELECT i, list_reduce([i] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) r(i))),
 b AS (SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS h, strlen(coalesce(text, '')) + 1 AS size FROM documents),
 u AS (SELECT h, any_value(t) AS t FROM b GROUP BY h),
 crc AS (SELECT h, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(c >> 8, l[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM u, tab),
 s AS (SELECT doc_id, h, size, (coalesce(sum(size) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, (sum(size) OVER ())::BIGINT AS total, row_number() OVER (ORDER BY h, doc_id) - 1 AS nth FROM b),
 g AS (SELECT *, min(start) OVER (PARTITION BY h) AS g0, (sum(size) OVER (PARTITION BY h))::BIGINT AS gs FROM s),
 p AS (SELECT *, least((CASE WHEN gs * 8 * 100 <= total THEN 2 * g0 + gs - 1 ELSE 2 * start + size - 1 END) * 8 // (2 * total), 7) AS shard FROM g)
 SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INT AS shard, nth - min(nth) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM p JOIN crc USING (h)""",
    "op11_phrase_collocations": r"""WITH b AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM b)),
 tot AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
 f AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) v(k)) GROUP BY ALL HAVING count(*) >= 10),
 c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM (SELECT lang, phrase, k AS m, f FROM f WHERE k >= 2)),
 s AS (SELECT c.lang, c.phrase, m, a, c.k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1 : m], ' ')),
 low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 inside AS (SELECT lang, p AS phrase, max(f) AS longer FROM (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS p FROM f WHERE k = 3) GROUP BY ALL)
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM low LEFT JOIN inside USING (lang, phrase) JOIN tot USING (lang)
 WHERE longer IS NULL OR m = 3 OR 100 * longer < 50 * a QUALIFY rank <= 2000""",
    "op13_spelling_variants": r"""WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS l FROM (SELECT i, list_reduce([i] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) r(i))),
 r AS (SELECT doc, w, count(*) AS c FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
 h AS (SELECT w, c, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(doc || ':' || w)), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(c >> 8, l[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM r, tab),
 v AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, c FROM h) WHERE length(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
 d AS (SELECT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
 p AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word UNION SELECT d.word, v.word FROM d JOIN v ON v.word = cut UNION SELECT v.word, d.word FROM d JOIN v ON v.word = cut),
 best AS (SELECT a, b, v.n AS bn, count(*) OVER (PARTITION BY a) AS n_near FROM p JOIN v ON v.word = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) = 1),
 f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 5 * n THEN b END AS form, CASE WHEN bn >= 5 * n THEN bn END AS form_n FROM v LEFT JOIN best ON a = word),
 walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
 SELECT f.word, form, root, n, n_near, form_n FROM f JOIN walk USING (word) WHERE root IN (SELECT word FROM f WHERE form IS NULL)""",
}
