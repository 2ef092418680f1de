"""SQL equivalents of the named queries (DuckDB)."""

from __future__ import annotations

_FOLD = "strip_accents(lower({t}))"
_TOK = "regexp_extract_all(" + _FOLD + r", '[\p{{L}}\p{{N}}]+')"


def _bm25(source: str, terms: tuple, every: bool) -> str:
    """label, keyword_score over ``source(label, body)`` for terms of one token."""
    names = ", ".join(f"('{t}')" for t in terms)
    need = len(terms) if every else 1
    return f"""
 src AS ({source}), toks AS (SELECT label, {_TOK.format(t="body")} AS ts FROM src),
 stat AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM toks),
 post AS (SELECT label, len(ts) AS dl, tok, count(*) AS tf FROM (SELECT label, ts, unnest(ts) AS tok FROM toks) WHERE tok IN (SELECT * FROM (VALUES {names})) GROUP BY 1, 2, 3),
 df AS (SELECT tok, count(*) AS f FROM post GROUP BY 1),
 kw AS (SELECT label, round(sum(greatest(ln((n - f + 0.5) / (f + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS keyword_score
        FROM post JOIN df USING (tok), stat GROUP BY label HAVING count(*) >= {need})"""


def _phrases(phrases: tuple, every: bool) -> str:
    """The 20 best of documents (text, lang, source) for phrases: each column's tokens are joined with bars and phrases
    searched between them."""
    cols = [f"'|' || array_to_string({_TOK.format(t=c)}, '||') || '|'" for c in ("text", "lang", "source")]
    dl = " + ".join(f"len({_TOK.format(t=c)})" for c in ("text", "lang", "source"))
    times = [" + ".join(f"(len(string_split(c{k}, '|{'||'.join(p)}|')) - 1)" for k in range(3)) for p in phrases]
    tf = ", ".join(f"{x} AS t{i}" for i, x in enumerate(times))
    score = " + ".join(f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(phrases)))
    hit = (" AND " if every else " OR ").join(f"t{i} > 0" for i in range(len(phrases)))
    ns = ", ".join(f"count(*) FILTER (WHERE t{i} > 0) AS n{i}" for i in range(len(phrases)))
    return f"""WITH src AS (SELECT doc_id AS label, {dl} AS dl, {', '.join(f'{c} AS c{k}' for k, c in enumerate(cols))} FROM documents),
 f AS (SELECT label, dl, {tf} FROM src), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {ns} FROM f)
 """ + _top(f"SELECT label, round({score}, 6) AS keyword_score FROM f, st WHERE {hit}", "keyword_score", 20)


_ASKED = ("thing", "reading", "station")
_DOCS = "SELECT doc_id AS label, text AS body FROM documents"


def _top(rows: str, score: str, k: int) -> str:
    return f"SELECT label, {score}, row_number() OVER (ORDER BY {score} DESC, label) AS rank FROM ({rows}) QUALIFY rank <= {k}"


_SIM = """ sim AS (SELECT v.vec_id AS label, v.label AS level, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity
 FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q), near AS (SELECT * FROM sim WHERE similarity >= 0.35)"""
_EDGES = """ edges AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL
 SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"""


def _closure(nodes: str) -> str:
    return f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT node, node AS ancestor, 0 AS depth FROM ({nodes}) UNION ALL
 SELECT node, parent, depth + 1 FROM walk JOIN edges ON child = ancestor), clo AS (SELECT node, ancestor, min(depth) AS depth FROM walk GROUP BY 1, 2)"""


_WORD = r"'[^\s]+'"
_CHUNKS = "SELECT doc_id, text, unnest(range(0, greatest(length(text), 1)::BIGINT, 800)) AS s FROM documents"
_PARTS = r"""SELECT doc_id, p.x AS chunk, p.i - 1 AS chunk_index FROM (SELECT doc_id, unnest(list_transform(range(1, len(l) + 1), lambda i: {'x': l[i], 'i': i})) AS p
 FROM (SELECT doc_id, CASE WHEN len(f) = 0 THEN [''] ELSE f END AS l FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS f FROM documents)))"""
_CARD = r"\b(?:4[0-9]{3}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}|5[1-5][0-9]{2}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}|3[47][0-9]{1}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{3,4}|6(?:011|5[0-9]{2})[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4})\b"
_MAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
_PHONE = r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b"

_FOUND = f"""WITH v AS (SELECT 'required_field' AS violation_type, 'error' AS severity, doc_id::VARCHAR AS label, 'lang' AS field, 'no lang' AS message, sha256('required_field|' || doc_id || '||')[1:16] AS violation_id
 FROM documents WHERE doc_id % 9 = 0 OR lang IS NULL OR trim(lang) = '' UNION ALL
 SELECT 'pii', 'warning', doc_id::VARCHAR, 'content', split_part(x, '@', 1)[1:2] || '***@' || split_part(x, '@', 2), sha256('pii|' || doc_id || '|' || least('email', lower(trim(x))) || '|' || greatest('email', lower(trim(x))))[1:16]
 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS x FROM documents))
 """

# Queries of more than three words (all of benchmark): words of STOPWORDS and edge punctuation go, the rest are phrases of tokens.
_STOP = "a an the is are was were be been being do does did have has had i me my we you your he she it they them this that what which who whom how when where why and or but not no if of in on at to for with by from about into through so than too very can will just"
def _many(source: str, k: int) -> str:
    """CTEs up to ``best(item_id, doc_id, score, rank)`` for the queries of ``source(item_id, text)``."""
    return f"""WITH words AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[^\\s]+'), lambda w: replace(w, '"', '')), lambda w: w <> '') AS ws FROM ({source})),
 kept AS (SELECT item_id, CASE WHEN len(ws) <= 3 THEN ws ELSE list_filter(list_transform(ws, lambda w: rtrim(w, '?!.,;:')), lambda w: w <> '' AND NOT list_contains(string_split('{_STOP}', ' '), lower(w))) END AS ks, ws FROM words),
 q AS (SELECT item_id, i, {_TOK.format(t="w")} AS p FROM (SELECT item_id, unnest(range(1, len(u) + 1)) AS i, unnest(u) AS w FROM (SELECT item_id, CASE WHEN len(ks) = 0 THEN ws ELSE ks END AS u FROM kept))),
 terms AS (SELECT item_id, array_to_string(p, ' ') AS term, count(*) AS times FROM q WHERE len(p) > 0 GROUP BY ALL),
 toks AS (SELECT doc_id, {_TOK.format(t="text")} AS ts FROM documents), stat AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM toks),
 seen AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM toks),
 pairs AS (SELECT doc_id, dl, unnest(list_transform(range(1, dl), lambda i: ts[i] || ' ' || ts[i + 1])) AS term FROM (SELECT doc_id, ts, len(ts) AS dl FROM toks)),
 threes AS (SELECT doc_id, dl, unnest(list_transform(range(1, dl - 1), lambda i: ts[i] || ' ' || ts[i + 1] || ' ' || ts[i + 2])) AS term FROM (SELECT doc_id, ts, len(ts) AS dl FROM toks)),
 post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (FROM seen UNION ALL FROM pairs UNION ALL FROM threes) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
 df AS (SELECT term, count(*) AS f FROM post GROUP BY term),
 hit AS (SELECT item_id, doc_id, round(sum(times * greatest(ln((n - f + 0.5) / (f + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM terms JOIN post USING (term) JOIN df USING (term), stat GROUP BY ALL),
 best AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hit QUALIFY rank <= {k})"""



ORACLES: dict[str, str] = {
    "chunk_search": "WITH " + _bm25(f"SELECT doc_id || '-' || (s // 800) AS label, substring(text, s + 1, 1000) AS body FROM ({_CHUNKS})", _ASKED, False) + _top("SELECT * FROM kw", "keyword_score", 20),
    "transcript_assembly": r"""SELECT conv_id, 't-chat-' || conv_id AS label, count(*) AS message_count, sha256(string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) || chr(10)) AS artifact_id
 FROM conversations WHERE role IN ('user', 'assistant') AND regexp_matches(text, '\S') GROUP BY conv_id""",
    "turn_text_filter": r"SELECT role, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM conversations WHERE role IN ('user', 'assistant') AND regexp_matches(text, '\S') GROUP BY role",
    "text_stats": f"SELECT doc_id, len(regexp_extract_all(text, {_WORD})) AS word_count, len(string_split(text, chr(10))) AS n_lines FROM documents",
    "json_props": r"SELECT event_id, 'sha256:' || sha256(props) AS artifact_id, (props IS NULL OR NOT regexp_matches(props, '\S')) AS blank FROM events",
    "middle_cut": "SELECT doc_id, length(c) AS n, sha256(c) AS h FROM (SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substring(text, 1, 175) || chr(10) || '[...]' || chr(10) || right(text, 175) END AS c FROM documents)",
    "map_render": "SELECT doc_id, sha256('Summarise d-' || doc_id || ' (' || lang || '):' || chr(10) || text || chr(10) || 'd-' || doc_id) AS prompt_id FROM documents",
    "chunk_fixed": f"SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS chunk_total, s // 800 AS chunk_index, sha256(substring(text, s + 1, 1000)) AS h FROM ({_CHUNKS})",
    "chunk_separator": f"SELECT doc_id, chunk_index, sha256(chunk) AS h FROM ({_PARTS})",
    "chunk_labels": f"""SELECT doc_id, chunk_index, 'c-' || doc_id || '-' || h || CASE WHEN k > 0 THEN '-' || k ELSE '' END AS label FROM (
 SELECT doc_id, chunk_index, sha256(chunk)[1:8] AS h, row_number() OVER (PARTITION BY doc_id, sha256(chunk)[1:8] ORDER BY chunk_index) - 1 AS k FROM ({_PARTS}))""",
    "group_synthesis": "SELECT conv_id::VARCHAR AS group_key, 'g-' || conv_id AS label, count(*) AS input_count, sha256(string_agg('### ' || role || '-' || turn || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY conv_id",
    "group_on_missing": "SELECT coalesce(CASE WHEN lang = 'en' THEN NULL ELSE lang END, '_ungrouped') AS group_key, count(*) AS n FROM documents GROUP BY 1",
    "monthly_rollup": "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS episode_count FROM events GROUP BY 1, 2",
    "topical_rollup": f"SELECT topic, lang, count(*) AS n FROM (SELECT lang, {_TOK.format(t='text')} AS ts FROM documents), (VALUES ('thing'), ('station'), ('verlag')) v(topic) WHERE list_contains(ts, topic) GROUP BY 1, 2",
    "fold_accumulate": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) OVER w AS step, sum(l_quantity::DOUBLE) OVER w AS accumulated, max(l_quantity::DOUBLE) OVER w AS largest FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)",
    "merge_clusters": r"""WITH RECURSIVE tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ts FROM documents),
 st AS (SELECT doc_id, list_sort(list_distinct(ts || list_transform(range(1, len(ts)), lambda i: ts[i] || '_' || ts[i + 1]))) AS s FROM tk),
 rep AS (SELECT min(doc_id) AS r, s FROM st GROUP BY s), tok AS (SELECT r, len(s) AS n, unnest(s) AS t FROM rep),
 inter AS (SELECT a.r AS a, b.r AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM tok a JOIN tok b ON a.t = b.t AND a.r < b.r AND a.n >= 0.85 * b.n AND b.n >= 0.85 * a.n GROUP BY 1, 2),
 e AS (SELECT a, b FROM inter WHERE i / (na + nb - i) >= 0.85), e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 walk AS (SELECT r AS n, r AS m FROM rep UNION SELECT w.n, e2.b FROM walk w JOIN e2 ON w.m = e2.a),
 root AS (SELECT n, min(m) AS cluster FROM walk GROUP BY n), memb AS (SELECT st.doc_id, cluster FROM st JOIN rep ON st.s = rep.s JOIN root ON rep.r = root.n)
 SELECT doc_id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM memb""",
    "keyword_index": f"SELECT token, count(DISTINCT doc_id) AS n_docs, count(*) AS n_places FROM (SELECT doc_id, unnest({_TOK.format(t='text')}) AS token FROM documents) GROUP BY token",
    "benchmark_search": _many("SELECT item_id, text FROM benchmark", 5) + " SELECT * FROM best",
    "index_phrase": _phrases((("to", "thing"), ("of", "reading")), True),
    "index_phrase_or": _phrases((("of", "the"), ("fur",), ("en",), ("station",)), False),
    "index_folded": _phrases((("fur",), ("die",)), True),
    "index_columns": _phrases((("src3",), ("fr",)), True),
    "index_nothing": "SELECT doc_id AS label, 0.0::DOUBLE AS keyword_score, 0::BIGINT AS rank FROM documents LIMIT 0",
    "bm25_columns": _phrases((("of", "the"), ("src1",), ("fur",), ("station",), ("nothing",)), False),
    "bm25_and": "WITH " + _bm25(_DOCS, ("the", "on", "thing"), True) + _top("SELECT * FROM kw", "keyword_score", 20),
    "bm25_or": "WITH " + _bm25(_DOCS, _ASKED, False) + _top("SELECT * FROM kw", "keyword_score", 20),
    "bm25_layer": "WITH " + _bm25(_DOCS, _ASKED, False) + _top("SELECT * FROM kw WHERE label IN (SELECT doc_id FROM documents WHERE lang = 'fr')", "keyword_score", 20),
    "metadata_post_filter": "WITH " + _bm25(_DOCS, _ASKED, False) + "SELECT * FROM (" + _top("SELECT * FROM kw", "keyword_score", 20) + ") WHERE label IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "semantic_topk": "WITH " + _SIM + _top("SELECT label, round(similarity, 6) AS score FROM near", "score", 10),
    "semantic_topk_all": """WITH sim AS (SELECT q.vec_id AS query_id, v.vec_id AS label, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity
 FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0), r AS (SELECT query_id, label, round(similarity, 6) AS score FROM sim WHERE similarity >= 0.35)
 SELECT query_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rank FROM r QUALIFY rank <= 10""",
    "hybrid_rrf": "WITH " + _bm25(_DOCS, _ASKED, False) + "," + _SIM + ", k AS (SELECT label, row_number() OVER (ORDER BY keyword_score DESC, label) AS rank FROM kw WHERE label IN (SELECT vec_id FROM embeddings)), s AS (" + _top("SELECT label, round(similarity, 6) AS score FROM near", "score", 20) + "), f AS (SELECT label, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT label, rank FROM k UNION ALL SELECT label, rank FROM s) GROUP BY label)" + _top("SELECT * FROM f", "score", 10),
    "layered_search": "WITH " + _SIM + _top("SELECT label, round(similarity * (1 + CASE WHEN m = 0 THEN 0 ELSE level / m END), 6) AS score FROM near, (SELECT max(level) AS m FROM sim)", "score", 20),
    "lineage_closure": _closure("SELECT 'o' || o_orderkey AS node FROM orders") + " SELECT node, ancestor, depth::BIGINT AS depth FROM clo",
    "lineage_descendants": _closure("SELECT 'c' || c_custkey AS node FROM customer") + " SELECT ancestor, count(*) AS n_descendants FROM clo GROUP BY 1",
    "direct_children": "WITH " + _EDGES + " SELECT parent, count(DISTINCT child) AS n_children FROM edges GROUP BY 1",
    "build_diff": """SELECT * FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.text <> b.text THEN 'changed' END AS change
 FROM (SELECT doc_id, text FROM documents WHERE doc_id % 11 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0) b ON a.doc_id = b.doc_id) WHERE change IS NOT NULL""",
    "cache_split": "SELECT CASE WHEN doc_id % 4 = 0 THEN 'new' WHEN doc_id % 6 = 1 THEN 'stale' ELSE 'cached' END AS state, count(*) AS n FROM documents GROUP BY 1",
    "input_coverage": "SELECT source, count(*) AS uncovered FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source",
    "required_field": "SELECT doc_id AS label, 'lang' AS field FROM documents WHERE doc_id % 9 = 0 OR lang IS NULL OR trim(lang) = ''",
    "mutual_exclusion": "SELECT source, count(DISTINCT lang) AS n_values, min(lang) AS first_value FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1",
    "pii_violations": f"""SELECT doc_id, pattern, value, sha256(doc_id || ':' || pattern || ':' || value)[1:16] AS violation_id FROM (
 SELECT doc_id, 'credit_card' AS pattern, unnest(regexp_extract_all(text, '{_CARD}')) AS value FROM documents UNION ALL
 SELECT doc_id, 'email', unnest(regexp_extract_all(text, '{_MAIL}')) FROM documents UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(text, '{_PHONE}')) FROM documents)""",
    "queue_stats": "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_large, round(avg(value), 4) AS mean, max(ts)::VARCHAR AS newest FROM events GROUP BY event_type",
    "queue_position": "SELECT event_id, count(*) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING) AS position FROM events WHERE event_type = 'click'",
    "latest_version": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS latest, count(*) AS versions FROM events GROUP BY user_id",
    "layer_counts": "SELECT label, count(*) AS n, min(vec_id) AS first_id FROM embeddings GROUP BY label",
    "page_artifacts": "SELECT page_id, url, (SELECT count(*) FROM pages) AS total FROM (SELECT page_id, url FROM pages ORDER BY url, page_id LIMIT 20 OFFSET 20)",
    "ingest_dedup": "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1",
    "user_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
 SELECT user_id, min(ts)::VARCHAR AS started, count(*) AS n_events FROM s GROUP BY user_id, n""",
    "subsession_flush": "SELECT conv_id, turn, (coalesce(sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2)::BIGINT AS part FROM conversations",
    "heartbeat_health": """SELECT user_id, missed, CASE WHEN missed >= 3 THEN 'dead' WHEN missed >= 1 THEN 'suspect' ELSE 'healthy' END AS health FROM (
 SELECT user_id, floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts)))) / 86400)::BIGINT AS missed FROM events GROUP BY user_id)""",
    "citation_edges": "SELECT target_label, count(DISTINCT doc_id) AS n_sources FROM (SELECT doc_id, 'd-' || (doc_id % 50) AS target_label FROM documents UNION ALL SELECT doc_id, 'x~' || lang FROM documents) GROUP BY 1",
    "product_offer_join": "SELECT p_partkey, coalesce(n, 0)::BIGINT AS n_offers, largest FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, max(l_quantity)::DOUBLE AS largest FROM lineitem GROUP BY 1) ON p_partkey = l_partkey",
    "flat_file": "SELECT conv_id, 0::BIGINT AS part, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY conv_id",
    "prefix_resolution": "SELECT h[1:4] AS prefix, min(h) AS id FROM (SELECT DISTINCT sha256(text) AS h FROM documents) GROUP BY 1 HAVING count(*) = 1",
    "filename_title_slug": r"""SELECT doc_id, 'Note ' || upper(lang[1:1]) || lower(lang[2:]) || '  X.y' AS title, '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS day,
 '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || '-note_' || lang || '-x-y' AS slug FROM documents""",
    "fingerprint_inputs": "SELECT conv_id, sha256(string_agg(h, '|' ORDER BY h))[1:16] AS digest FROM (SELECT conv_id, sha256(concat_ws(':', turn, text)) AS h FROM conversations) GROUP BY conv_id",
    "explain_diff": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'lang,model' ELSE 'model' END AS changed FROM documents",
    "stale_artifacts": "SELECT o_orderkey AS child, o_custkey AS parent FROM orders WHERE o_custkey % 5 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "archive_sync_anti": "SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0",
    "pii_redaction": f"""SELECT doc_id, pattern, CASE pattern WHEN 'credit_card' THEN regexp_replace(value, '[\\s-]', '', 'g')[1:4] || '****' || right(value, 2)
 WHEN 'email' THEN split_part(value, '@', 1)[1:2] || '***@' || split_part(value, '@', 2) ELSE '***-***-' || right(value, 4) END AS shown,
 sha256(concat_ws('|', 'pii', doc_id, least(pattern, lower(trim(value))), greatest(pattern, lower(trim(value)))))[1:16] AS violation_id FROM (
 SELECT doc_id, 'credit_card' AS pattern, unnest(regexp_extract_all(text, '{_CARD}')) AS value FROM documents UNION ALL
 SELECT doc_id, 'email', unnest(regexp_extract_all(text, '{_MAIL}')) FROM documents UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(text, '{_PHONE}')) FROM documents)""",
    "plan_cost": """SELECT lang AS layer, count(*) FILTER (WHERE doc_id % 4 = 0) AS calls, count(*) FILTER (WHERE doc_id % 4 <> 0) AS cached, 2500 * count(*) FILTER (WHERE doc_id % 4 = 0) AS tokens,
 round(count(*) FILTER (WHERE doc_id % 4 = 0) * 0.0135::DOUBLE, 6) AS price FROM documents GROUP BY lang""",
    "verify_hashes": r"""SELECT "check", failed, failed = 0 AS passed FROM (SELECT 'content_hashes' AS "check", count(*) FILTER (WHERE doc_id % 10 = 0 AND text <> 'x') AS failed FROM documents
 UNION ALL SELECT 'contents', count(*) FILTER (WHERE text IS NULL OR NOT regexp_matches(text, '\S')) FROM documents UNION ALL SELECT 'labels', 0
 UNION ALL SELECT 'provenance', count(*) FROM (SELECT DISTINCT doc_id * 3 AS p FROM labels) WHERE p NOT IN (SELECT doc_id FROM documents))""",
    "dlq_summary": """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'fatal' WHEN value > 150 THEN 'dlq' WHEN value > 100 THEN 'fatal' END AS verdict FROM events)
 WHERE verdict IS NOT NULL GROUP BY 1""",
    "completion_replay": r"""WITH r AS (SELECT doc_id, 'Sum up: ' || coalesce(text, '') AS p, regexp_replace(replace('Sum up: ' || coalesce(text, ''), chr(13) || chr(10), chr(10)), '\s+$', '') AS k FROM documents),
 rec AS (SELECT k FROM r WHERE doc_id % 2 = 0 GROUP BY k) SELECT doc_id, CASE WHEN rec.k IS NULL THEN 'fatal' ELSE sha256(p[1:50]) END AS h FROM r LEFT JOIN rec ON r.k = rec.k""",
    "lineage_field_origin": _closure("SELECT 'c' || c_custkey AS node FROM customer") + """, named AS (SELECT 'n' || n_nationkey AS label, n_name AS value FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region)
 SELECT node, ancestor, depth::BIGINT AS depth, value FROM clo JOIN named ON ancestor = label""",
    "fold_resume": """WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber AS a, (l_orderkey % 3 <> 0 OR (l_linenumber > 1 AND l_orderkey % 2 = 0) OR (l_linenumber < 3 AND l_orderkey % 2 = 1)) AS seen FROM lineitem),
 g AS (SELECT l_orderkey, max(a) FILTER (WHERE seen) AS last, min(a) FILTER (WHERE NOT seen) AS first FROM r GROUP BY 1)
 SELECT l_orderkey, CASE WHEN l_orderkey % 7 = 0 THEN 'recompute' WHEN first IS NULL THEN 'unchanged' WHEN first > last THEN 'resume' ELSE 'recompute' END AS state FROM g""",
    "broadcast_pairs": "SELECT s_suppkey, h FROM supplier, (SELECT sha256(string_agg(r_name, chr(10) || chr(10) ORDER BY r_name)) AS h FROM region)",
    "core_synthesis": "SELECT coalesce(CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN source END, 'd-' || doc_id) AS heading, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "session_upsert": """WITH e AS (SELECT user_id, event_type, sha256(props) AS digest, event_id AS nth FROM events),
 t AS (SELECT user_id, event_type, arg_max(digest, nth) AS digest, max(nth) AS nth FROM e WHERE nth % 2 = 0 GROUP BY 1, 2),
 n AS (SELECT user_id, event_type, arg_max(digest, nth) AS digest, max(nth) AS nth FROM e WHERE nth % 2 = 1 AND digest NOT IN (SELECT digest FROM t) GROUP BY 1, 2)
 SELECT user_id, event_type, coalesce(n.digest, t.digest) AS digest, coalesce(n.nth, t.nth) AS nth, n.nth IS NULL AS processed FROM t FULL JOIN n USING (user_id, event_type)""",
    "layered_rrf": "WITH " + _bm25(_DOCS, _ASKED, False) + "," + _SIM + ", k AS (SELECT label, row_number() OVER (ORDER BY keyword_score DESC, label) AS rank FROM kw WHERE label IN (SELECT vec_id FROM embeddings)), s AS (" + _top("SELECT label, round(similarity * (1 + CASE WHEN m = 0 THEN 0 ELSE level / m END), 6) AS score FROM near, (SELECT max(level) AS m FROM sim)", "score", 20) + "), f AS (SELECT label, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT label, rank FROM k UNION ALL SELECT label, rank FROM s) GROUP BY label)" + _top("SELECT * FROM f", "score", 10),
    "search_snippet": r"""WITH p AS (SELECT doc_id, coalesce(text, '') AS t, strpos(lower(coalesce(text, '')), 'station') AS i FROM documents),
 w AS (SELECT doc_id, i, CASE WHEN i = 0 THEN t[1:200] ELSE substring(t, greatest(least(length(t), greatest(i - 101, 0) + 200) - 200, 0)::BIGINT + 1, 200) END AS x FROM p),
 e AS (SELECT doc_id, i, replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS x FROM w)
 SELECT doc_id, sha256(CASE WHEN i = 0 THEN x ELSE regexp_replace(x, '(station)', '<mark>\1</mark>', 'gi') END) AS h FROM e""",
    "map_synthesis": """SELECT 'sum-d-' || doc_id AS label, c AS content, 'sha256:' || sha256(c) AS artifact_id, 'sum_v4e9dff76' AS prompt_id, 'xx' AS lang, source, 'd-' || doc_id AS source_label
 FROM (SELECT doc_id, source, substring('Sum up d-' || doc_id || ' (document): ' || coalesce(text, ''), 1, 80) AS c FROM documents)""",
    "episode_summary": r"""SELECT 'ep-' || CASE WHEN conv_id % 2 = 0 THEN conv_id::VARCHAR ELSE 't-chat-' || conv_id END AS label, sha256(substring('Tell: ' || c, 1, 60)) AS h,
 CASE WHEN conv_id % 2 = 0 THEN '{"source_conversation_id":"' || conv_id || '","date":"2024-03-15","title":""}' ELSE '{"source_conversation_id":"t-chat-' || conv_id || '","date":"","title":"t"}' END AS metadata
 FROM (SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) || chr(10) AS c FROM conversations WHERE role IN ('user', 'assistant') AND regexp_matches(text, '\S') GROUP BY conv_id)""",
    "topical_fallback": f"""SELECT 'thing' AS topic, lang, count(*) AS n FROM (SELECT lang, {_TOK.format(t='text')} AS ts FROM documents) WHERE list_contains(ts, 'thing') GROUP BY 2
 UNION ALL SELECT 'no-such-words-anywhere', lang, count(*) FROM documents GROUP BY 2""",
    "fold_synthesis": """SELECT conv_id, 'start' || string_agg('|' || i || '/' || n || ':' || role, '' ORDER BY i) AS content, count(*) AS steps
 FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY conv_id""",
    "reduce_synthesis": """WITH RECURSIVE b AS (SELECT 'd-' || doc_id AS label, concat_ws(' ', lang, source) AS content FROM documents),
 r(lvl, nth, n, label, content) AS (SELECT 0, row_number() OVER (ORDER BY sha256(content), label) - 1, count(*) OVER (), label, content FROM b UNION ALL
 SELECT any_value(lvl) + 1, nth // 20, (max(n) + 19) // 20, 'reduce-' || any_value(lvl) || '-' || (nth // 20), sha256(string_agg('### ' || label || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY nth)) FROM r WHERE n > 1 OR lvl = 0 GROUP BY nth // 20)
 SELECT label, content FROM r WHERE n = 1 AND lvl > 0""",
    "chunk_metadata": f"SELECT 'd-' || doc_id AS label, (s // 800)::VARCHAR AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::VARCHAR AS chunk_total, 'own' AS lang FROM ({_CHUNKS})",
    "searchable_metadata": """SELECT 'd-' || doc_id AS label, '{"source":"' || source || '"}' AS metadata FROM documents""",
    "merged_sections": """SELECT source AS cluster, 0::BIGINT AS part, sha256(string_agg('--- Source: ' || doc_id || ' (customer: ' || lang || ') ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id)) AS h
 FROM documents GROUP BY source HAVING count(*) > 1""",
    "status_counts": "SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS processed, count(*) FILTER (WHERE event_type <> 'click') AS pending FROM events GROUP BY user_id",
    "as_of_version": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id <= 5000 GROUP BY user_id",
    "next_version": "SELECT user_id, max(event_id) + 1 AS next_version FROM events GROUP BY user_id",
    "newest_events": "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
    "prefix_lookup": """WITH a AS (SELECT 'd-' || doc_id AS label, sha256(coalesce(text, '')) AS h FROM documents),
 q AS (SELECT DISTINCT prefix FROM (SELECT 'd-' || (n_nationkey * 37) AS prefix FROM nation UNION ALL SELECT sha256(n_name)[1:3] FROM nation)),
 g AS (SELECT prefix, max(label) FILTER (WHERE label = prefix) AS e, count(*) FILTER (WHERE starts_with(label, prefix)) AS n1, min(label) FILTER (WHERE starts_with(label, prefix)) AS l1,
  count(*) FILTER (WHERE starts_with(h, prefix)) AS n2, min(label) FILTER (WHERE starts_with(h, prefix)) AS l2 FROM q, a GROUP BY prefix)
 SELECT prefix, CASE WHEN e IS NOT NULL THEN e WHEN n1 = 1 THEN l1 WHEN n1 = 0 AND n2 = 1 THEN l2 END AS label,
 CASE WHEN e IS NOT NULL OR n1 = 1 OR (n1 = 0 AND n2 = 1) THEN 'found' WHEN n1 > 1 OR n2 > 1 THEN 'ambiguous' ELSE 'absent' END AS state FROM g""",
    "parent_labels": """WITH n AS (SELECT coalesce(text, '') AS t, count(*) AS k, min('d-' || doc_id) AS name FROM documents GROUP BY 1)
 SELECT child, CASE WHEN bool_and(k = 1) THEN array_to_string(list_sort(list_distinct(list(name))), ',') ELSE '' END AS labels FROM (SELECT doc_id // 4 AS child, coalesce(text, '') AS t FROM documents) JOIN n USING (t) GROUP BY child""",
    "layer_listing": "SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(ts)::VARCHAR AS newest FROM events GROUP BY event_type",
    "dag_listing": """SELECT 'node' AS kind, lang AS source, NULL::VARCHAR AS target, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'node', 'core', NULL, 0 WHERE EXISTS (SELECT 1 FROM documents)
 UNION ALL SELECT DISTINCT 'edge', lang, 'core', NULL::BIGINT FROM documents""",
    "run_rollup": """SELECT event_type AS layer, count(*) FILTER (WHERE value > 50) AS artifacts, count(*) FILTER (WHERE value > 50 IS NOT TRUE) AS calls, sum(event_id % 7)::BIGINT AS tokens,
 round(sum(coalesce(value, 0)), 4) AS seconds FROM events GROUP BY event_type""",
    "files_by_extension": "SELECT CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '' ELSE '.jsonl' END AS extension, count(*) AS n, max(CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END)::BIGINT AS depth FROM documents GROUP BY 1",
    "previous_run": "SELECT run, state FROM (SELECT strftime(ts, '%Y-%m-%d') AS run, (count(*) % 5)::VARCHAR AS state FROM events GROUP BY 1) WHERE state <> '3' ORDER BY run DESC LIMIT 1",
    "inputs_cache_join": """WITH m AS (SELECT conv_id, string_agg(sha256(text), ',' ORDER BY sha256(text)) AS k FROM conversations GROUP BY conv_id)
 SELECT k IN (SELECT k FROM m WHERE conv_id % 3 <> 0) AS cached, count(*) AS n FROM m GROUP BY 1""",
    "search_check": "SELECT count(*) FILTER (WHERE doc_id % 10 = 0) AS missing, (SELECT count(*) FROM supplier) AS unexpected, count(*) FILTER (WHERE doc_id % 10 = 0) = 0 AND (SELECT count(*) FROM supplier) = 0 AS passed FROM documents",
    "merge_integrity": "SELECT source AS cluster, count(DISTINCT lang) AS n_values FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1",
    "closure_check": """SELECT doc_id AS label, 'missing' AS state FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0)
 UNION SELECT doc_id, 'unexpected' FROM documents WHERE doc_id % 4 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)""",
    "metadata_changes": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'lang: ' || lang || ' -> xx; ' ELSE '' END || 'model:  -> m; source: ' || source || ' -> ' AS changes FROM documents",
    "line_changes": """WITH o AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
 n AS (SELECT doc_id, unnest(string_split(CASE doc_id % 5 WHEN 0 THEN coalesce(text, '') || chr(10) || 'more' || chr(10) || 'more' WHEN 1 THEN 'other' ELSE coalesce(text, '') END, chr(10))) AS line FROM documents),
 d AS (SELECT doc_id, line, sum(s) AS d FROM (SELECT doc_id, line, 1 AS s FROM n UNION ALL SELECT doc_id, line, -1 FROM o) GROUP BY 1, 2 HAVING sum(s) <> 0)
 SELECT doc_id, sum(greatest(d, 0))::BIGINT AS added, sum(greatest(-d, 0))::BIGINT AS removed FROM d GROUP BY doc_id""",
    "mask_keys": r"""SELECT doc_id, sha256(regexp_replace(coalesce(text, '') || ' sk-abcdefghijklmnop' || doc_id || ' end', '\b((?:sk|pk|rk|ghp|gho|xox[abp])[-_])[A-Za-z0-9_-]{12,}([A-Za-z0-9_-]{4})\b', '\1****\2', 'g')) AS h FROM documents""",
    "validation_run": _FOUND + "SELECT * FROM v",
    "validation_summary": _FOUND + "SELECT count(*) AS n, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'error') = 0 AS passed FROM v",
    "semantic_conflicts": """SELECT label, CASE WHEN length(label) % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, '"A of ' || label || '" vs "B"' AS message,
 sha256('semantic_conflict|' || label || '|a of ' || label || '|b')[1:16] AS violation_id FROM (SELECT 'd-' || doc_id AS label FROM documents) WHERE label NOT LIKE '%7'""",
    "ungrounded_claims": """SELECT label, CASE WHEN bad THEN 'citation_check_failed' ELSE 'ungrounded_claim' END AS violation_type, CASE WHEN bad THEN 'Citation check failed for ' || label
 ELSE 'Ungrounded claim: ' || CASE WHEN label LIKE '%1' THEN 'lake://a, lake://b?s' ELSE '(none)?nothing' END END AS message
 FROM (SELECT label, label LIKE '%3' OR label LIKE '%7' AS bad FROM (SELECT 'd-' || doc_id AS label FROM documents))""",
    "fix_batch": _FOUND + """, g AS (SELECT label, count(DISTINCT violation_id) AS n_fixed, string_agg(DISTINCT '- ' || message, chr(10) ORDER BY '- ' || message) AS m FROM v GROUP BY label)
 SELECT label, n_fixed, sha256(substring('Mend ' || coalesce(text, '') || chr(10) || m, 1, 90)) AS h FROM g JOIN documents ON doc_id::VARCHAR = label""",
    "rebuild_required": "SELECT DISTINCT 'o' || o_orderkey AS label FROM orders WHERE o_custkey % 5 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)",
    "embedding_cache": "SELECT DISTINCT sha256('hash-64:' || coalesce(text, '')) AS content_hash, 64::BIGINT AS size FROM documents",
    "claim_batches": """WITH RECURSIVE sec AS (SELECT DISTINCT floor(epoch(ts))::BIGINT AS s FROM events), nx AS (SELECT s, min(s) OVER (ORDER BY s RANGE BETWEEN 600 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM sec),
 o AS (SELECT min(s) AS f FROM sec UNION ALL SELECT nxt FROM o JOIN nx ON s = f WHERE nxt IS NOT NULL),
 m AS (SELECT s, max(f) OVER (ORDER BY s) AS f FROM sec LEFT JOIN o ON f = s)
 SELECT strftime(make_timestamp(f * 1000000), '%Y-%m-%d %H:%M:%S') AS batch, count(*) AS n FROM events JOIN m ON floor(epoch(ts))::BIGINT = s GROUP BY f""",
    "queue_states": """WITH RECURSIVE m(e, a, b) AS (VALUES (0, 'pending', 'processing'), (1, 'processing', 'built'), (2, 'built', 'released'), (3, 'processing', 'failed'), (4, 'failed', 'pending')),
 r AS (SELECT user_id, event_id % 5 AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 w AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'pending' AS status, 0::BIGINT AS n_refused FROM events UNION ALL
  SELECT w.user_id, r.i, coalesce(m.b, w.status), w.n_refused + CASE WHEN m.b IS NULL THEN 1 ELSE 0 END FROM w JOIN r ON r.user_id = w.user_id AND r.i = w.i + 1 LEFT JOIN m ON m.e = r.e AND m.a = w.status)
 SELECT user_id, arg_max(status, i) AS status, max(n_refused) AS n_refused FROM w GROUP BY user_id""",
    "shown_keys": """SELECT doc_id, CASE WHEN length(k) <= 8 THEN '****' ELSE substring(k, 1, 4) || '...' || right(k, 4) END AS shown
 FROM (SELECT doc_id, substring('key-' || sha256(doc_id::VARCHAR), 1, doc_id % 14 + 1) AS k FROM documents)""",
    "pending_sessions": """SELECT 't-mesh-' || conv_id || CASE WHEN turn > 0 THEN '-sub' || lpad(turn::VARCHAR, 4, '0') ELSE '' END AS label, sha256(text) AS h, turn::VARCHAR AS seq FROM conversations WHERE turn % 3 <> 0 AND text IS NOT NULL""",
    "pii_ssn": r"""SELECT doc_id, value, '***-**-' || right(value, 4) AS shown FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, '') || chr(10) || 'ssn ' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || '-' ||
 lpad((doc_id % 100)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 7 * 1111)::VARCHAR, 4, '0') || ' and 666-11-2222 or 912-33-4444', '\b\d{3}-\d{2}-\d{4}\b')) AS value FROM documents)
 WHERE NOT (starts_with(value, '000') OR starts_with(value, '666') OR starts_with(value, '9') OR value[5:6] = '00' OR value[8:] = '0000')""",
    "batch_pending": r"""WITH r AS (SELECT doc_id, regexp_replace(replace('Sum up: ' || coalesce(text, ''), chr(13) || chr(10), chr(10)), '\s+$', '') AS k FROM documents)
 SELECT length(k) < 1000 AS short, count(*) AS n FROM (SELECT DISTINCT k FROM r WHERE k NOT IN (SELECT k FROM r WHERE doc_id % 3 = 0)) GROUP BY 1""",
    "chunk_custom": "SELECT doc_id, len(l) AS chunk_total, i - 1 AS chunk_index, sha256(l[i]) AS h FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, ', ') AS l FROM documents))",
    "surface_layers": "SELECT lang AS layer, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang",
    "shown_results": "SELECT doc_id, sha256(substring(coalesce(text, ''), 1, 500)) AS h, round(doc_id / 16, 3) AS score FROM documents",
    "json_fields": "SELECT props::JSON ->> '$.k' AS k, count(*) AS n FROM events GROUP BY 1",
}
ORACLES["fix_with_context"] = _many("SELECT doc_id AS item_id, substring(coalesce(text, ''), 1, 60) AS text FROM documents WHERE doc_id % 9 = 0 OR lang IS NULL OR trim(lang) = ''", 3) + """,
 ctx AS (SELECT item_id, string_agg(substring(coalesce(text, ''), 1, 100), chr(10) || chr(10) ORDER BY rank) AS c FROM best JOIN documents USING (doc_id) GROUP BY item_id)
 SELECT doc_id::VARCHAR AS label, 1::BIGINT AS n_fixed, sha256('- no lang|' || coalesce(c, '')) AS h FROM documents LEFT JOIN ctx ON item_id = doc_id WHERE doc_id % 9 = 0 OR lang IS NULL OR trim(lang) = ''"""
ORACLES["release_search"] = _many("SELECT item_id, text FROM benchmark", 3).replace("ORDER BY score DESC, doc_id", "ORDER BY score DESC, 'd' || doc_id") + """,
 e AS (SELECT DISTINCT 's' || source AS s, 'l' || lang AS l FROM documents)
 SELECT item_id, 'd' || doc_id AS label, rank, unnest(['d' || doc_id, 's' || source]) AS ancestor, unnest([0, 1])::BIGINT AS depth FROM best JOIN documents USING (doc_id) WHERE rank <= 3
 UNION ALL SELECT item_id, 'd' || doc_id, rank, l, 2 FROM best JOIN documents USING (doc_id) JOIN e ON s = 's' || source WHERE rank <= 3"""
_SIMS = """WITH sim AS (SELECT q.vec_id AS query_id, v.vec_id AS label, v.label AS level, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity
 FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0), near AS (SELECT * FROM sim WHERE similarity >= 0.35)"""
_NTH = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rank"
_LAYERED = "SELECT query_id, label, round(similarity * (1 + CASE WHEN m = 0 THEN 0 ELSE level / m END), 6) AS score FROM near, (SELECT max(label) AS m FROM embeddings)"
ORACLES["layered_search_all"] = _SIMS + f" SELECT *, {_NTH} FROM ({_LAYERED}) QUALIFY rank <= 20"


def _fused(near: str) -> str:
    return f"""{_SIMS}, {_bm25(_DOCS, _ASKED, False)}, k AS (SELECT label, row_number() OVER (ORDER BY keyword_score DESC, label) AS rank FROM kw WHERE label IN (SELECT vec_id FROM embeddings)),
 s AS (SELECT *, {_NTH} FROM ({near}) QUALIFY rank <= 20), q AS (SELECT DISTINCT query_id FROM s),
 f AS (SELECT query_id, label, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, label, rank FROM s UNION ALL SELECT query_id, label, rank FROM q, k) GROUP BY ALL)
 SELECT *, {_NTH} FROM f QUALIFY rank <= 10"""


ORACLES["hybrid_rrf_all"] = _fused("SELECT query_id, label, round(similarity, 6) AS score FROM near")
ORACLES["layered_rrf_all"] = _fused(_LAYERED)
ORACLES["index_update"] = ORACLES["keyword_index"]
ORACLES["merged_rows"] = ORACLES["merge_clusters"].replace("SELECT doc_id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM memb", """,
 m AS (SELECT memb.doc_id, cluster, s, source, text FROM memb JOIN st USING (doc_id) JOIN documents USING (doc_id)),
 pr AS (SELECT a.cluster, len(list_intersect(a.s, b.s)) AS i, len(a.s) AS x, len(b.s) AS y FROM m a JOIN m b ON a.cluster = b.cluster AND a.doc_id < b.doc_id),
 sc AS (SELECT cluster, round(avg(CASE WHEN x + y = i THEN 1 ELSE i / (x + y - i) END), 4) AS similarity_score FROM pr GROUP BY cluster)
 SELECT cluster, count(*) AS merge_count, count(DISTINCT source) AS n_customers, any_value(similarity_score) AS similarity_score,
 sha256(CASE WHEN count(*) = 1 THEN any_value(coalesce(text, '')) ELSE string_agg('--- Source: ' || doc_id || ' (customer: ' || source || ') ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id) END) AS h, string_agg(doc_id, ',' ORDER BY doc_id) AS sources
 FROM m LEFT JOIN sc USING (cluster) GROUP BY cluster""").replace("root.n)\n ,", "root.n),")
