"""DuckDB SQL of the registered queries."""

from . import file_oracles, patch_oracles, vault_oracles

_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"


def _bm25(words: int) -> str:
    return f"""
q0 AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS t FROM benchmark),
q1 AS (SELECT item_id, u.term, min(u.k) AS k FROM q0, unnest(t) WITH ORDINALITY AS u(term, k) GROUP BY item_id, u.term),
q2 AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY k) AS r FROM q1),
q AS (SELECT item_id, term, count(*) OVER (PARTITION BY item_id) AS wanted FROM q2 WHERE r <= {words}),
tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
size AS (SELECT doc_id, len(t) AS dl FROM tok),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM size),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
hits AS (
  SELECT q.item_id, p.doc_id, q.wanted, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5) / (df + 0.5)) END
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, sum(tf)::BIGINT AS dot, count(*) AS got
  FROM q JOIN post p USING (term) JOIN dfs USING (term) JOIN size s ON s.doc_id = p.doc_id CROSS JOIN stats GROUP BY q.item_id, p.doc_id, q.wanted),
bm AS (SELECT * FROM hits WHERE got = wanted)"""


def _any_term(words: int | None) -> str:
    """All pages that share a term with the query: of its first distinct terms, or of all its terms as often as they occur."""
    pick = f"SELECT item_id, term, 1 AS qtf FROM q2 WHERE r <= {words}" if words else "SELECT item_id, term, qtf FROM q2"
    return f"""
q0 AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS t FROM benchmark),
q1 AS (SELECT item_id, u.term, min(u.k) AS k, count(*) AS qtf FROM q0, unnest(t) WITH ORDINALITY AS u(term, k) GROUP BY item_id, u.term),
q2 AS (SELECT item_id, term, qtf, row_number() OVER (PARTITION BY item_id ORDER BY k) AS r FROM q1),
q3 AS ({pick}),
q AS (SELECT item_id, term, qtf, count(*) OVER (PARTITION BY item_id) AS wanted, sqrt(sum(qtf * qtf) OVER (PARTITION BY item_id)) AS qnorm FROM q3),
tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
size AS (SELECT doc_id, len(t) AS dl FROM tok),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM size),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
hits AS (
  SELECT q.item_id, p.doc_id, q.wanted, q.qnorm, sum(qtf * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5) / (df + 0.5)) END
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, sum(qtf * tf)::BIGINT AS dot, count(*) AS got
  FROM q JOIN post p USING (term) JOIN dfs USING (term) JOIN size s ON s.doc_id = p.doc_id CROSS JOIN stats GROUP BY q.item_id, p.doc_id, q.wanted, q.qnorm),
bm AS (SELECT * FROM hits WHERE got = wanted),
best AS (SELECT item_id, max(score) AS best FROM bm GROUP BY item_id),
norm AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM post GROUP BY doc_id),
both_of AS (SELECT item_id, doc_id, CASE WHEN got = wanted THEN floor(least(1, greatest(0, score / best)) * 1e3 + 0.5) / 1e3 ELSE 0::DOUBLE END AS bm25,
  floor(least(1, greatest(0, dot / (norm * qnorm))) * 1e3 + 0.5) / 1e3 AS cosine FROM hits LEFT JOIN best USING (item_id) JOIN norm USING (doc_id)),
mix AS (SELECT * FROM (SELECT *, floor((0.65::DOUBLE * bm25 + 0.35::DOUBLE * cosine) * 1e3 + 0.5) / 1e3 AS score FROM both_of) WHERE score > 0),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM mix)"""


_SEARCH = """
found AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM bm))"""

_HYBRID = """
best AS (SELECT item_id, max(score) AS best FROM bm GROUP BY item_id),
norm AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM post GROUP BY doc_id),
both_of AS (SELECT item_id, doc_id, floor(least(1, greatest(0, score / best)) * 1e3 + 0.5) / 1e3 AS bm25,
  floor(least(1, greatest(0, dot / (norm * sqrt(wanted)))) * 1e3 + 0.5) / 1e3 AS cosine FROM bm JOIN best USING (item_id) JOIN norm USING (doc_id)),
mix AS (SELECT *, floor((0.65::DOUBLE * bm25 + 0.35::DOUBLE * cosine) * 1e3 + 0.5) / 1e3 AS score FROM both_of),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM mix)"""

_LEDGER = """
led0 AS (SELECT 'page_' || lpad(user_id::VARCHAR, 12, '0') AS page_id, event_id AS seq, ts, epoch_us(ts) AS us, event_type AS e, value, event_id % 50 AS k,
  CASE event_type WHEN 'view' THEN (['ci:github-actions', 'ci:build', 'agent:claude-code', 'agent:helper', 'test:unit', 'bot'])[event_id % 6 + 1] WHEN 'purchase' THEN (['human:reader', 'human:editor', 'runbook-exec', 'test:integration'])[event_id % 4 + 1] END AS actor FROM events),
led AS (SELECT *, CASE e WHEN 'signup' THEN 'added' WHEN 'view' THEN 'verified' WHEN 'purchase' THEN 'verified' WHEN 'error' THEN 'contradicted' WHEN 'click' THEN CASE WHEN k = 0 THEN 'superseded' WHEN k = 1 THEN 'override' WHEN k <= 6 THEN 'removed' ELSE 'checkpoint' END ELSE 'checkpoint' END AS kind FROM led0),
w AS (SELECT page_id, sum(l.w) AS weight, count(*) AS source_count FROM (
  SELECT page_id, seq % 5 AS s, max_by({'there': kind = 'added', 'w': least(1.0, greatest(0.0, value / 500))}, (ts, seq)) AS l FROM led WHERE kind IN ('added', 'removed') GROUP BY page_id, s) WHERE l.there GROUP BY page_id),
ver AS (SELECT page_id, us, ts, CASE WHEN actor LIKE 'human:%' THEN ['human', '5', '0'] WHEN actor = 'ci:github-actions' THEN [actor, '3', '14'] WHEN actor LIKE 'ci:%' THEN ['ci', '2', '14'] WHEN actor = 'agent:claude-code' THEN [actor, '2', '7'] WHEN actor LIKE 'agent:%' THEN ['agent', '1', '7']
  WHEN actor = 'runbook-exec' THEN [actor, '4', '0'] WHEN actor = 'test:integration' THEN [actor, '4', '0'] WHEN actor = 'test:unit' THEN [actor, '2', '14'] WHEN seq % 12 = 5 THEN ['agent', '1', '7'] ELSE ['unpatterned', '1', '7'] END AS r FROM led WHERE kind = 'verified'),
bo AS (SELECT page_id, sum(r[2]::BIGINT) FILTER (ts >= TIMESTAMP '2024-01-02') AS cents, max(us) FILTER (r[3] = '0') AS last_free FROM ver GROUP BY page_id),
sp AS (SELECT page_id, max(last) AS last_spaced FROM (SELECT page_id, r, list_reduce(list(DISTINCT us ORDER BY us), lambda a, x: CASE WHEN x - a >= r[3]::BIGINT * 86400000000 THEN x ELSE a END) AS last FROM ver WHERE r[3] <> '0' GROUP BY page_id, r) GROUP BY page_id),
s AS (SELECT page_id, max(us) FILTER (kind NOT IN ('added', 'removed', 'verified')) AS last_other, max(us) AS last_event,
  count(*) FILTER (e = 'error' AND value > 100) AS majors, count(*) FILTER (e = 'error' AND NOT value > 100) AS minors, count(*) FILTER (kind = 'superseded') AS sups,
  max_by(least(1.0, greatest(0.0, value / 100)), (ts, seq)) FILTER (kind = 'override') AS base FROM led GROUP BY page_id),
j AS (SELECT *, greatest(last_free, last_spaced) AS ver_us, coalesce(greatest(last_free, last_spaced, last_other), last_event) AS anchor_us FROM s LEFT JOIN w USING (page_id) LEFT JOIN bo USING (page_id) LEFT JOIN sp USING (page_id)),
k AS (SELECT *, 1 - exp(-coalesce(weight, 0) / 1.5) AS st, least(0.6, majors * 0.35::DOUBLE + minors * 0.10::DOUBLE + sups * 0.6::DOUBLE) AS pe, least(0.25, coalesce(cents, 0) / 100) AS bo,
  (1 - pow(2.0, -greatest(0, (epoch_us(TIMESTAMP '2024-02-01') - anchor_us) / 86400000000.0) / 120.0)) * 0.30 AS de FROM j),
sc AS (SELECT *, least(1, greatest(0, coalesce(base, 0.25) + st - pe - de + bo)) AS free FROM k),
state AS (SELECT page_id, floor(CASE WHEN sups > 0 THEN least(free, 0.3) ELSE free END * 1e4 + 0.5) / 1e4 AS score, floor(st * 1e4 + 0.5) / 1e4 AS source_strength,
  floor(pe * 1e4 + 0.5) / 1e4 AS contradiction_penalty, floor(de * 1e4 + 0.5) / 1e4 AS time_decay, floor(bo * 1e4 + 0.5) / 1e4 AS verification_boost,
  coalesce(source_count, 0)::BIGINT AS source_count, (majors + minors)::BIGINT AS contradiction_count,
  ver_us // 1000000 AS last_verified_at, anchor_us // 1000000 AS anchor, sups > 0 AS superseded FROM sc),
major AS (SELECT page_id, max(ts) AS major_at FROM led WHERE e = 'error' AND value > 100 GROUP BY page_id),
fresh AS (SELECT page_id, floor(exp(-d / 180) * 1e4 + 0.5) / 1e4 AS freshness, floor(exp(-d / 30) * 1e4 + 0.5) / 1e4 AS access_recency
  FROM (SELECT page_id, greatest(0, (epoch_us(TIMESTAMP '2024-02-01') - max(us)) / 86400000000.0) AS d FROM led GROUP BY page_id))"""

_AT_LAST = (
    _LEDGER.replace("led AS (SELECT *, CASE e", "led AS (SELECT *, max(ts) OVER (PARTITION BY page_id) AS lts, CASE e").replace("SELECT page_id, us, ts, CASE WHEN actor", "SELECT page_id, us, ts, lts, CASE WHEN actor")
    .replace("ts >= TIMESTAMP '2024-01-02'", "ts >= lts - INTERVAL 30 DAY").replace("(epoch_us(TIMESTAMP '2024-02-01') - anchor_us)", "(last_event - anchor_us)")
)
_OLD = _LEDGER.replace("FROM events)", "FROM events WHERE ts < TIMESTAMP '2024-01-15')", 1).replace("2024-01-02", "2023-12-16").replace("2024-02-01", "2024-01-15")
_LATE = _LEDGER.replace("FROM events)", "FROM events WHERE event_id % 3 <> 0)", 1)
_UNITED = _LEDGER.replace("FROM events)", "FROM events WHERE event_id % 3 = 0 OR event_id % 2 = 0)", 1)

ORACLES = {
    "decay_checkpoints": f"""WITH be AS (WITH {_AT_LAST} SELECT page_id, score AS be FROM state), af AS (WITH {_LEDGER} SELECT page_id, score AS af FROM state),
la AS (WITH {_LEDGER} SELECT page_id, max(us) AS last_us, max(us) FILTER (kind = 'checkpoint') AS cp FROM led GROUP BY page_id),
du AS (SELECT *, page_id || ':decay:2024-02-01T00:00:00.000Z' AS name FROM la JOIN be USING (page_id) JOIN af USING (page_id)
  WHERE cp IS NULL OR epoch_us(TIMESTAMP '2024-02-01') - cp >= 14 * 86400000000 OR (be >= 0.7 AND af < 0.7) OR (be >= 0.5 AND af < 0.5) OR (be >= 0.3 AND af < 0.3)),
h AS (SELECT *, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(name, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (xor(a, c) * 16777619) & 4294967295) AS h FROM du),
v AS (SELECT *, CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END AS v FROM h)
SELECT 'evt_' || lpad(array_to_string(list_transform(range(6, -1, -1), lambda k: substr('0123456789abcdefghijklmnopqrstuvwxyz', ((v // (36 ** k)::BIGINT) % 36 + 1)::INT, 1)), ''), 12, '0') AS id, page_id, TIMESTAMP '2024-02-01' AS ts, 'decay_checkpoint' AS kind,
  (epoch_us(TIMESTAMP '2024-02-01') - last_us) / 86400000000.0::DOUBLE AS days_since_last_event, floor(greatest(0, be - af) * 1e4 + 0.5) / 1e4 AS applied_decay FROM v""",
    "freshest_confidence": f"""WITH st AS (WITH {_OLD} SELECT state.page_id, score, s.last_event FROM state JOIN s USING (page_id)), nw AS (WITH {_LATE} SELECT page_id, score AS fresh, s.last_event AS ledger_us FROM state JOIN s USING (page_id)),
j AS (SELECT *, ledger_us IS NOT NULL AND (last_event IS NULL OR ledger_us > last_event) AS folded FROM st FULL JOIN nw USING (page_id))
SELECT page_id, CASE WHEN folded THEN fresh ELSE score END AS score, make_timestamp(CASE WHEN folded THEN ledger_us ELSE last_event END) AS last_event_at, folded FROM j""",
    "united_confidence": f"WITH {_UNITED} SELECT * FROM state",
    "bm25_search": f"WITH {_bm25(2)}, {_SEARCH} SELECT item_id, doc_id, score, rank FROM found WHERE rank <= 10",
    "hybrid_search": f"WITH {_bm25(2)}, {_HYBRID} SELECT item_id, doc_id, bm25, cosine, score, rank FROM hybrid WHERE rank <= 10",
    "hybrid_any_term": f"WITH {_any_term(2)} SELECT item_id, doc_id, bm25, cosine, score, rank FROM hybrid WHERE rank <= 10",
    "ranked_search": f"""WITH {_bm25(2)}, {_HYBRID}, {_LEDGER},
fin AS (SELECT item_id, doc_id, floor((0.55::DOUBLE * h.score + 0.25::DOUBLE * coalesce(st.score, 0.7) + 0.10::DOUBLE * coalesce(freshness, 0.5) + 0.10::DOUBLE * coalesce(access_recency, 0.5)) * 1e4 + 0.5) / 1e4 AS final_score,
  array_to_string(list_filter([CASE WHEN st.score < 0.5 THEN 'NEEDS_REVIEW' END, CASE WHEN major_at >= TIMESTAMP '2024-01-02' THEN 'RECENTLY_CONTRADICTED' END, CASE WHEN (epoch(TIMESTAMP '2024-02-01') - last_verified_at) / 86400 > 240 THEN 'STALE' END], lambda f: f IS NOT NULL), ',') AS flags
  FROM hybrid h LEFT JOIN state st ON st.page_id = 'page_' || lpad(h.doc_id::VARCHAR, 12, '0') LEFT JOIN fresh f ON f.page_id = st.page_id LEFT JOIN major m ON m.page_id = st.page_id WHERE NOT coalesce(superseded, false) AND h.rank <= 100)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY final_score DESC, doc_id) AS rank FROM fin) WHERE rank <= 10""",
    "ranked_whole_text": f"""WITH {_any_term(None)}, {_LEDGER},
fin AS (SELECT item_id, doc_id, floor((0.55::DOUBLE * h.score + 0.25::DOUBLE * coalesce(st.score, 0.7) + 0.10::DOUBLE * coalesce(freshness, 0.5) + 0.10::DOUBLE * coalesce(access_recency, 0.5)) * 1e4 + 0.5) / 1e4 AS final_score,
  array_to_string(list_filter([CASE WHEN st.score < 0.5 THEN 'NEEDS_REVIEW' END, CASE WHEN major_at >= TIMESTAMP '2024-01-02' THEN 'RECENTLY_CONTRADICTED' END, CASE WHEN (epoch(TIMESTAMP '2024-02-01') - last_verified_at) / 86400 > 240 THEN 'STALE' END], lambda f: f IS NOT NULL), ',') AS flags
  FROM hybrid h LEFT JOIN state st ON st.page_id = 'page_' || lpad(h.doc_id::VARCHAR, 12, '0') LEFT JOIN fresh f ON f.page_id = st.page_id LEFT JOIN major m ON m.page_id = st.page_id WHERE NOT coalesce(superseded, false))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY final_score DESC, doc_id) AS rank FROM fin) WHERE rank <= 10""",
    "retrieval_eval": f"""WITH rel AS (WITH {_bm25(6)} SELECT item_id, doc_id FROM bm), {_bm25(2)}, {_SEARCH},
h AS (SELECT item_id, count(*) AS hits FROM found JOIN rel USING (item_id, doc_id) WHERE rank <= 10 GROUP BY item_id),
n AS (SELECT item_id, count(*) AS relevant FROM rel GROUP BY item_id)
SELECT item_id, relevant, coalesce(hits, 0) AS hits, floor(coalesce(hits, 0) / 10 * 1e4 + 0.5) / 1e4 AS precision, floor(coalesce(hits, 0) / relevant * 1e4 + 0.5) / 1e4 AS recall FROM n LEFT JOIN h USING (item_id)""",
    "bm25_whole_text": f"WITH {_any_term(None)}, {_SEARCH} SELECT item_id, doc_id, score, rank FROM found WHERE rank <= 10",
    "hybrid_whole_text": f"WITH {_any_term(None)} SELECT item_id, doc_id, bm25, cosine, score, rank FROM hybrid WHERE rank <= 10",
    "retrieval_eval_whole_text": f"""WITH rel AS (WITH {_any_term(None)} SELECT item_id, doc_id FROM bm), {_bm25(2)}, {_SEARCH},
h AS (SELECT item_id, count(*) AS hits FROM found JOIN rel USING (item_id, doc_id) WHERE rank <= 10 GROUP BY item_id),
n AS (SELECT item_id, count(*) AS relevant FROM rel GROUP BY item_id)
SELECT item_id, relevant, coalesce(hits, 0) AS hits, floor(coalesce(hits, 0) / 10 * 1e4 + 0.5) / 1e4 AS precision, floor(coalesce(hits, 0) / relevant * 1e4 + 0.5) / 1e4 AS recall FROM n LEFT JOIN h USING (item_id)""",
    "term_norms": f"""WITH post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY doc_id, term)
SELECT doc_id, count(*) AS n_terms, floor(sqrt(sum(tf * tf)) * 1e4 + 0.5) / 1e4 AS norm FROM post GROUP BY doc_id""",
    "content_hash": """SELECT 'page_' || lpad(doc_id::VARCHAR, 12, '0') AS page_id, sha256(coalesce(text, '')) AS content_hash,
ceil((length(coalesce(text, '')) + length(regexp_replace(coalesce(text, ''), '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4.0)::BIGINT AS tokens FROM documents""",
    "duplicate_pages": """SELECT sha256(trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '(?s)^---.*?---\\s*', ''), '^# [^\\n]*\\n+', ''), '[^a-z0-9]+', ' ', 'g'))) AS fingerprint, min(doc_id) AS first_doc, count(*) AS copies
FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "source_rollup": """SELECT source, count(*) AS pages, count(quality) AS labelled, floor(avg(quality) * 1e4 + 0.5) / 1e4 AS quality, coalesce(sum(toxic), 0)::BIGINT AS toxic
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
    "confidence_state": f"WITH {_LEDGER} SELECT * EXCLUDE (superseded) FROM state",
    "page_freshness": f"WITH {_LEDGER} SELECT * FROM fresh",
    "active_contradictions": f"""WITH {_LEDGER}, v AS (SELECT page_id, max((ts, seq)) AS v FROM led WHERE kind IN ('verified', 'superseded') GROUP BY page_id)
SELECT page_id, count(*) AS active, max(CASE WHEN value > 100 THEN us END) // 1000000 AS latest_major FROM led LEFT JOIN v USING (page_id) WHERE e = 'error' AND (v IS NULL OR (ts, seq) > v) GROUP BY page_id""",
    "conversation_sections": """WITH n AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
l AS (SELECT *, length(t) - length(replace(t, chr(10), '')) + 2 AS n FROM n),
o AS (SELECT *, row_number() OVER w AS section, (sum(n) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS line_end FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, t))
SELECT conv_id, turn, role, section, line_end - n + 1 AS line_start, line_end, ceil((length(t) + length(regexp_replace(t, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4.0)::BIGINT AS tokens FROM o""",
    "link_degrees": """WITH x AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages), l AS (SELECT DISTINCT page_id, href FROM x WHERE href IS DISTINCT FROM url)
SELECT href, count(*) AS in_links, href IN (SELECT url FROM pages WHERE url IS NOT NULL) AS resolved FROM l GROUP BY href""",
    "page_titles": """SELECT page_id, title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title FROM pages)""",
    "streamed_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
ORACLES |= vault_oracles.oracles(_LEDGER) | file_oracles.ORACLES | patch_oracles.oracles(_LEDGER)

#: The SQL of the jobs, which are registered beside the queries.
JOBS = {"job1_index_pages": vault_oracles.INDEX_JOB, "job2_ledger_confidence": f"WITH {_LEDGER} SELECT * FROM state"}
