"""DuckDB SQL of the training-data queries that SQL can express on whole tables."""

# Both sums of divergences are taken over all kept terms, one by one.
_DIVERGENCE = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (SELECT lang, source, rid, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM occ GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
n AS (SELECT lang, source, term, count(*) AS n FROM occ SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(total) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
mass AS (SELECT g.lang, g.source, coalesce(any_value(v), 0) + coalesce(sum(n), 0) AS m FROM g LEFT JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT k.lang, m.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // m.m::HUGEINT AS p, 1 + 1000000000::HUGEINT * (k.total + 1) // (v.v + v.total)::HUGEINT AS q
  FROM kept k JOIN v USING (lang) JOIN mass m USING (lang) LEFT JOIN n ON n.lang = k.lang AND n.source = m.source AND n.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
allp AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)))::INT AS rank FROM allp
  UNION ALL SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)))::INT FROM terms)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""

#: Lengths of n-grams with the percentage of characters that may repeat (fixed values).
_MOST = {5: 15, 7: 13, 10: 10}


def _repetition() -> str:
    key = lambda n: " || ' ' || ".join(["w", *[f"lead(w, {k}) OVER o" for k in range(1, n)]])
    grams = ", ".join(f"{key(n)} AS g{n}" for n in (3, *_MOST))
    marks = ", ".join(f"CASE WHEN g{n} IS NOT NULL THEN count(*) OVER (PARTITION BY rid, g{n}) > 1 AND {'true' if n == 3 else f'row_number() OVER (PARTITION BY rid, g{n} ORDER BY i) > 1'} ELSE false END AS d{n}" for n in (3, *_MOST))
    covers = ", ".join(f"bool_or(d{n}) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in (3, *_MOST))
    dups = ", ".join(f"(sum(length(w)) FILTER (c{n}))::BIGINT AS dup{n}_chars" for n in _MOST)
    none = ", ".join(f"coalesce(dup{n}_chars, 0) AS dup{n}_chars" for n in _MOST)
    good = " AND ".join(f"100 * dup{n}_chars <= {most} * word_chars" for n, most in _MOST.items())
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM x),
g AS (SELECT rid, i, w, {grams} FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
m AS (SELECT rid, i, w, {marks} FROM g),
c AS (SELECT rid, w, {covers} FROM m),
s AS (SELECT rid, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, count(*) FILTER (c3) AS n_repeat_words, {dups} FROM c GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS l, unnest(range(len(string_split(t, chr(10))))) AS i FROM d),
e AS (SELECT rid, length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS n, row_number() OVER (PARTITION BY rid, l ORDER BY i) > 1 AS again FROM l),
ls AS (SELECT rid, count(*) FILTER (again AND n > 0) AS n_dup_lines, coalesce(sum(n) FILTER (again), 0)::BIGINT AS dup_line_chars FROM e GROUP BY rid),
r AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, {none}, dup_line_chars FROM d LEFT JOIN s USING (rid) LEFT JOIN ls USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r)
SELECT *, NOT base_failed AND {good} AND 100 * dup_line_chars <= 20 * word_chars AND 100 * n_symbols <= 10 * n_words AS kept FROM b"""


ORACLES = {"op11_source_divergence": _DIVERGENCE, "op12_repetition_rules": _repetition()}
