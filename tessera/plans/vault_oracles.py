"""DuckDB SQL of the vault's queries."""

from __future__ import annotations

# Fixed values, written out here and not taken from the code that they check.
EXTENSIONS = ["md", "markdown", "txt", "log", "pdf", "ts", "py", "cpp", "bin", "mts", "cc", "text", "odt", "jsx", "H", "rs", "cjs"]
TYPES, SUBTYPES = ["markdown", "pdf", "webpage", "chat", "code", "letter"], ["academic", "vendor", "other", "vendor_whitepaper"]
HOSTS = ["docs.example.org/a", "blog.example.org", "EXAMPLE.com/Manual/x"]
_KINDS = "md markdown:markdown, txt text log:text, pdf docx doc html htm rtf odt:document, c cc cpp cxx h hh hpp hxx cjs cts js jsx mjs mts ts tsx:code"
_LANGUAGES = "c h:c, cc cpp cxx hh hpp hxx:cpp, ts mts cts:ts, tsx:tsx, js mjs cjs:js, jsx:jsx"

_NL = "chr(10)"


def _turn(values: list[str]) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[doc_id % {len(values)} + 1]"


def _page(number: str) -> str:
    return f"'page_' || lpad(({number})::VARCHAR, 12, '0')"


_FILES = f"files AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '.inbox/' ELSE 'notes/' END || coalesce(lang, 'none') || '/' || doc_id || '.' || {_turn(EXTENSIONS)} AS path FROM documents)"
_VAULT = f"""vault AS (SELECT 'page_' || lpad(doc_id::VARCHAR, 12, '0') AS page_id, 'pages/' || coalesce(lang, 'none') || '/' || doc_id || '.md' AS path, source,
  (CASE WHEN doc_id % 4 != 3 THEN '---' || {_NL} || 'title: ''Page ' || doc_id || '''' || {_NL} || 'aliases: [Nick ' || doc_id || ', "Also ' || doc_id || '"]' || {_NL} || 'source_type: ' || {_turn(TYPES)} || {_NL} || 'source_subtype: ' || {_turn(SUBTYPES)} || {_NL} || 'source_url: https://' || {_turn(HOSTS)} || {_NL} || 'type: ' || (['note', 'Decision', 'concept'])[doc_id % 3 + 1]
    || CASE WHEN doc_id % 9 <= 2 THEN {_NL} || 'supersedes: ' || {_page("CASE WHEN doc_id % 9 = 0 THEN doc_id - doc_id % 27 + (doc_id + 9) % 27 WHEN doc_id % 9 = 1 THEN doc_id - 1 ELSE 999999999999 END")} ELSE '' END
    || {_NL} || 'references: [src/' || coalesce(source, 'none') || '.ts, ''.\\docs\\d' || (doc_id % 50) || '.md'']' || CASE WHEN doc_id % 2 = 0 THEN {_NL} || 'source_hash: sha256:00' ELSE '' END || {_NL} || '---' || {_NL} ELSE '' END)
  || (CASE WHEN doc_id % 5 != 4 THEN '# Note ' || doc_id || {_NL} || {_NL} ELSE '' END) || (CASE WHEN doc_id % 10 = 7 THEN '<!-- kb:derived  source=' || {_page('doc_id + 1')} || ':su0 method=new patch=patch_7 -->' || {_NL} ELSE '' END) || (CASE doc_id % 60 WHEN 20 THEN 'This replaces what was.' || {_NL} WHEN 40 THEN 'It conflicts with others: page 3.' || {_NL} ELSE '' END) || coalesce(text, '') || {_NL} || {_NL}
  || (CASE WHEN doc_id % 5 = 2 THEN '## Derived' || {_NL} || '<!-- kb:derived source="' || {_page('doc_id + 2')} || ':c0, ' || {_page('doc_id + 1')} || ', ' || {_page('doc_id + 2')} || ':c99,lost:su1,' || {_page('doc_id + 1')} || ':su2" method=merge' || {_NL}
    || ' patch=p promptHash=h modelId="m 1" patch=patch_8 compiledAt=2024-01-01T00:00:00Z-->' || {_NL} || 'summed up' || {_NL} ELSE '' END)
  || (CASE WHEN doc_id % 6 != 5 THEN '## See also ##' || {_NL} || '[[' || (doc_id + 1 + doc_id % 3) || '|next]] and [[Nowhere ' || (doc_id % 7) || '#part]] [[page ' || (doc_id + 5) || ']] [[NICK ' || (doc_id + 6) || '#x]] [[Also ' || (doc_id + 7) || ']] [[' || coalesce(lang, 'none') || '\\' || (doc_id + 1) || '.md]]' || {_NL} || '```sh' || {_NL} || '# not a heading' || {_NL} || '```' || {_NL} || '### See also' || {_NL} || '  ' || {_NL} ELSE '' END) AS content FROM documents),
fm AS (SELECT *, regexp_extract(content, '(?s)^---\\n.*?\\n(?:---|\\.\\.\\.)(?:\\n|$)', 0) AS front FROM vault),
page AS (SELECT *, content[length(front) + 1:] AS body, length(front) - length(replace(front, {_NL}, '')) + 1 AS first FROM fm),
named AS (SELECT *, coalesce(nullif(trim(regexp_extract(front, '\\ntitle: ''?([^\\n'']*)', 1)), ''), nullif(trim(regexp_extract(body, '(?m)^# +([^\\n]+)$', 1)), ''), regexp_extract(path, '([^/]*?)(?:\\.[^./]*)?$', 1)) AS title FROM page),
lines AS (SELECT page_id, first, unnest(l) AS x, unnest(range(len(l))) AS pos, len(l) AS n FROM (SELECT page_id, first, string_split(replace(body, chr(13) || {_NL}, {_NL}), {_NL}) AS l FROM page))"""
_WIKI = """key AS (SELECT page_id, path, unnest([page_id, title, path, replace(path, 'pages/', ''), replace(replace(path, 'pages/', ''), '.md', ''), replace(regexp_extract(path, '[^/]*$'), '.md', ''),
  regexp_extract(front, 'aliases: \\[([^,]*)', 1), regexp_extract(front, 'aliases: \\[[^,]*, "([^"]*)"', 1)]) AS k FROM named),
known AS (SELECT lower(regexp_replace(replace(trim(k), '\\', '/'), '\\.md$', '')) AS k, max_by(page_id, path) AS "to" FROM key WHERE k <> '' GROUP BY 1),
target AS (SELECT page_id, trim(split_part(split_part(unnest(regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1)), '|', 1), '#', 1)) AS target FROM page),
wiki AS (SELECT page_id, target, "to" FROM target LEFT JOIN known ON lower(regexp_replace(replace(trim(target), '\\', '/'), '\\.md$', '')) = k WHERE target != ''),
deg AS (SELECT page_id, coalesce(o, 0) AS outgoing, coalesce(i, 0) AS incoming, coalesce(b, 0) AS broken FROM vault
  LEFT JOIN (SELECT page_id, count(*) FILTER ("to" != page_id) AS o, count(*) FILTER ("to" IS NULL) AS b FROM wiki GROUP BY page_id) USING (page_id)
  LEFT JOIN (SELECT "to" AS page_id, count(*) AS i FROM wiki WHERE "to" != page_id GROUP BY 1) USING (page_id))"""


# White space (fixed values) for trim() and for patterns.
_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || " + " || ".join(f"chr({c})" for c in [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
_SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _size(t: str) -> str:
    """Length in UTF-16 units."""
    return f"(length({t}) + length(regexp_replace({t}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def _packed(units: str, most: int, over, v: str) -> str:
    """A fold of units into pieces; `v` names its variables."""
    solid = f"trim({v}a.c, {_BLANKS}) <> ''"
    flush = lambda a: f"CASE WHEN trim({a}.c, {_BLANKS}) <> '' THEN list_append({a}.p, trim({a}.c, {_BLANKS})) ELSE {a}.p END"
    fold = f"""list_reduce({units}, lambda {v}a, {v}u: CASE WHEN {_size(v + 'u')} > {most} THEN {{'p': list_concat({flush(v + 'a')}, {over(v + 'u')}), 'c': CASE WHEN {solid} THEN '' ELSE {v}a.c END}}
  WHEN {_size(v + 'a.c')} + {_size(v + 'u')} > {most} AND {solid} THEN {{'p': {flush(v + 'a')}, 'c': {v}u}} ELSE {{'p': {v}a.p, 'c': {v}a.c || {v}u}} END, {{'p': []::VARCHAR[], 'c': ''}})"""
    return f"list_transform([{fold}], lambda {v}z: {flush(v + 'z')})[1]"


def _words(t: str, most: int, v: str) -> str:
    cut = lambda w: f"list_transform(range(0, (length({w}) - 1) // {most} + 1), lambda {v}k: substr({w}, {v}k * {most} + 1, {most}))"
    return _packed(f"regexp_extract_all({t}, '[{_SPACE}]+|[^{_SPACE}]+')", most, cut, v)


def _pieces(t: str, most: int = 3200) -> str:
    paragraphs = rf"string_split(regexp_replace({t}, '(\n{{2,}})', chr(1) || '\1' || chr(1), 'g'), chr(1))"
    sentences = rf"string_split(regexp_replace({t}, '([.!?。！？])[{_SPACE}]+', '\1' || chr(1), 'g'), chr(1))"
    units = f"list_filter(CASE WHEN contains({t}, chr(10) || chr(10)) THEN {paragraphs} ELSE {sentences} END, lambda q: q <> '')"
    return f"CASE WHEN {_size(t)} <= {most} THEN [{t}] WHEN len({units}) <= 1 THEN {_words(t, most, 'x')} ELSE {_packed(units, most, lambda u: _words(u, most, 'x'), 'y')} END"


def _cases(of: str, pairs) -> str:
    return " ".join(f"WHEN {of} = '{k}' THEN {v!r}" for k, v in pairs)


_RANGES = f"""f AS (SELECT *, regexp_extract(x, '^[{_SPACE}]*(`{{3}}|~~~)', 1) AS mark FROM lines),
gr AS (SELECT page_id, list(mark ORDER BY pos) AS marks, list(pos ORDER BY pos) AS spots FROM f WHERE mark <> '' GROUP BY page_id),
fe AS (SELECT page_id, unnest(spots) AS pos, unnest(list_reduce(marks, lambda a, m: list_append(a, CASE WHEN a[-1] = '' THEN m WHEN a[-1] = m THEN '' ELSE a[-1] END), [''])[2:]) AS open FROM gr),
g AS (SELECT f.*, coalesce(last_value(open IGNORE NULLS) OVER (PARTITION BY f.page_id ORDER BY f.pos), '') <> '' AS inside FROM f LEFT JOIN fe ON fe.page_id = f.page_id AND fe.pos = f.pos),
hd AS (SELECT *, sum((NOT inside AND mark = '' AND regexp_matches(x, '^#{{1,3}}[{_SPACE}]'))::INT) OVER (PARTITION BY page_id ORDER BY pos) AS chunk FROM g),
e AS (SELECT *, max(CASE WHEN NOT regexp_full_match(x, '[{_SPACE}]*') THEN pos END) OVER (PARTITION BY page_id, chunk) AS last FROM hd),
c AS MATERIALIZED (SELECT page_id, first + min(pos) AS line_start, first + max(last) AS line_end, string_agg(x, {_NL} ORDER BY pos) AS t FROM e WHERE pos <= last GROUP BY page_id, first, chunk)"""
_CHUNKS = f"""{_RANGES},
pc AS MATERIALIZED (SELECT page_id, line_start, line_end, {_pieces('t')} AS pieces FROM c),
pu AS (SELECT page_id, line_start, line_end, unnest(pieces) AS text, unnest(range(len(pieces))) AS piece FROM pc),
chunks AS MATERIALIZED (SELECT *, page_id || ':c' || idx AS chunk_id, ceil({_size('text')} / 4.0)::BIGINT AS tokens FROM (
  SELECT page_id, line_start, line_end, text, (row_number() OVER (PARTITION BY page_id ORDER BY line_start, piece) - 1)::INT AS idx FROM pu))"""

_EXT = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"


def _by_extension(names: str) -> str:
    pairs = [(ext, name) for of in names.split(", ") for exts, name in [of.split(":")] for ext in exts.split()]
    return "CASE " + _cases(_EXT, pairs)


_KIND = _by_extension(_KINDS) + " ELSE 'none' END"



_FTS = r"regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')"
_VEC = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"

#: The job that keeps an index: pages, their chunks and the terms of these.
INDEX_JOB = f"""WITH {_VAULT}, {_CHUNKS},
t AS (SELECT *, {_FTS} AS fts, {_VEC} AS vec FROM chunks)
SELECT n.page_id, n.path, n.title, sha256(n.path || {_NL} || n.content) AS content_hash, chunk_id, idx, line_start, line_end, tokens, len(fts) AS size, sha256(text) AS digest,
  len(list_distinct(fts)) AS index_terms, len(vec) AS vector_tokens, list_sort(fts || vec)[-1] AS last_term
FROM named n LEFT JOIN t USING (page_id)"""

_SNIPPET = """CASE WHEN length(text) <= 200 THEN text ELSE trim(substr(text, greatest(0, CASE WHEN first_term = '' THEN 0 ELSE instr(lower(text), first_term) - 1 END - 66) + 1, 200)) END"""
_SEARCHED = f"""{_VAULT}, {_CHUNKS},
ch AS (SELECT c.*, n.path, n.title, {_FTS} AS fts, {_VEC} AS vec FROM chunks c JOIN named n USING (page_id)),
qs AS (SELECT item_id, text, {_FTS} AS fts, {_VEC} AS vec, lower(regexp_extract(text, '[\\p{{L}}\\p{{N}}_]+', 0)) AS first_term FROM benchmark),
qf AS (SELECT item_id, term, count(*) AS qtf, count(*) OVER (PARTITION BY item_id) AS wanted FROM (SELECT item_id, unnest(fts) AS term FROM qs) GROUP BY item_id, term),
st AS (SELECT count(*) AS n, avg(len(fts)) AS mean FROM ch),
po AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(fts) AS term FROM ch) GROUP BY chunk_id, term),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM df CROSS JOIN st),
sc AS (SELECT item_id, chunk_id, floor(sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(fts) / mean))) * 1e6 + 0.5) / 1e6 AS bm25 FROM po JOIN qf USING (term) JOIN idf USING (term) JOIN ch USING (chunk_id) CROSS JOIN st GROUP BY item_id, chunk_id HAVING count(*) = any_value(wanted)),
fu AS (SELECT * FROM (SELECT sc.*, page_id, path, idx, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, path, idx) AS r FROM sc JOIN ch USING (chunk_id)) WHERE r <= 200)"""

_CHUNK_SEARCH = f"""WITH {_SEARCHED},
b AS (SELECT *, row_number() OVER (PARTITION BY item_id, page_id ORDER BY bm25 DESC, path, idx) AS best FROM fu),
t AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, path, idx))::INT AS rank FROM b WHERE best = 1)
SELECT item_id, page_id, path, title, chunk_id, line_start, line_end, bm25 AS score, {_SNIPPET.replace('(text', '(c.text').replace('THEN text', 'THEN c.text')} AS snippet, rank FROM t JOIN (SELECT chunk_id, title, line_start, line_end, text FROM ch) c USING (chunk_id) JOIN (SELECT item_id, first_term FROM qs) USING (item_id) WHERE rank <= 10"""

_CHUNK_HYBRID = f"""WITH {_SEARCHED},
qv AS (SELECT item_id, term, count(*) AS qtf, sqrt(sum(count(*) * count(*)) OVER (PARTITION BY item_id)) AS qnorm FROM (SELECT item_id, unnest(vec) AS term FROM qs) GROUP BY item_id, term),
pv AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(vec) AS term FROM ch) GROUP BY chunk_id, term),
nv AS (SELECT chunk_id, sqrt(sum(tf * tf)) AS norm FROM pv GROUP BY chunk_id),
dv AS (SELECT item_id, chunk_id, floor(least(1, greatest(0, sum(qtf * tf) / (any_value(qnorm) * any_value(norm)))) * 1e3 + 0.5) / 1e3 AS vector_score FROM pv JOIN qv USING (term) JOIN nv USING (chunk_id) GROUP BY item_id, chunk_id),
rel AS (SELECT item_id, chunk_id, CASE WHEN m > 0 THEN floor(least(1, greatest(0, bm25 / m)) * 1e3 + 0.5) / 1e3 ELSE 0 END AS bm25_score FROM (SELECT *, max(bm25) OVER (PARTITION BY item_id) AS m FROM fu)),
mix AS (SELECT *, floor((0.65::DOUBLE * bm25_score + 0.35::DOUBLE * vector_score) * 1e3 + 0.5) / 1e3 AS score FROM (SELECT item_id, chunk_id, vector_score, coalesce(bm25_score, 0::DOUBLE) AS bm25_score FROM dv LEFT JOIN rel USING (item_id, chunk_id))),
b AS (SELECT mix.*, page_id, path, row_number() OVER (PARTITION BY item_id, page_id ORDER BY score DESC, idx) AS best FROM mix JOIN (SELECT chunk_id, page_id, path, idx FROM ch) USING (chunk_id) WHERE score > 0),
t AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, page_id))::INT AS rank FROM b WHERE best = 1)
SELECT item_id, page_id, path, title, chunk_id, line_start, line_end, score, bm25_score, vector_score, {_SNIPPET.replace('(text', '(c.text').replace('THEN text', 'THEN c.text')} AS snippet, rank FROM t JOIN (SELECT chunk_id, title, line_start, line_end, text FROM ch) c USING (chunk_id) JOIN (SELECT item_id, first_term FROM qs) USING (item_id) WHERE rank <= 10"""

_FILES_OF = """(SELECT page_id, unnest(['src/' || coalesce(source, 'none') || '.ts', regexp_extract(replace(front, chr(92), '/'), '(docs/d[0-9]*[.]md)', 1)]) AS file FROM fm WHERE front <> '')"""
_LINEAGE = f"""{_CHUNKS},
dch AS (SELECT chunks.*, path, regexp_extract(c.t, '<!--[{_SPACE}]*[a-z]+:derived[{_SPACE}]+([^>]+)-->', 1) AS marker FROM chunks JOIN c USING (page_id, line_start) JOIN named USING (page_id)),
att AS (SELECT chunk_id, list_zip(regexp_extract_all(marker, '([A-Za-z][A-Za-z0-9_-]*)=("[^"]*"|[^{_SPACE}]+)', 1), regexp_extract_all(marker, '([A-Za-z][A-Za-z0-9_-]*)=("[^"]*"|[^{_SPACE}]+)', 2)) AS kv FROM dch WHERE marker <> ''),
val AS (SELECT chunk_id, {', '.join(f"regexp_replace(list_filter(kv, lambda z: z[1] = '{k}')[-1][2], '^" + '"|"$' + f"', '', 'g') AS {k}" for k in ('source', 'method', 'patch', 'promptHash', 'modelId', 'compiledAt'))} FROM att),
src AS (SELECT *, list_filter(list_transform(string_split(coalesce(source, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS s FROM val),
so AS (SELECT *, list_filter(s, lambda x: NOT contains(x, ':c')) || list_filter(s, lambda x: contains(x, ':c')) AS o FROM src),
ln AS (SELECT *, unnest(o) AS one, unnest(range(len(o))) AS nth FROM so),
lin AS (SELECT chunk_id || ':l' || nth AS id, chunk_id, CASE WHEN NOT contains(one, ':c') THEN one END AS source_unit_id, CASE WHEN contains(one, ':c') THEN one END AS source_chunk_id,
  CASE WHEN method IN ('segment', 'merge', 'contradict', 'supersede', 'summary') THEN method ELSE 'extend' END AS method, coalesce(patch, '') AS patch_id, coalesce(promptHash, '') AS prompt_hash, coalesce(modelId, '') AS model_id, coalesce(compiledAt, '1970-01-01T00:00:00.000Z') AS compiled_at FROM ln)"""
_CYCLES = """edge AS (SELECT page_id, nullif(regexp_extract(front, 'supersedes: (page_[0-9]*)', 1), '') AS "to" FROM fm),
es AS (SELECT * FROM edge WHERE "to" IN (SELECT page_id FROM vault)),
walk AS (SELECT page_id AS start, "to" AS cur, [page_id] AS way FROM es UNION ALL SELECT start, es."to", list_append(way, cur) FROM walk JOIN es ON es.page_id = cur WHERE NOT list_contains(way, cur)),
ring AS (SELECT start, unnest(way) AS page_id, unnest(range(len(way))) AS position, len(way) AS length FROM walk WHERE cur = start AND start = list_min(way))"""


def _stable(of: str, name: str) -> str:
    """A hash of `of`, which ends as name.id."""
    return f"""{name}h AS (SELECT k, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(of, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (xor(a, c) * 16777619) & 4294967295) AS h FROM {of}),
{name}v AS (SELECT k, CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END AS v FROM {name}h),
{name} AS (SELECT k, 'page_' || lpad(array_to_string(list_transform(range(6, -1, -1), lambda k: substr('0123456789abcdefghijklmnopqrstuvwxyz', ((v // (36 ** k)::BIGINT) % 36 + 1)::INT, 1)), ''), 12, '0') AS id FROM {name}v)"""


#: Every source is held against every page.
_COMPILED = f"""WITH {_VAULT}, {_RANGES}, {_CHUNKS.split(_RANGES + ',', 1)[1].strip()},
pg AS (SELECT page_id, title, lower(title || {_NL} || body) AS text, list_distinct(list_filter(string_split_regex(lower(title || ' ' || regexp_extract(front, 'aliases: \\[([^,]*)', 1) || ' ' || regexp_extract(front, 'aliases: \\[[^,]*, "([^"]*)"', 1) || ' ' || body), '[^a-z0-9]+'), lambda w: length(w) > 3)) AS terms,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(body), '(?s)^---.*?---\\s*', ''), '^# [^\\n]*\\n+', ''), '[^a-z0-9]+', ' ', 'g')) AS print FROM named),
so AS (SELECT * FROM pg WHERE page_id IN (SELECT {_page('doc_id')} FROM documents WHERE doc_id % 20 = 0)),
pr AS (SELECT s.page_id AS source, t.page_id AS target, len(list_intersect(s.terms, t.terms)) + CASE WHEN contains(s.text, lower(t.title)) THEN 100 ELSE 0 END AS score, s.print <> '' AND s.print = t.print AS copy,
  CASE WHEN regexp_matches(s.text, '\\b(supersedes|supersede|replaces|replacement)\\b') THEN 'supersede' WHEN regexp_matches(s.text, '\\b(contradicts|contradict|conflicts|conflict)\\b') THEN 'contradict' END AS said FROM so s JOIN pg t ON s.page_id <> t.page_id),
ra AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN said IS NOT NULL THEN 0 WHEN copy THEN 1 ELSE 2 END, CASE WHEN said IS NULL AND copy THEN 0 ELSE score END DESC, target) AS r FROM pr WHERE score > 0),
be AS (SELECT so.page_id AS source, title, target, coalesce(score, 0) AS score, coalesce(said, CASE WHEN copy OR copy IS NULL THEN 'duplicate' ELSE 'extend' END) AS relation FROM so LEFT JOIN (SELECT * FROM ra WHERE r = 1) ra ON ra.source = so.page_id),
na AS (SELECT source AS k, source || ':supersedes:' || target AS of FROM be WHERE relation = 'supersede'),
{_stable('na', 'st')},
cn AS (SELECT page_id AS target, count(*) AS n FROM chunks GROUP BY page_id)
SELECT source, target, score::INT AS score, relation, CASE relation WHEN 'duplicate' THEN 'confidence_only' WHEN 'supersede' THEN 'create' ELSE 'modify' END AS change, CASE WHEN relation = 'supersede' THEN id ELSE coalesce(target, source) END AS page_id,
  CASE WHEN relation = 'supersede' THEN 'pages/compiled/' || coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'compiled-page') || '.md' END AS path,
  CASE relation WHEN 'duplicate' THEN 0.7::DOUBLE WHEN 'extend' THEN 0.8::DOUBLE END AS source_weight, CASE relation WHEN 'extend' THEN 0.7::DOUBLE WHEN 'contradict' THEN 0.68::DOUBLE WHEN 'supersede' THEN 0.72::DOUBLE END AS confidence,
  CASE WHEN relation = 'supersede' THEN id || ':c0' WHEN relation <> 'duplicate' THEN target || ':c' || coalesce(n, 0) END AS derived_chunk
FROM be LEFT JOIN st ON st.k = source LEFT JOIN cn USING (target)"""


def oracles(ledger: str) -> dict[str, str]:
    """The queries' SQL; `ledger` defines led and state, with the latter's anchor in seconds."""
    flags = """flagged AS (SELECT page_id, score, list_filter([CASE WHEN score < 0.5 THEN 'NEEDS_REVIEW' END, CASE WHEN superseded THEN 'SUPERSEDED' END, CASE WHEN (epoch(TIMESTAMP '2024-02-01') - last_verified_at) / 86400 > 60 THEN 'STALE' END], lambda f: f IS NOT NULL) AS flags FROM state)"""
    risk = lambda f: f"CASE WHEN list_contains({f}, 'MISSING_LEDGER') THEN 'missing_ledger' WHEN list_contains({f}, 'NEEDS_REVIEW') THEN 'needs_review' WHEN list_contains({f}, 'STALE') THEN 'stale' WHEN list_contains({f}, 'SUPERSEDED') THEN 'superseded' ELSE 'ok' END"
    slug = "coalesce(nullif(regexp_replace(regexp_replace(lower(heading), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'section')"
    tokens = "ceil((length(t) + length(regexp_replace(t, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4.0)::BIGINT"
    found = {
        "confidence_status": f"WITH {ledger}, {flags} SELECT page_id, score, array_to_string(flags, ',') AS flags, {risk('flags')} AS risk_level FROM flagged",
        "ingest_sources": f"""WITH {_FILES} SELECT doc_id, path, {_KIND} AS kind, {_by_extension(_LANGUAGES)} END AS language,
regexp_replace(path, '^\\.', '').regexp_replace('\\.markdown$', '.md') || CASE WHEN {_EXT} IN ('md', 'markdown') THEN '' ELSE '.md' END AS target FROM files""",
        "page_parts": f"""WITH {_VAULT}, f AS (SELECT *, nullif(regexp_extract(front, '\\nsource_type: *([^\\n]*)\\n', 1), '') AS source_type, nullif(regexp_extract(front, '\\nsource_subtype: *([^\\n]*)\\n', 1), '') AS subtype FROM named)
SELECT page_id, path, title, first AS body_line, source_type, (CASE WHEN source_type = 'pdf' THEN CASE WHEN subtype = 'academic' THEN 0.8 WHEN subtype LIKE 'vendor%' THEN 0.5 WHEN contains(front, 'source_hash') THEN 0.8 ELSE 0.5 END
  WHEN source_type IN ('markdown', 'code') THEN 1 WHEN source_type = 'chat' THEN 0.4 WHEN source_type = 'webpage' THEN CASE WHEN contains(front, 'blog.') THEN 0.3 ELSE 0.6 END WHEN contains(front, 'source_hash') THEN 0.8 ELSE 0.5 END)::DOUBLE AS weight FROM f""",
        "chunk_ranges": f"""WITH {_VAULT}, {_RANGES} SELECT page_id, line_start, line_end, {tokens} AS tokens, sha256(t) AS digest FROM c""",
        "markdown_sections": f"""WITH {_VAULT}, g AS (SELECT *, sum((x LIKE '```%')::INT) OVER (PARTITION BY page_id ORDER BY pos) % 2 = 1 AS inside FROM lines),
h AS (SELECT *, trim(regexp_extract(x, '^#{{1,6}}[ \\t]+(.+?)[ \\t]*#*[ \\t]*$', 1)) AS heading FROM g WHERE NOT inside AND regexp_matches(x, '^#{{1,6}}[ \\t]+[^ \\t]')),
s AS (SELECT *, {slug} AS slug, lead(pos) OVER (PARTITION BY page_id ORDER BY pos) AS next FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, slug ORDER BY pos) AS nth FROM s)
SELECT page_id, 'sec_' || slug || CASE WHEN nth > 1 THEN '_' || nth ELSE '' END AS section_id, heading, length(regexp_extract(x, '^(#{{1,6}})', 1)) AS level, first + pos AS line_start, coalesce(next, n) + first - 1 AS line_end FROM k
UNION ALL SELECT page_id, 'sec_body', 'Body', 0, min(first), min(first) + max(n) - 1 FROM lines WHERE page_id NOT IN (SELECT page_id FROM h) GROUP BY page_id""",
        "wiki_degrees": f"WITH {_VAULT}, {_WIKI} SELECT *, outgoing = 0 AND incoming = 0 AS orphan FROM deg",
        "stable_ids": f"""WITH {_FILES}, h AS (SELECT doc_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(path, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (xor(a, c) * 16777619) & 4294967295) AS h FROM files),
v AS (SELECT doc_id, CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END AS v FROM h)
SELECT doc_id, 'page_' || lpad(array_to_string(list_transform(range(6, -1, -1), lambda k: substr('0123456789abcdefghijklmnopqrstuvwxyz', ((v // (36 ** k)::BIGINT) % 36 + 1)::INT, 1)), ''), 12, '0') AS page_id FROM v""",
        "snippets": """WITH t AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(lang, '')) AS q FROM documents), p AS (SELECT *, CASE WHEN q = '' THEN 0 ELSE greatest(0, instr(lower(t), q) - 1 - 80) END AS pos FROM t)
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE trim(substr(t, pos + 1, 240)) END AS snippet FROM p""",
        "fallback_queries": """WITH w AS (SELECT item_id, list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9_+#-]*'), lambda x: length(x) >= 2 AND x != text) AS w FROM benchmark),
o AS (SELECT item_id, list_filter(w, lambda x: regexp_matches(x, '[A-Z]')) || list_filter(w, lambda x: NOT regexp_matches(x, '[A-Z]')) AS o FROM w),
u AS (SELECT item_id, unnest(o) AS x, unnest(range(len(o))) AS pos FROM o), f AS (SELECT item_id, min_by(x, pos) AS x, min(pos) AS pos FROM u GROUP BY item_id, lower(x))
SELECT item_id, coalesce(string_agg(x, ' ' ORDER BY pos), '') AS queries FROM benchmark LEFT JOIN f USING (item_id) GROUP BY item_id""",
        "file_risk": f"""WITH {ledger}, {flags}, {_VAULT},
r AS (SELECT file, score, coalesce(flags, ['MISSING_LEDGER']) AS flags FROM {_FILES_OF} LEFT JOIN flagged USING (page_id)),
a AS (SELECT file, count(*) AS page_count, min(score) AS min_score, floor(sum(round(score * 10000)::BIGINT) / count(score) / 10000 * 1e4 + 0.5) / 1e4 AS avg_score, list_sort(list_distinct(flatten(list(flags)))) AS fl FROM r GROUP BY file),
l AS (SELECT *, {risk('fl')} AS risk_level FROM a)
SELECT file, page_count, min_score, avg_score, coalesce(array_to_string(fl, ','), '') AS flags, risk_level, (list_position(['missing_ledger', 'needs_review', 'stale', 'superseded', 'ok'], risk_level) - 1)::BIGINT AS risk_rank FROM l""",
        "lint_report": f"""WITH RECURSIVE {ledger.replace('2024-02-01', '2024-07-15').replace('2024-01-02', '2024-06-15')}, {_VAULT}, {_WIKI}, {_LINEAGE}, {_CYCLES},
v AS (SELECT page_id, max((ts, seq)) AS v FROM led WHERE kind IN ('verified', 'superseded') GROUP BY page_id),
con AS (SELECT page_id, count(*) AS active FROM led LEFT JOIN v USING (page_id) WHERE e = 'error' AND (v IS NULL OR (ts, seq) > v) GROUP BY page_id),
age AS (SELECT page_id, contains(front, 'type: Decision') AS decision, (epoch(TIMESTAMP '2024-07-15') - last_verified_at) / 86400 AS days, (epoch(TIMESTAMP '2024-07-15') - coalesce(last_verified_at, (SELECT min(us) FROM led WHERE led.page_id = state.page_id) / 1e6)) / 86400 AS old FROM state JOIN fm USING (page_id))
SELECT 'low_confidence' AS "check", page_id, NULL::VARCHAR AS detail FROM state SEMI JOIN vault USING (page_id) WHERE score < 0.5
UNION ALL SELECT 'stale', page_id, CASE WHEN decision AND old >= 100 THEN 'gate' END FROM age WHERE decision AND old >= 100 OR days > 180
UNION ALL SELECT 'unresolved_contradiction', page_id, active::VARCHAR FROM con SEMI JOIN vault USING (page_id)
UNION ALL SELECT 'orphan_page', page_id, NULL FROM deg WHERE outgoing = 0 AND incoming = 0
UNION ALL SELECT 'broken_link', page_id, target FROM wiki WHERE "to" IS NULL
UNION ALL SELECT 'high_derived_ratio', page_id, count(*) FILTER (marker <> '') || '/' || count(*) FROM dch GROUP BY page_id HAVING count(*) FILTER (marker <> '') * 2 > count(*)
UNION ALL SELECT 'orphaned_lineage', split_part(chunk_id, ':', 1), source_chunk_id FROM lin WHERE source_chunk_id IS NOT NULL AND source_chunk_id NOT IN (SELECT chunk_id FROM chunks)
UNION ALL SELECT 'orphaned_lineage', split_part(chunk_id, ':', 1), source_unit_id FROM lin WHERE source_unit_id IS NOT NULL AND split_part(source_unit_id, ':', 1) NOT IN (SELECT page_id FROM vault)
UNION ALL SELECT 'supersession_cycle', page_id, start FROM ring""",
    }
    found |= {
        "compile_relations": _COMPILED,
        "chunk_lineage": f"""WITH {_VAULT}, {_LINEAGE} SELECT lin.*, d.path AS source_path, d.line_start AS source_line_start, d.line_end AS source_line_end FROM lin LEFT JOIN dch d ON d.chunk_id = lin.source_chunk_id""",
        "lineage_uses": f"""WITH {_VAULT}, {_LINEAGE}, asked AS (SELECT page_id || unnest(['', ':c0', ':su0']) AS asked FROM vault)
SELECT asked, id, chunk_id FROM lin JOIN asked ON CASE WHEN contains(asked, ':c') THEN source_chunk_id = asked ELSE source_unit_id = asked OR starts_with(source_unit_id, asked || ':') OR starts_with(source_chunk_id, asked || ':') END""",
        "derived_ratios": f"WITH {_VAULT}, {_LINEAGE} SELECT page_id, count(*) FILTER (marker <> '') AS derived, count(*) AS total FROM dch GROUP BY page_id",
        "supersession_cycles": f"WITH RECURSIVE {_VAULT}, {_CYCLES} SELECT start AS cycle, position, page_id, length FROM ring",
        "changed_file_issues": f"""WITH {ledger}, {flags}, {_VAULT}, changed AS (SELECT 'src/' || source || '.ts' AS file FROM documents WHERE source IN ('src1', 'src2', 'src3') UNION SELECT 'docs/d' || doc_id || '.md' FROM documents WHERE doc_id % 10 = 3)
SELECT file, page_id, path, score, array_to_string(coalesce(flags, ['MISSING_LEDGER']), ',') AS flags FROM (SELECT * FROM {_FILES_OF} SEMI JOIN changed USING (file)) JOIN vault USING (page_id) LEFT JOIN flagged USING (page_id) WHERE coalesce(len(flags), 1) > 0""",
        "chunk_pieces": f"""WITH {_VAULT}, {_CHUNKS} SELECT page_id, idx, chunk_id, line_start, line_end, tokens, sha256(text) AS digest FROM chunks""",
        "chunk_search": _CHUNK_SEARCH,
        "chunk_hybrid": _CHUNK_HYBRID,
    }
    summary = "summary AS (SELECT page_id, path, title, score, coalesce(source_count, 0) AS source_count, coalesce(contradiction_count, 0) AS contradiction_count, coalesce(array_to_string(flags, ','), 'MISSING_LEDGER') AS flags FROM named LEFT JOIN (SELECT page_id, source_count, contradiction_count FROM state) USING (page_id) LEFT JOIN flagged USING (page_id))"
    return found | {
        "lint_gate": f"""WITH lint AS ({found['lint_report']}), c("check", hard) AS (VALUES ('low_confidence', false), ('stale', false), ('unresolved_contradiction', true), ('orphan_page', false), ('broken_link', true), ('high_derived_ratio', false), ('orphaned_lineage', false), ('supersession_cycle', true))
SELECT c."check", count(lint.page_id) AS found, CASE WHEN count(lint.page_id) = 0 THEN 'pass' WHEN any_value(hard) OR bool_or(c."check" = 'stale' AND detail IS NOT DISTINCT FROM 'gate') THEN 'fail' ELSE 'warn' END AS status FROM c LEFT JOIN lint ON lint."check" = c."check" GROUP BY ALL""",
        "page_confidence": f"WITH {ledger}, {flags}, {_VAULT}, {summary} SELECT * FROM summary",
        "section_confidence": f"WITH {ledger}, {flags}, {_VAULT}, {summary}, sec AS ({found['markdown_sections']}) SELECT sec.*, score, flags FROM sec JOIN summary USING (page_id)",
        "pages_to_verify": f"WITH {ledger}, {_VAULT} SELECT page_id, path, score FROM vault LEFT JOIN state USING (page_id) WHERE score IS NULL OR score < 0.7",
        "whole_pages": f"WITH {_VAULT} SELECT page_id, path, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, {_NL})) END AS line_count, sha256(content) AS digest FROM vault",
        "wiki_links": f"WITH {_VAULT}, {_WIKI} SELECT * FROM wiki",
        "vault_stats": f"""WITH {_VAULT}, {_WIKI}, ch AS ({found['chunk_ranges']}), sec AS ({found['markdown_sections']})
SELECT 'pages' AS metric, count(*) AS value FROM vault UNION ALL SELECT 'chunks', count(*) FROM ch UNION ALL SELECT 'tokens', coalesce(sum(tokens), 0)::BIGINT FROM ch
UNION ALL SELECT 'sections', count(*) FROM sec UNION ALL SELECT 'links', count(*) FROM wiki""",
    }
