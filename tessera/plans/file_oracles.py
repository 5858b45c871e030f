"""DuckDB SQL of the queries over raw files: what the made-up files hold is written out, not found by patterns."""

from __future__ import annotations

from .vault_oracles import _BLANKS, _NL

_RAW = f"""raw0 AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'node_modules/' WHEN doc_id % 19 = 0 THEN '.inbox/' ELSE 'src/' END || coalesce(lang, 'none') || '/' || CASE WHEN doc_id % 23 = 0 THEN 'd' || doc_id || '/index' ELSE 'f' || doc_id END AS stem,
  (['ts', 'tsx', 'js', 'mjs', 'cpp', 'c', 'mts', 'log', 'pdf', 'txt', 'md'])[doc_id % 11 + 1] AS ext, doc_id % 13 = 5 AS broken, coalesce(replace(replace(text, '*/', ''), '''', ''), '') AS t, coalesce(lang, 'none') AS lang FROM documents),
raw AS (SELECT doc_id, stem || '.' || ext AS path, stem, ext, broken, lang, CASE WHEN ext IN ('cpp', 'c') THEN '#include <stdio.h>' || {_NL} || '  # include "f' || (doc_id + 1) || '.h"' || {_NL} || '#include <stdio.h>' || {_NL} || '/* ' || t || ' */;' || {_NL} || 'static int run_' || doc_id || '(int a)' || {_NL} || '{{' || {_NL} || '  if (a) {{' || {_NL} || '  }}' || {_NL} || '}}' || {_NL} || 'int main() {{ ```` }}' || {_NL} || {_NL}
  WHEN ext IN ('log', 'pdf', 'txt', 'md') THEN '#  Title ' || doc_id || '  ' || chr(13) || {_NL} || t || '  ' || {_NL}
  ELSE 'import {{ a }} from ''./f' || (doc_id + 11) || ''';' || {_NL} || 'export * from "../' || lang || '/./f' || (doc_id + 22) || '.mjs"' || {_NL} || '  export const x = require( ''./d' || (doc_id + 23) || ''' );' || {_NL} || 'import type {{ T }} from "pkg";' || {_NL} || 'import ''./f' || (doc_id + 11) || '''' || {_NL} || 'import x from ''../../../up'';' || {_NL} || '/* ' || t || ' */' || {_NL} END AS c FROM raw0)"""


def _lines(of: str) -> str:
    return f"(length({of}) - length(replace({of}, chr(10), '')) + 1)"


_FENCE = "CASE WHEN len(inc) > 0 THEN '`````' ELSE '```' END"
_CONVERTED = f"""WITH {_RAW},
r AS (SELECT *, CASE WHEN ext = 'md' THEN c ELSE rtrim(c, {_BLANKS}) END AS b, CASE WHEN ext IN ('cpp', 'c') THEN ext WHEN ext = 'mts' THEN 'ts' WHEN ext = 'mjs' THEN 'js' WHEN ext IN ('ts', 'tsx', 'js') THEN ext END AS language FROM raw WHERE NOT starts_with(path, 'node_modules')),
x AS (SELECT *, CASE WHEN ext = 'pdf' THEN 'No converter available for .pdf in builtin mode' WHEN broken THEN 'Unreadable UTF-8 source: ' || path END AS error, regexp_extract(stem, '[^/]*$') AS name,
  CASE WHEN language IN ('c', 'cpp') AND NOT broken THEN ['stdio.h', 'f' || (doc_id + 1) || '.h'] ELSE [] END AS inc, CASE WHEN language IN ('c', 'cpp') AND NOT broken THEN ['run_' || doc_id, 'main'] ELSE [] END AS fun,
  CASE WHEN language NOT IN ('c', 'cpp') AND NOT broken THEN ['./f' || (doc_id + 11), '../' || lang || '/./f' || (doc_id + 22) || '.mjs', 'pkg', '../../../up', './d' || (doc_id + 23)] ELSE [] END AS imp FROM r),
m AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN ext = 'md' THEN b WHEN language IS NULL THEN '# ' || name || {_NL} || {_NL} || b || {_NL} ELSE
  array_to_string(['# ' || path, '', '## Code Metadata', '', '- Language: ' || language, '- Lines: ' || {_lines('b')}] || CASE WHEN len(inc) > 0 THEN list_prepend('- Includes:', list_transform(inc, lambda i: '  - ' || i)) ELSE [] END
    || CASE WHEN len(imp) > 0 THEN list_prepend('- Imports:', list_transform(imp, lambda i: '  - ' || i)) ELSE [] END || CASE WHEN len(fun) > 0 THEN list_prepend('- Functions:', list_transform(fun, lambda i: '  - ' || i)) ELSE [] END
    || ['', '## Source', '', {_FENCE} || language, b, {_FENCE}, ''], {_NL}) END AS md FROM x)
SELECT path, regexp_replace(path, '^\\.', '') || CASE WHEN ext = 'md' THEN '' ELSE '.md' END AS target, error, CASE WHEN error IS NULL THEN CASE WHEN ext = 'md' THEN 'Title ' || doc_id WHEN language IS NULL THEN name ELSE path END END AS title,
  CASE WHEN error IS NULL THEN CASE WHEN ext = 'md' THEN 'markdown' WHEN language IS NULL THEN 'text' ELSE 'code' END END AS source_type, CASE WHEN error IS NULL THEN CASE WHEN ext = 'log' THEN 'log' ELSE language END END AS source_subtype,
  CASE WHEN error IS NULL AND ext <> 'md' THEN {_lines('b')} END AS line_count, array_to_string(inc, ',') AS includes, array_to_string(imp, ',') AS imports, array_to_string(fun, ',') AS functions, (CASE WHEN len(imp) > 0 THEN 2 ELSE 0 END)::BIGINT AS export_count,
  'sha256:' || sha256(CASE WHEN broken THEN encode(c) || '\\xFF\\xFE'::BLOB ELSE encode(c) END) AS raw_hash, sha256(md) AS digest FROM m"""

_CODE = f"""{_RAW}, code AS (SELECT * FROM raw WHERE ext IN ('ts', 'tsx', 'js', 'mjs', 'mts') AND NOT broken AND NOT starts_with(path, 'node_modules'))"""
_IMPORTS = f"""WITH {_CODE},
im AS (SELECT path, regexp_extract(stem, '^(.*)/[^/]*$', 1) AS dir, unnest([0, 1, 2, 3]) AS n, unnest(['./f' || (doc_id + 11), '../' || lang || '/./f' || (doc_id + 22) || '.mjs', './d' || (doc_id + 23), './f' || (doc_id + 11)]) AS specifier FROM code),
ba AS (SELECT *, CASE n WHEN 1 THEN regexp_replace(dir, '/[^/]*$', '') || '/' || replace(specifier[4:], '/./', '/') ELSE dir || '/' || specifier[3:] END AS base FROM im),
ca AS (SELECT *, base || unnest(['', '.cjs', '.cts', '.js', '.jsx', '.mjs', '.mts', '.ts', '.tsx', '/index.cjs', '/index.cts', '/index.js', '/index.jsx', '/index.mjs', '/index.mts', '/index.ts', '/index.tsx']) AS "to", unnest(range(17)) AS nth FROM ba)
SELECT path AS "from", min_by("to", nth) AS "to", specifier FROM ca WHERE "to" IN (SELECT path FROM code) GROUP BY path, n, specifier"""

ORACLES = {
    "ingest_conversion": _CONVERTED,
    "code_files": f"WITH {_CODE} SELECT path, '.' || ext AS extension, {_lines('c')}::BIGINT AS line_count, 6::BIGINT AS import_count, 2::BIGINT AS export_count FROM code",
    "code_imports": _IMPORTS,
}
