"""DuckDB SQL of the queries over patches: the made-up patches, their errors by rule, and the texts after them."""

from __future__ import annotations

from .vault_oracles import _CHUNKS, _NL, _VAULT, _page


def oracles(ledger: str) -> dict[str, str]:
    """`ledger` defines state."""
    base = f"""{ledger}, {_VAULT}, {_CHUNKS},
pa AS (SELECT *, doc_id // 10 % 5 AS kind5, 'patch_' || lpad(doc_id::VARCHAR, 12, '0') AS patch_id, {_page('doc_id')} AS own, {_page('doc_id + 1')} AS near, {_page('doc_id + 2')} AS old FROM documents WHERE doc_id % 10 = 0),
ch AS (SELECT *, CASE WHEN kind5 = 4 AND doc_id % 4 = 0 THEN {_page('doc_id + 1000000')} WHEN kind5 = 3 THEN {_page('doc_id + 900000000000')} ELSE near END AS target FROM pa),
er AS (SELECT patch_id, 0 AS n, 'target page not found ' || target AS error FROM ch WHERE kind5 <> 3 AND target NOT IN (SELECT page_id FROM vault)
UNION SELECT patch_id, 0, 'target page not found ' || old FROM ch WHERE kind5 = 3 AND old NOT IN (SELECT page_id FROM vault)
UNION SELECT patch_id, 0, old || ' is already superseded' FROM ch WHERE kind5 = 3 AND old IN (SELECT page_id FROM state WHERE superseded)
UNION SELECT patch_id, 0, 'sourceWeight must be 0-1' FROM ch WHERE kind5 = 0 AND doc_id % 700 > 500
UNION SELECT patch_id, 0, 'contradiction severity must be minor or major' FROM ch WHERE kind5 = 1 AND doc_id % 60 = 10
UNION SELECT patch_id, 0, 'target section not found See also ##' FROM ch JOIN vault ON page_id = target WHERE kind5 = 1 AND (doc_id + 1) % 6 = 5
UNION SELECT patch_id, 0, 'target section not found # note ' || (doc_id + 1) FROM ch JOIN vault ON page_id = target WHERE kind5 = 2 AND (doc_id + 1) % 5 = 4
UNION SELECT patch_id, 0, 'unresolved derived source ' || own || CASE WHEN doc_id % 3 = 0 THEN ':c999' ELSE ':c0' END FROM ch WHERE kind5 = 0 AND own || CASE WHEN doc_id % 3 = 0 THEN ':c999' ELSE ':c0' END NOT IN (SELECT chunk_id FROM chunks)
UNION SELECT patch_id, NULL, 'unresolved lineage source ' || own || ':c0' FROM ch WHERE own || ':c0' NOT IN (SELECT chunk_id FROM chunks)),
ok AS (SELECT * FROM ch ANTI JOIN er USING (patch_id))"""
    return {
        "patch_errors": f"WITH {base} SELECT * FROM er",
        "patched_pages": f"""WITH {base}
SELECT page_id, path, sha256(CASE kind5 WHEN 0 THEN rtrim(content, ' ' || {_NL}) || {_NL} || {_NL} || '## Added' || {_NL} || '<!-- kb:derived source=' || own || ':su0,' || own || CASE WHEN doc_id % 3 = 0 THEN ':c999' ELSE ':c0' END || ' -->' || {_NL} || 'more'
  WHEN 1 THEN content[:strpos(content, '## See also ##') - 1] || '## See also ##' || {_NL} || 'none' ELSE regexp_replace(content, '(\\n[ \\t]*)+$', '') || {_NL} || {_NL} || 'inserted' || {_NL} END) AS digest, patch_id AS patches FROM ok JOIN vault ON page_id = target WHERE kind5 <= 2
UNION ALL SELECT target, 'pages/compiled/' || replace(target, '_', '-') || '.md', sha256('---' || {_NL} || 'id: ' || target || {_NL} || 'title: Made' || {_NL} || '---' || {_NL} || 'in place of ' || old), patch_id FROM ok WHERE kind5 = 3""",
        "patch_ledger": f"""WITH {base}
SELECT patch_id, 0 AS n, target AS page_id, CASE WHEN kind5 IN (0, 4) THEN 'source_added' WHEN kind5 = 1 THEN 'contradicted_by' ELSE 'supersedes' END AS kind, CASE kind5 WHEN 0 THEN (doc_id % 700)::DOUBLE / 500 WHEN 4 THEN 0.7::DOUBLE END AS source_weight,
  CASE WHEN kind5 = 1 THEN 'minor' END AS severity, CASE WHEN kind5 = 3 THEN old END AS other FROM ok WHERE kind5 <> 2
UNION ALL SELECT patch_id, 0, old, 'superseded_by', NULL, NULL, target FROM ok WHERE kind5 = 3""",
    }
