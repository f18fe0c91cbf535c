"""Independent SQL for the findings queries, written from the rule texts."""

from __future__ import annotations

from ramparts.checks import surface_sql
from ramparts.sources.derived import with_tables

ORACLES: dict[str, str] = {}


def oracle(name: str, tables: list[str], body: str) -> None:
    ORACLES[name] = with_tables(tables, body)


_JUDGED = """, judged AS (SELECT *, CASE WHEN proof_kind = 'runnable' THEN signal WHEN signal THEN true END AS proven,
  CASE WHEN signal THEN 'confirmed' ELSE 'unconfirmed' END AS section FROM find)"""
_KNOWN = _JUDGED + ", kn AS (SELECT *, class IN (SELECT class FROM memory) AS known FROM judged)"
_RANK = _KNOWN + """, ranks AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY section = 'confirmed' DESC, known DESC,
  CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 WHEN 'Informational' THEN 4 ELSE 9 END,
  rel, line, class, finding_id) AS rank FROM kn)"""
_ID = "'F-' || CASE WHEN rank < 1000 THEN lpad(rank::VARCHAR, 3, '0') ELSE rank::VARCHAR END"

oracle("assign_section", ["find"], _JUDGED + " SELECT finding_id, proof_kind, signal, proven, section FROM judged")
oracle("join_known_pattern", ["find", "memory"], _KNOWN + " SELECT finding_id, class, known FROM kn")
oracle("win_finding_rank", ["find", "memory"], _RANK + " SELECT run, finding_id, section, known, severity, rank FROM ranks")
oracle("finding_id", ["find", "memory"], _RANK + f" SELECT run, finding_id, {_ID} AS id FROM ranks")
oracle("findings_report", ["find", "memory"], _RANK + f""" SELECT run, section, {_ID} AS id, class, severity, known, rel || ':' || line AS location,
  count(*) OVER (PARTITION BY run, section) AS section_size FROM ranks""")
oracle("sink_findings_json", ["find"], _JUDGED + """ SELECT finding_id, '{"class":"' || class || '","severity":"' || severity || '","section":"' || section ||
  '","rel":"' || rel || '","line":' || line || '}' AS json FROM judged""")
oracle("pattern_memory_merge", ["find", "memory"], _JUDGED + """, fresh AS (SELECT DISTINCT class FROM judged WHERE section = 'confirmed' AND class <> 'class-view')
SELECT class, CASE WHEN f THEN 'confirmed pattern of ' || class ELSE signature END AS signature,
  coalesce(first_seen, TIMESTAMP '2024-02-01 00:00:00') AS first_seen, CASE WHEN f THEN TIMESTAMP '2024-02-01 00:00:00' ELSE last_seen END AS last_seen
FROM (SELECT a.class, class IN (SELECT class FROM fresh) AS f, m.signature, m.first_seen, m.last_seen
  FROM (SELECT class FROM memory UNION SELECT class FROM fresh) a LEFT JOIN memory m USING (class))""")
oracle("agg_section_counts", ["find"], _JUDGED + " SELECT run, section, count(*) AS n FROM judged GROUP BY run, section")
oracle("agg_ci_gate", ["find"], _JUDGED + " SELECT rel AS run, bool_or(section = 'confirmed' AND severity IN ('Critical', 'High')) AS failed FROM judged GROUP BY rel")
oracle("agg_confirmed_classes", ["find"], _JUDGED + " SELECT DISTINCT class FROM judged WHERE section = 'confirmed'")
oracle("agg_high_critical", ["find"], "SELECT rel, count(*) AS total, count(*) FILTER (severity IN ('Critical', 'High')) AS grave FROM find GROUP BY rel")
oracle("top_findings_per_page", ["find"], """SELECT rel, finding_id, severity, rank FROM (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY
  CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 WHEN 'Informational' THEN 4 ELSE 9 END, class, evidence, finding_id) AS rank
  FROM find) WHERE rank <= 5""")
oracle("dedup_findings", ["find"], """SELECT finding_id, run, class, severity, rel, evidence FROM find
  QUALIFY row_number() OVER (PARTITION BY run, class, evidence ORDER BY finding_id) = 1""")
ORACLES["union_detectors"] = " UNION ALL ".join(
    f"SELECT '{who}' AS detector_id, rel, class, severity, summary, evidence FROM ({surface_sql.ORACLES[key]})" for who, key in [
        ("surface", "det_missing_header"), ("surface", "det_missing_hsts"), ("surface", "det_clickjacking"),
        ("surface", "det_version_disclosure"), ("surface", "det_permissive_cors"), ("surface", "det_insecure_cookie"),
        ("surface", "det_mixed_content"), ("surface", "det_credentials_over_http"), ("surface", "det_sensitive_url"),
        ("surface", "det_directory_listing"), ("surface", "det_verbose_error"), ("surface", "det_secret_in_bundle"),
        ("surface", "det_sensitive_path"), ("secrets", "det_secret_provider")])
_SECRETS = r"""SELECT 'AWS access key ID' AS rule, '\bAKIA[0-9A-Z]{16}\b' AS p UNION ALL SELECT 'Google API key', '\bAIza[0-9A-Za-z_-]{35}\b'
  UNION ALL SELECT 'Slack token', '\bxox[baprs]-[0-9A-Za-z-]{10,}\b' UNION ALL SELECT 'Stripe secret key', '\bsk_(?:live|test)_[0-9A-Za-z]{16,}\b'
  UNION ALL SELECT 'GitHub token', '\bgh[pousr]_[0-9A-Za-z]{36,}\b' UNION ALL SELECT 'Private key block', '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----'
  UNION ALL SELECT 'JWT', '\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b'"""
oracle("prove_regex", ["sdoc"], f""", p AS ({_SECRETS}), m AS (SELECT doc_id, rule, unnest(regexp_extract_all(text, p)) AS s FROM sdoc, p),
v AS (SELECT doc_id, CASE WHEN doc_id % 30 = 1 THEN 'retired rule' ELSE rule END AS rule, CASE WHEN doc_id % 20 > 9 THEN left(s, 9) ELSE s END AS value FROM m)
SELECT v.doc_id, v.rule, v.value, regexp_matches(v.value, p.p) AS proven FROM v LEFT JOIN p ON v.rule = p.rule""")
_ASSIGN = r"""'(?i)\b[0-9a-z_]*(?:secret|token|passwd|password|pwd|api_?key|access_?key|private_?key|credential)[0-9a-z_]*[ \t]*[:=][ \t]*(?:"[^"\n]{8,}"|''[^''\n]{8,}'')'"""
oracle("secret_report", ["sdoc"], f""", p AS (SELECT 0 AS kind, rule, p FROM ({_SECRETS}) UNION ALL SELECT 1, 'assignment', {_ASSIGN}),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM sdoc),
h AS (SELECT kind, rule, doc_id, line, regexp_extract_all(x, p) AS hits, string_split_regex(x, p) AS pieces FROM l, p WHERE regexp_matches(x, p)),
k AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM h),
f AS (SELECT 'doc/' || doc_id AS rel, line, CAST(1 + list_sum(list_transform(pieces[1:i], lambda e: length(e))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda e: length(e))), 0) AS BIGINT) AS col,
  CASE kind WHEN 0 THEN 'Critical' ELSE 'High' END AS severity, CASE kind WHEN 0 THEN 'confirmed' ELSE 'unconfirmed' END AS section,
  CASE kind WHEN 0 THEN rule || ' in text' ELSE 'literal assigned to a secret-named variable' END AS summary,
  CASE kind WHEN 0 THEN hits[i] ELSE left(regexp_replace(hits[i], '^[^"'']*["'']', ''), length(regexp_replace(hits[i], '^[^"'']*["'']', '')) - 1) END AS v FROM k),
e AS (SELECT *, CASE WHEN length(v) > 12 THEN left(v, 6) || '…' || right(v, 2) ELSE v END AS evidence FROM f),
r AS (SELECT *, row_number() OVER (ORDER BY section, CASE severity WHEN 'Critical' THEN 0 ELSE 1 END, rel, line, col, summary, evidence) AS rank FROM e)
SELECT rel, 'Hardcoded Secret' AS class, severity, section, line, col, summary, evidence, rank, {_ID} AS id FROM r""")

oracle("rule_rows_scan", ["sdoc"], f""", p AS ({_SECRETS}),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM sdoc),
h AS (SELECT rule, doc_id, line, regexp_extract_all(x, p) AS hits, string_split_regex(x, p) AS pieces FROM l, p WHERE regexp_matches(x, p)),
k AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM h)
SELECT 'doc/' || doc_id AS rel, 'Hardcoded Secret' AS class, 'Critical' AS severity, 'confirmed' AS section, line,
  CAST(1 + list_sum(list_transform(pieces[1:i], lambda e: length(e))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda e: length(e))), 0) AS BIGINT) AS col,
  rule || ' in text' AS summary, CASE WHEN length(hits[i]) > 12 THEN left(hits[i], 6) || '…' || right(hits[i], 2) ELSE hits[i] END AS evidence FROM k""")
