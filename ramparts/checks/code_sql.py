"""Independent SQL for the code queries: what the derived programs hold, stated from how they are built."""

from __future__ import annotations

from ramparts.checks.fact_sql import FX, TAINT
from ramparts.sources.derived import with_tables

ORACLES: dict[str, str] = {}


def oracle(name: str, tables: list[str], body: str) -> None:
    text = with_tables(tables, body)
    ORACLES[name] = text.replace("WITH ", "WITH RECURSIVE ", 1) if "RECURSIVE" not in text else text


_UNIT = r"""CASE WHEN regexp_matches(rel, '(?i)(auth|login|session|jwt|passport|oauth|token|password)') THEN 'auth'
  WHEN regexp_matches(rel, '(?i)(route|router|controller|endpoint|api|handler|middleware)') THEN 'routing'
  WHEN regexp_matches(rel, '(?i)(model|schema|repository|dao|query|migration|entity|prisma|sequelize|mongoose)') THEN 'database'
  WHEN regexp_matches(rel, '(?i)(crypt|cipher|hash|hmac|sign|secret|key)') THEN 'crypto'
  WHEN regexp_matches(rel, '(?i)(client|integration|external|webhook|gateway|provider|sdk)') THEN 'integration'
  WHEN regexp_matches(rel, '(?i)(job|queue|worker|cron|task|consumer|scheduler)') THEN 'jobs' ELSE 'business' END"""
KEPT = f""", kept AS (SELECT *, file_id % 17 AS s, {_UNIT} AS unit FROM code WHERE regexp_matches(rel, '[^/]\\.(js|jsx|ts|tsx|mjs|cjs)$')
  AND NOT regexp_matches(rel, '(^|/)(node_modules|dist|build|coverage|out|vendor|tmp|__snapshots__|\\.[^/]*)/'))"""
PART = """, n AS (SELECT count(*) AS n FROM part), p AS (SELECT p_partkey AS id, p_size AS z, (p_partkey * 7 + 3) % n AS m, CASE WHEN p_size % 3 = 1 THEN 5 ELSE 4 END AS hend FROM part, n)"""


def mod(name: str, body: str) -> None:
    oracle(name, ["mod"], PART + body)


mod("lex_functions", """ SELECT id AS file_id, 'h' || id AS name, 'function' AS kind, false AS is_async, CAST(2 AS BIGINT) AS start_line, CAST(hend AS BIGINT) AS end_line, CAST(1 AS BIGINT) AS col FROM p
  UNION ALL SELECT id, 'g' || id, 'arrow', true, hend + 1, hend + 4, 7 FROM p""")
mod("lex_calls", """ SELECT id AS file_id, 'id' AS callee_kind, CAST(NULL AS VARCHAR) AS obj, 'require' AS name, CAST(1 AS BIGINT) AS line,
    CAST(CASE WHEN z % 4 = 1 THEN 14 + length('h' || m) ELSE 12 END AS BIGINT) AS col, CAST(1 AS BIGINT) AS n_args, 'string' AS arg0_kind, '' AS arg0_refs, false AS in_function FROM p WHERE z % 4 IN (1, 3)
  UNION ALL SELECT id, 'member', 'db', 'query', 3, 10, 1, 'plus', 'id', true FROM p WHERE z % 3 = 0
  UNION ALL SELECT id, 'id', NULL, 'exec', 4, 3, 1, 'identifier', 'sql', true FROM p WHERE z % 3 = 1
  UNION ALL SELECT id, 'id', NULL, 'h' || CASE WHEN z % 4 < 2 THEN m ELSE id END, hend + 3, 3, 2, 'identifier', 'v', true FROM p""")
mod("lex_bindings", """ SELECT id AS file_id, CAST(1 AS BIGINT) AS line, 'fs' AS lhs, '' AS refs, false AS has_source FROM p WHERE z % 4 = 3
  UNION ALL SELECT id, 3, 'sql', 'id', false FROM p WHERE z % 3 = 1
  UNION ALL SELECT id, hend + 1, 'g' || id, '', false FROM p UNION ALL SELECT id, hend + 2, 'v', '', z % 2 = 0 FROM p""")
mod("lex_imports", """ SELECT id AS file_id, 'h' || m AS local, '../m' || (m % 20) || '/f' || m AS source, 'h' || m AS imported FROM p WHERE z % 4 IN (0, 1)
  UNION ALL SELECT id, 'lodash', 'lodash', 'default' FROM p WHERE z % 4 = 2 UNION ALL SELECT id, 'fs', 'fs', '*' FROM p WHERE z % 4 = 3""")
mod("lex_exports", " SELECT id AS file_id, 'h' || id AS export_name, 'h' || id AS fn_name FROM p")
mod("taint_code", """, hit AS (SELECT DISTINCT CASE WHEN z % 4 < 2 THEN m ELSE id END AS callee FROM p WHERE z % 2 = 0)
SELECT id AS file_id, 'g' || id AS fn_name, 'v' AS name FROM p WHERE z % 2 = 0
  UNION ALL SELECT callee, 'h' || callee, 'id' FROM hit UNION ALL SELECT p.id, 'h' || p.id, 'sql' FROM p JOIN hit ON p.id = hit.callee WHERE z % 3 = 1""")
oracle("src_request_member", ["code"], r""", m AS (SELECT file_id, CASE file_id % 17 WHEN 0 THEN 'req.query.id' WHEN 1 THEN 'req.query.id' WHEN 2 THEN 'req.body.dir'
  WHEN 3 THEN 'req.params.name' WHEN 8 THEN 'req.params.id' WHEN 9 THEN 'req.params.id' END AS member FROM code) SELECT file_id, member FROM m WHERE member IS NOT NULL""")
oracle("src_request_call", ["fw"], """ SELECT p_partkey AS file_id, unnest(['request.json(', 'request.nextUrl.searchParams.get(']) AS call FROM part WHERE p_size % 4 = 3""")
oracle("src_decorated_params", ["fw"], " SELECT p_partkey AS file_id, CAST(3 AS BIGINT) AS line, 'key' || p_partkey AS name FROM part WHERE p_size % 4 = 0")
oracle("src_graphql_args", ["fw"], """ SELECT p_partkey AS file_id, CAST(3 AS BIGINT) AS line, 'args' AS name FROM part WHERE p_size % 4 = 1
  UNION ALL SELECT p_partkey, 4, unnest(['term' || p_partkey, 'alias']) FROM part WHERE p_size % 4 = 1""")
oracle("src_trpc_input", ["fw"], """ SELECT p_partkey AS file_id, CAST(4 AS BIGINT) AS line, 'input' AS name FROM part WHERE p_size % 4 = 2
  UNION ALL SELECT p_partkey, 7, 'inp' || p_partkey FROM part WHERE p_size % 4 = 2""")
oracle("scan_framework_code", ["fw"], """ SELECT rel, 'SQL Injection' AS class, 'Critical' AS severity, 'confirmed' AS section, CAST(line AS BIGINT) AS line, 'built text given to query' AS summary, 'business' AS unit
  FROM (SELECT file_id, rel, unnest(CASE p_size % 4 WHEN 0 THEN [4] WHEN 1 THEN [3, 4] WHEN 2 THEN [5] ELSE [5] END) AS line FROM fw JOIN part ON p_partkey = file_id)""")

# ---- call sites ------------------------------------------------------------------------------------

SITES = TAINT + """, site AS (SELECT *, CASE WHEN name = 'sign' AND order_key % 7 = 0 THEN 'decode' WHEN name = 'createCipheriv' AND order_key % 9 = 0 THEN 'createCipher' ELSE name END AS nm,
  'file/' || file_id AS rel, arg0_has_source OR EXISTS (SELECT 1 FROM t WHERE t.fn_id = c.fn_id AND t.name = c.arg0_ref) AS hot FROM fx_call c)"""


def site(name: str, cls: str, severity: str, section: str, summary: str, where: str) -> None:
    ORACLES[name] = with_tables(FX, SITES + f""" SELECT rel, '{cls}' AS class, '{severity}' AS severity, {section} AS section, CAST(line AS BIGINT) AS line, {summary} AS summary
  FROM site WHERE {where}""").replace("WITH ", "WITH RECURSIVE ", 1)


_BY_TAINT = "CASE WHEN hot THEN 'confirmed' ELSE 'unconfirmed' END"
site("det_sqli", "SQL Injection", "Critical", _BY_TAINT, "'built text given to query'", "nm = 'query' AND arg0_kind IN ('plus', 'template')")
site("det_command_injection", "Command Injection", "Critical", _BY_TAINT, "'dynamic command given to exec'", "nm = 'exec' AND arg0_kind IN ('plus', 'template', 'identifier')")
site("det_path_traversal", "Path Traversal", "High", _BY_TAINT, "'dynamic path given to readFile'",
     "nm = 'readFile' AND arg0_kind <> 'string' AND (hot OR arg0_kind IN ('plus', 'template') OR (arg0_kind = 'call' AND order_key % 2 = 0))")
_JWT = "JWT Implementation Error"
site("det_jwt_none_alg", _JWT, "Critical", "'unconfirmed'", "'the none algorithm is allowed'", "nm IN ('verify', 'sign') AND option_key = 'none'")
site("det_jwt_no_algorithms", _JWT, "High", "'unconfirmed'", "'verify pins no algorithm'", "nm = 'verify' AND option_key IN ('expiresIn', '')")
site("det_jwt_no_expiry", _JWT, "Medium", "'unconfirmed'", "'signed token never expires'", "nm = 'sign' AND option_key <> 'expiresIn'")
site("det_jwt_decode", _JWT, "High", "'unconfirmed'", "'decode skips the signature'", "nm = 'decode'")
site("det_jwt_literal_secret", _JWT, "High", "'unconfirmed'", "'token secret is a literal'", "nm IN ('verify', 'sign') AND order_key % 5 = 0")
site("det_weak_hash", "Weak Hash Algorithm", "High", "'confirmed'", "'MD5 used as a hash'", "nm = 'createHash' AND lower(arg0_literal) IN ('md5', 'sha1')")
site("det_insecure_cipher", "Insecure Cipher Mode", "High", "'confirmed'", "'insecure cipher: ' || CASE nm WHEN 'createCipher' THEN 'deprecated constructor' ELSE arg0_literal END",
     "nm = 'createCipher' OR (nm = 'createCipheriv' AND arg0_literal LIKE '%ecb%')")
oracle("join_check_then_act", ["fx_function", "fx_call"], """, r AS (SELECT fn_id, min(line * 2 + CASE name WHEN 'findById' THEN 0 ELSE 1 END) AS k FROM fx_call WHERE name IN ('findById', 'findOne') GROUP BY fn_id),
w AS (SELECT c.fn_id, min(c.line) AS wl FROM fx_call c JOIN r ON r.fn_id = c.fn_id AND c.line >= r.k // 2 WHERE c.name = 'save' GROUP BY c.fn_id)
SELECT r.fn_id, CAST(r.k // 2 AS BIGINT) AS read_line, CASE r.k % 2 WHEN 0 THEN 'findById' ELSE 'findOne' END AS read_name, CAST(w.wl AS BIGINT) AS write_line, 'save' AS write_name
FROM r JOIN w USING (fn_id) WHERE fn_id IN (SELECT fn_id FROM fx_function WHERE is_async)""")

# ---- text --------------------------------------------------------------------------------------------


def on_code(name: str, body: str) -> None:
    oracle(name, ["code"], KEPT + body)


on_code("det_insecure_random", """ SELECT rel, 'Insecure Randomness' AS class, 'High' AS severity, 'confirmed' AS section, CAST(3 AS BIGINT) AS line,
  'Math.random() feeds resetToken' AS summary, CAST(9 AS BIGINT) AS col FROM kept WHERE s = 6""")
on_code("det_timing_compare", """ SELECT rel, 'Non-constant-time Comparison' AS class, 'Medium' AS severity, 'unconfirmed' AS section, CAST(3 AS BIGINT) AS line,
  'signature !== expected' AS summary, CAST(7 AS BIGINT) AS col FROM kept WHERE s = 7""")
on_code("det_race_toctou", """ SELECT rel, 'Race Condition (TOCTOU)' AS class, 'High' AS severity, 'unconfirmed' AS section, CAST(3 AS BIGINT) AS line,
  'findOne then save' AS summary, rel || ':3 reads, line 4 writes' AS evidence FROM kept WHERE s = 11""")
on_code("det_object_authz", """ SELECT rel, 'Broken Object-Level Authorization' AS class, 'High' AS severity, 'unconfirmed' AS section, CAST(3 AS BIGINT) AS line,
  'findById by a client id, owner unchecked' AS summary FROM kept WHERE s = 8""")
on_code("antijoin_owner_check", " SELECT rel, 'f' || file_id AS name FROM kept WHERE NOT regexp_matches(code, '(?i)\\breq\\.(user|session|auth|account|principal|currentuser|identity|jwt)\\b|\\b(user_?id|owner_?id|account_?id)\\b')")
on_code("antijoin_concurrency_guard", " SELECT rel, 'f' || file_id AS name FROM kept WHERE s <> 12")
_GOOD = r""" SELECT 'Queries with bound values' AS label, rel FROM kept WHERE regexp_matches(code, '\.(query|execute)\s*\([^)]*\?[^)]*,\s*\[')
  UNION ALL SELECT 'Slow password hash', rel FROM kept WHERE regexp_matches(code, '\b(bcrypt|argon2|scrypt)\b')
  UNION ALL SELECT 'Timing-safe equality', rel FROM kept WHERE code LIKE '%timingSafeEqual%' UNION ALL SELECT 'Tokens from system randomness', rel FROM kept WHERE code LIKE '%crypto.randomBytes%'
  UNION ALL SELECT 'Header middleware', rel FROM kept WHERE regexp_matches(code, '\bhelmet\s*\(')
  UNION ALL SELECT 'Schema validation', rel FROM kept WHERE regexp_matches(code, '\b(zod|joi|yup|express-validator|class-validator)\b')
  UNION ALL SELECT 'Query builder', rel FROM kept WHERE regexp_matches(code, '\b(prisma|knex)\b')"""
on_code("pos_code", _GOOD)
on_code("agg_positive_first", f" SELECT label, min(rel) AS rel FROM ({_GOOD}) GROUP BY label")
on_code("agg_scan_stats", " SELECT count(*) AS files, count(DISTINCT unit) AS units FROM kept")
on_code("agg_unit_counts", " SELECT unit, count(*) AS files FROM kept GROUP BY unit")
_RANDOM = "'  const resetToken = Math.random();'"
_SAFE_RANDOM = "'  const resetToken = crypto.randomBytes(32).toString(''hex'');'"
_COMPARE = "'  if (signature !== expected) { return 0; }'"
_SAFE_COMPARE = "'  if (!crypto.timingSafeEqual(Buffer.from(signature), Buffer.from(expected))) { return 0; }'"
_FIXES = f""" SELECT rel, 'Insecure Randomness' AS class, CAST(3 AS BIGINT) AS line, {_RANDOM} AS before, {_SAFE_RANDOM} AS after, true AS applyable FROM kept WHERE s = 6
  UNION ALL SELECT rel, 'Non-constant-time Comparison', 3, {_COMPARE}, {_SAFE_COMPARE}, true FROM kept WHERE s = 7
  UNION ALL SELECT rel, 'Weak Hash Algorithm', 3, '  const h = crypto.createHash("MD5").update(x);', '  const h = crypto.// hash passwords with bcrypt, scrypt or argon2', false FROM kept WHERE s = 4"""
oracle("suggest_fixes", ["code", "web"], KEPT + _FIXES + r""" UNION ALL SELECT url, 'Mixed Content', 0, m, 'https' || substring(m, 5), false FROM (
  SELECT url, regexp_extract(html, '(?i)(?:src|href)\s*=\s*["''](http://[^"'']+)["'']', 1) AS m FROM web WHERE url LIKE 'https:%') WHERE m <> ''""")
on_code("apply_fixes", f""" SELECT file_id, CASE WHEN file_id % 5 = 0 THEN code WHEN s = 6 THEN replace(code, {_RANDOM}, {_SAFE_RANDOM}) WHEN s = 7 THEN replace(code, {_COMPARE}, {_SAFE_COMPARE}) ELSE code END AS code,
  CAST(CASE WHEN s IN (6, 7) AND file_id % 5 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS applied,
  CAST(CASE WHEN s = 4 OR (s IN (6, 7) AND file_id % 5 = 0) THEN 1 ELSE 0 END AS BIGINT) AS conflicts FROM kept""")
on_code("scan_code_report", """, f(s, class, severity, section, line, summary) AS (VALUES
  (0, 'SQL Injection', 'Critical', 'confirmed', 4, 'built text given to query'), (2, 'Command Injection', 'Critical', 'confirmed', 3, 'dynamic command given to exec'),
  (3, 'Path Traversal', 'High', 'confirmed', 3, 'dynamic path given to readFile'), (4, 'Weak Hash Algorithm', 'High', 'confirmed', 3, 'MD5 used as a hash'),
  (5, 'Insecure Cipher Mode', 'High', 'confirmed', 3, 'insecure cipher: aes-128-ecb'), (6, 'Insecure Randomness', 'High', 'confirmed', 3, 'Math.random() feeds resetToken'),
  (7, 'Non-constant-time Comparison', 'Medium', 'unconfirmed', 3, 'signature !== expected'),
  (8, 'Broken Object-Level Authorization', 'High', 'unconfirmed', 3, 'findById by a client id, owner unchecked'),
  (10, 'JWT Implementation Error', 'Medium', 'unconfirmed', 3, 'signed token never expires'), (10, 'JWT Implementation Error', 'High', 'unconfirmed', 3, 'token secret is a literal'),
  (11, 'Race Condition (TOCTOU)', 'High', 'unconfirmed', 3, 'findOne then save'), (13, 'SQL Injection', 'Critical', 'unconfirmed', 3, 'built text given to query'),
  (14, 'JWT Implementation Error', 'High', 'unconfirmed', 3, 'verify pins no algorithm'), (14, 'JWT Implementation Error', 'High', 'unconfirmed', 4, 'decode skips the signature'),
  (15, 'JWT Implementation Error', 'Critical', 'unconfirmed', 3, 'the none algorithm is allowed'))
SELECT rel, class, severity, section, CAST(line AS BIGINT) AS line, summary, unit FROM kept JOIN f USING (s)""")
