"""Independent SQL for the text, URL and surface queries, written from the rule texts."""

from __future__ import annotations

from ramparts.sources.derived import with_tables

ORACLES: dict[str, str] = {}


def oracle(name: str, tables: list[str], body: str) -> None:
    ORACLES[name] = with_tables(tables, body) if tables else body.strip()


_UNIT = r"""CASE WHEN regexp_matches(rel, '(?i)(auth|login|session|jwt|passport|oauth|token|password)') THEN 'auth'
  WHEN regexp_matches(rel, '(?i)(route|router|controller|endpoint|api|handler|middleware)') THEN 'routing'
  WHEN regexp_matches(rel, '(?i)(model|schema|repository|dao|query|migration|entity|prisma|sequelize|mongoose)') THEN 'database'
  WHEN regexp_matches(rel, '(?i)(crypt|cipher|hash|hmac|sign|secret|key)') THEN 'crypto'
  WHEN regexp_matches(rel, '(?i)(client|integration|external|webhook|gateway|provider|sdk)') THEN 'integration'
  WHEN regexp_matches(rel, '(?i)(job|queue|worker|cron|task|consumer|scheduler)') THEN 'jobs' ELSE 'business' END"""
_CODE_PATH = r"""regexp_matches(rel, '[^/]\.(js|jsx|ts|tsx|mjs|cjs)$')
  AND NOT regexp_matches(rel, '(^|/)(node_modules|dist|build|coverage|out|vendor|tmp|__snapshots__|\.[^/]*)/')"""

oracle("src_code_files", ["code"], f"SELECT repo, rel, code, {_UNIT} AS unit FROM code WHERE {_CODE_PATH} AND length(code) <= 2000000")
oracle("src_size_cap", [], "SELECT doc_id, text FROM documents WHERE length(text) <= 2000000")
oracle("classify_unit", ["code"], f"""SELECT kind, id, rel, {_UNIT} AS unit FROM (
  SELECT 'code' AS kind, file_id AS id, rel FROM code UNION ALL SELECT 'page', page_id, url FROM pages)""")
oracle("filter_code_path", ["code"], f"SELECT file_id, rel FROM code WHERE {_CODE_PATH}")

_ODD = """SELECT page_id, CASE page_id % 8 WHEN 3 THEN substring(url, 9) WHEN 5 THEN concat('HTTPS://User@', upper(substring(url, 9)))
  WHEN 6 THEN concat('http://h', page_id, '.example:', page_id % 3 * 40, '/p') WHEN 7 THEN 'http:// no host/' ELSE url END AS url FROM pages"""
_VALID = r"regexp_matches(url, '(?i)^https?://([^/?#@]*@)?[^\s/?#:@]+(:[0-9]*)?([/?#].*)?$')"
oracle("url_validity", [], f"SELECT page_id, url, {_VALID} AS valid FROM ({_ODD})")
oracle("url_origin", [], rf"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS sch,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^.*@', '') AS auth FROM ({_ODD}) WHERE {_VALID})
  SELECT page_id, sch || '://' || CASE WHEN sch = 'http' AND auth LIKE '%:80' THEN left(auth, length(auth) - 3)
    WHEN sch = 'https' AND auth LIKE '%:443' THEN left(auth, length(auth) - 4) ELSE auth END AS origin, sch = 'https' AS is_https FROM u""")
oracle("url_resolve", ["web"], r""", links AS (
  SELECT page_id, url, unnest(refs) AS ref0, unnest(range(len(refs))) AS pos FROM (
    SELECT page_id, url, regexp_extract_all(html, '(?i)(?:src|href)\s*=\s*["'']([^"'']*)["'']', 1) AS refs FROM web)),
varied AS (SELECT page_id, url, pos, CASE pos % 6 WHEN 1 THEN concat('..', ref0, '/./x') WHEN 2 THEN concat('?q=', substring(ref0, 2))
  WHEN 3 THEN concat('#', substring(ref0, 2)) WHEN 4 THEN CASE WHEN ref0 LIKE '/%' THEN substring(ref0, 2) ELSE ref0 END ELSE ref0 END AS ref FROM links),
parts AS (SELECT *, lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) AS org,
  CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) END AS bpath,
  regexp_extract(url, '^https?://[^/?#]*[^?#]*(\?[^#]*)', 1) AS bquery FROM varied),
aim AS (SELECT *, CASE WHEN regexp_matches(ref, '^https?://') THEN lower(regexp_extract(ref, '^(https?://[^/?#]*)', 1))
    WHEN ref LIKE '//%' THEN lower(regexp_extract(url, '^(https?:)', 1) || regexp_extract(ref, '^(//[^/?#]*)', 1)) ELSE org END AS org2,
  CASE WHEN regexp_matches(ref, '^https?://') THEN regexp_extract(ref, '^https?://[^/?#]*([^?#]*)', 1)
    WHEN ref LIKE '//%' THEN regexp_extract(ref, '^//[^/?#]*([^?#]*)', 1)
    WHEN ref = '' OR ref LIKE '#%' OR ref LIKE '?%' THEN NULL WHEN ref LIKE '/%' THEN regexp_extract(ref, '^([^?#]*)', 1)
    ELSE regexp_extract(bpath, '^(.*/)', 1) || regexp_extract(ref, '^([^?#]*)', 1) END AS raw,
  CASE WHEN ref = '' THEN bquery WHEN ref LIKE '#%' THEN bquery || ref WHEN ref LIKE '?%' THEN ref
    ELSE regexp_extract(regexp_replace(ref, '^(https?:)?//[^/?#]*', ''), '^[^?#]*(.*)$', 1) END AS rest FROM parts),
seg AS (SELECT *, string_split(regexp_replace(raw, '^/', ''), '/') AS s FROM aim),
folded AS (SELECT *, list_reduce(list_prepend([]::VARCHAR[], list_transform(s, lambda e: [e])), lambda a, x:
    CASE WHEN x[1] = '..' THEN a[1:len(a) - 1] WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END) AS f FROM seg)
SELECT page_id, pos, ref, org2 || CASE WHEN raw IS NULL THEN bpath ELSE '/' || array_to_string(
    CASE WHEN s[len(s)] IN ('.', '..') THEN list_append(f, '') ELSE f END, '/') END || rest AS resolved FROM folded""")
oracle("url_sensitive_param", ["web"], """SELECT page_id, url FROM web
  WHERE regexp_matches(url, '(?i)[?&](token|jwt|session|sessionid|access_token|api_key|apikey|password|pwd)=')""")
oracle("url_public_host", [], r"""WITH u AS (SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'http://127.0.0.1/' WHEN 1 THEN concat('http://10.1.2.', page_id % 256, ':8080/x')
  WHEN 2 THEN concat('http://172.', page_id % 40, '.0.1/') WHEN 3 THEN 'https://192.168.1.9' WHEN 4 THEN 'http://169.254.169.254/latest'
  WHEN 5 THEN concat('http://100.', page_id % 200, '.3.4/') WHEN 6 THEN 'http://[::1]/' WHEN 7 THEN 'http://[fd00::12]:80/'
  WHEN 8 THEN 'http://printer.local/' WHEN 9 THEN 'http://[::ffff:10.0.0.1]/' WHEN 10 THEN 'ftp://files.example/' ELSE url END AS url FROM pages),
h AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://(\[[^\]]*\]|[^/:?#]*)', 1)) AS host FROM u),
v AS (SELECT *, regexp_extract(host, '([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\]?$', 1) AS ip FROM h)
SELECT page_id, url, CASE WHEN url NOT LIKE 'http%' THEN 'invalid'
  WHEN regexp_matches(host, '^localhost$|\.local$|\.internal$') THEN 'private-name'
  WHEN ip <> '' THEN CASE WHEN ip LIKE '127.%' THEN 'loopback' WHEN ip LIKE '0.%' OR ip LIKE '10.%' OR ip LIKE '192.168.%' THEN 'private'
    WHEN ip LIKE '172.%' AND CAST(split_part(ip, '.', 2) AS INT) BETWEEN 16 AND 31 THEN 'private' WHEN ip LIKE '169.254.%' THEN 'link-local'
    WHEN ip LIKE '100.%' AND CAST(split_part(ip, '.', 2) AS INT) BETWEEN 64 AND 127 THEN 'carrier-nat' ELSE 'public' END
  WHEN host IN ('[::1]', '[::]') THEN 'loopback' WHEN regexp_matches(host, '^\[f[cd]') THEN 'private' WHEN host LIKE '[fe80%' THEN 'link-local'
  ELSE 'public' END AS host_class FROM v""")
oracle("redact_secret", [], """SELECT doc_id, pos, CASE WHEN length(word) > 12 THEN left(word, 6) || '…' || right(word, 2) ELSE word END AS shown
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents) WHERE length(word) > 10""")
oracle("norm_headers", ["cap"], """SELECT capture_id, 'server' AS name, coalesce(x_powered_by, server) AS value FROM cap WHERE coalesce(x_powered_by, server) IS NOT NULL
  UNION ALL SELECT capture_id, 'x-frame-options', xfo FROM cap WHERE xfo IS NOT NULL""")
oracle("match_evidence", [], """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS evidence, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
m AS (SELECT *, regexp_extract_all(evidence, '[0-9]{4,}') AS hits, string_split_regex(evidence, '[0-9]{4,}') AS pieces FROM l WHERE regexp_matches(evidence, '[0-9]{4,}')),
k AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)
SELECT doc_id, line, CAST(1 + list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS col,
  hits[i] AS match, evidence FROM k""")
oracle("det_secret_provider", ["sdoc"], r""", m AS (
  SELECT doc_id, 'AWS access key ID' AS rule, unnest(regexp_extract_all(text, '\bAKIA[0-9A-Z]{16}\b')) AS s FROM sdoc
  UNION ALL SELECT doc_id, 'Google API key', unnest(regexp_extract_all(text, '\bAIza[0-9A-Za-z_-]{35}\b')) FROM sdoc
  UNION ALL SELECT doc_id, 'Slack token', unnest(regexp_extract_all(text, '\bxox[baprs]-[0-9A-Za-z-]{10,}\b')) FROM sdoc
  UNION ALL SELECT doc_id, 'Stripe secret key', unnest(regexp_extract_all(text, '\bsk_(?:live|test)_[0-9A-Za-z]{16,}\b')) FROM sdoc
  UNION ALL SELECT doc_id, 'GitHub token', unnest(regexp_extract_all(text, '\bgh[pousr]_[0-9A-Za-z]{36,}\b')) FROM sdoc
  UNION ALL SELECT doc_id, 'Private key block', unnest(regexp_extract_all(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----')) FROM sdoc
  UNION ALL SELECT doc_id, 'JWT', unnest(regexp_extract_all(text, '\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b')) FROM sdoc)
SELECT 'doc/' || doc_id AS rel, 'Hardcoded Secret' AS class, 'Critical' AS severity, 'confirmed' AS section, rule || ' in text' AS summary,
  CASE WHEN length(s) > 12 THEN left(s, 6) || '…' || right(s, 2) ELSE s END AS evidence FROM m""")
_ASSIGN = r"""'(?i)\b[0-9a-z_]*(?:secret|token|passwd|password|pwd|api_?key|access_?key|private_?key|credential)[0-9a-z_]*[ \t]*[:=][ \t]*(?:"[^"\n]{8,}"|''[^''\n]{8,}'')'"""
oracle("det_secret_assignment", ["adoc"], rf""", t AS (SELECT 'doc/' || doc_id AS rel, text FROM adoc UNION ALL SELECT 'page/' || page_id, html FROM pages),
l AS (SELECT rel, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM t WHERE regexp_matches(text, {_ASSIGN})),
m0 AS (SELECT *, regexp_extract_all(x, {_ASSIGN}) AS hits, string_split_regex(x, {_ASSIGN}) AS pieces FROM l),
m AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m0),
q AS (SELECT *, regexp_replace(hits[i], '^[^"'']*["'']', '') AS tail FROM m),
s AS (SELECT *, left(tail, length(tail) - 1) AS v FROM q)
SELECT rel, 'Hardcoded Secret' AS class, 'High' AS severity, 'unconfirmed' AS section,
  CASE WHEN length(v) > 12 THEN left(v, 6) || '…' || right(v, 2) ELSE v END AS evidence, line,
  CAST(1 + list_sum(list_transform(pieces[1:i], lambda e: length(e))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda e: length(e))), 0) AS BIGINT) AS col FROM s""")

# ---- surface ---------------------------------------------------------------------------------


def surface(name, tables, cls, severity, summary, evidence, source):
    oracle(name, tables, f"""SELECT url AS rel, '{cls}' AS class, {severity} AS severity, 'confirmed' AS section,
  {summary} AS summary, {evidence} AS evidence FROM {source}""")


surface("det_missing_header", ["cap"], "Missing Security Header", "sev", "'no ' || name || ' header'", "'GET ' || url || ' answered without ' || name", """(
  SELECT url, 'Content-Security-Policy' AS name, 'Medium' AS sev FROM cap WHERE coalesce(csp, '') = ''
  UNION ALL SELECT url, 'X-Content-Type-Options', 'Low' FROM cap WHERE coalesce(xcto, '') = ''
  UNION ALL SELECT url, 'Referrer-Policy', 'Low' FROM cap WHERE coalesce(referrer_policy, '') = ''
  UNION ALL SELECT url, 'Permissions-Policy', 'Informational' FROM cap WHERE coalesce(permissions_policy, '') = '')""")
surface("det_missing_hsts", ["cap"], "Missing Security Header", "'Medium'", "'no Strict-Transport-Security header'",
        "'GET ' || url || ' answered over HTTPS without HSTS'", "cap WHERE url LIKE 'https:%' AND coalesce(hsts, '') = ''")
surface("det_clickjacking", ["cap"], "Clickjacking Exposure", "'Medium'", "'page can be framed by any site'", "'GET ' || url || ' restricts framing nowhere'",
        "cap WHERE coalesce(xfo, '') = '' AND coalesce(csp, '') NOT ILIKE '%frame-ancestors%'")
surface("det_version_disclosure", ["cap"], "Version Disclosure", "'Informational'", "k || ' names a version'", "k || ': ' || v", """(
  SELECT url, 'server' AS k, server AS v FROM cap UNION ALL SELECT url, 'x-powered-by', x_powered_by FROM cap) WHERE regexp_matches(v, '[0-9]')""")
surface("det_insecure_cookie", ["cookie"], "Insecure Cookie", "CASE WHEN regexp_matches(name, '(?i)sess|sid|token|auth|jwt') THEN 'Medium' ELSE 'Low' END",
        "'cookie ' || name || ' lacks ' || flag", "'Set-Cookie: ' || cookie", """(
  SELECT url, cookie, trim(split_part(cookie, '=', 1)) AS name, 'HttpOnly' AS flag FROM cookie WHERE cookie NOT ILIKE '%httponly%'
  UNION ALL SELECT url, cookie, trim(split_part(cookie, '=', 1)), 'Secure' FROM cookie WHERE url LIKE 'https:%' AND cookie NOT ILIKE '%secure%'
  UNION ALL SELECT url, cookie, trim(split_part(cookie, '=', 1)), 'SameSite' FROM cookie WHERE cookie NOT ILIKE '%samesite%')""")
surface("det_permissive_cors", ["cap"], "Permissive CORS", "sev",
        "CASE sev WHEN 'High' THEN 'any origin may read answers' ELSE 'any origin may read public answers' END", "'Access-Control-Allow-Origin: ' || acao", """(
  SELECT *, CASE WHEN acao = request_origin OR (acao = '*' AND acac = 'true') THEN 'High' WHEN acao = '*' THEN 'Low' END AS sev
  FROM cap WHERE request_origin IS NOT NULL AND acao <> '') WHERE sev IS NOT NULL""")
_MIXED = r"""regexp_extract_all(html, '(?i)(?:src|href)\s*=\s*["''](http://[^"'']+)["'']', 1)"""
surface("det_mixed_content", ["web"], "Mixed Content", "'Medium'", "'HTTPS page loads plain HTTP parts'", f"'loads ' || {_MIXED}[1]",
        f"web WHERE url LIKE 'https:%' AND len({_MIXED}) > 0")
surface("det_credentials_over_http", ["web"], "Credentials Over HTTP", "'High'", "'password field on a plain HTTP page'", "'password input on ' || url",
        r"""web WHERE url NOT LIKE 'https:%' AND regexp_matches(html, '(?i)<input[^>]+type\s*=\s*["'']?password')""")
surface("det_sensitive_url", ["web"], "Sensitive Data in URL", "'High'", "'secret value in the query string'", "'query of ' || url",
        "web WHERE regexp_matches(url, '(?i)[?&](token|jwt|session|sessionid|access_token|api_key|apikey|password|pwd)=')")
surface("det_directory_listing", ["web"], "Directory Listing", "'Medium'", "'directory contents are listed'", "url || ' is a generated index'",
        r"web WHERE regexp_matches(html, '(?i)<title>\s*Index of /') OR html ILIKE '%Directory listing for%'")
surface("det_verbose_error", ["web"], "Verbose Error Disclosure", "'Medium'", "'error page shows internals'", "'internals in the answer of ' || url",
        r"web WHERE regexp_matches(html, '(\bat\b .+\(.+:\d+:\d+\)|Traceback \(most recent call last\)|SQLSTATE|ORA-\d+|System\.\w+Exception|stack trace)')")
_FIRST = r"""CASE WHEN regexp_matches(body, '\bAKIA[0-9A-Z]{16}\b') THEN ['AWS access key ID', regexp_extract(body, '\bAKIA[0-9A-Z]{16}\b')]
  WHEN regexp_matches(body, '\bAIza[0-9A-Za-z_-]{35}\b') THEN ['Google API key', regexp_extract(body, '\bAIza[0-9A-Za-z_-]{35}\b')]
  WHEN regexp_matches(body, '\bxox[baprs]-[0-9A-Za-z-]{10,}\b') THEN ['Slack token', regexp_extract(body, '\bxox[baprs]-[0-9A-Za-z-]{10,}\b')]
  WHEN regexp_matches(body, '\bsk_(live|test)_[0-9A-Za-z]{16,}\b') THEN ['Stripe secret key', regexp_extract(body, '\bsk_(live|test)_[0-9A-Za-z]{16,}\b')]
  WHEN regexp_matches(body, '\bgh[pousr]_[0-9A-Za-z]{36,}\b') THEN ['GitHub token', regexp_extract(body, '\bgh[pousr]_[0-9A-Za-z]{36,}\b')]
  WHEN regexp_matches(body, '-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----') THEN ['Private key block', regexp_extract(body, '-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----')]
  WHEN regexp_matches(body, '\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b') THEN ['JWT', regexp_extract(body, '\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b')] END"""
_SCRIPTS = "(SELECT page_id, origin || path AS url, body FROM asset WHERE path LIKE '%.js')"
surface("det_secret_in_bundle", ["asset"], "Secret in JS Bundle", "'Critical'", "s[1] || ' in a client script'",
        "url || ' holds ' || CASE WHEN length(s[2]) > 12 THEN left(s[2], 6) || '…' || right(s[2], 2) ELSE s[2] END",
        f"(SELECT url, {_FIRST} AS s FROM {_SCRIPTS}) WHERE s IS NOT NULL")
oracle("win_first_secret_per_bundle", ["sdoc", "asset"], f""", t AS (SELECT 'doc' AS kind, doc_id AS id, text AS body FROM sdoc
  UNION ALL SELECT 'script', page_id, body FROM {_SCRIPTS})
SELECT kind, id, s[1] AS rule, s[2] AS match FROM (SELECT kind, id, {_FIRST} AS s FROM t) WHERE s IS NOT NULL""")
_PATHS = """, rule(path, sev, label) AS (VALUES ('/.env', 'Critical', 'Environment file'), ('/.git/config', 'High', 'Git configuration'),
  ('/.git/HEAD', 'High', 'Git metadata'), ('/config.json', 'Medium', 'Application configuration'), ('/swagger.json', 'Low', 'API schema'),
  ('/api/docs', 'Low', 'API documentation'), ('/actuator/env', 'High', 'Actuator environment'), ('/debug', 'Medium', 'Debug endpoint'),
  ('/metrics', 'Low', 'Metrics endpoint'), ('/server-status', 'Medium', 'Server status page')),
hit AS (SELECT a.page_id, a.origin || a.path AS url, r.sev, r.label FROM asset a JOIN rule r ON a.path = r.path WHERE a.status = 200 AND CASE a.path
  WHEN '/.env' THEN regexp_matches(body, '(?i)=|SECRET|KEY|PASSWORD|TOKEN') WHEN '/.git/config' THEN regexp_matches(body, '(?i)\\[core\\]|remote|url =')
  WHEN '/.git/HEAD' THEN regexp_matches(body, '(?i)ref:\\s*refs/') WHEN '/config.json' THEN body LIKE '%{%'
  WHEN '/metrics' THEN regexp_matches(body, '(?i)# HELP|process_') WHEN '/debug' THEN regexp_matches(body, '(?i)debug|trace|stack')
  WHEN '/actuator/env' THEN regexp_matches(body, '(?i)profiles|propertySources') WHEN '/server-status' THEN body ILIKE '%Apache Server Status%'
  WHEN '/swagger.json' THEN regexp_matches(body, '(?i)swagger|openapi') ELSE regexp_matches(body, '(?i)swagger|redoc|openapi') END)""".replace("\\\\", "\\")
oracle("det_sensitive_path", ["asset"], _PATHS + """ SELECT url AS rel, 'Sensitive Path Exposed' AS class, sev AS severity, 'confirmed' AS section,
  label || ' is public' AS summary, 'GET ' || url || ' answers 200' AS evidence FROM hit""")
oracle("join_sensitive_paths", ["asset"], _PATHS + " SELECT page_id, url AS rel, sev AS severity, label || ' is public' AS summary FROM hit")
_MAPS = r""", js AS (SELECT page_id, origin, origin || path AS url, regexp_extract(body, '//[#@]\s*sourceMappingURL=(\S+)', 1) AS ref FROM asset WHERE path LIKE '%.js'),
want AS (SELECT page_id, CASE WHEN ref = '' THEN url || '.map' ELSE origin || '/js/' || ref END AS map_url FROM js),
hit AS (SELECT page_id, map_url FROM want WHERE map_url IN (SELECT origin || path FROM asset WHERE status = 200))"""
oracle("join_bundle_sourcemap", ["asset"], _MAPS + " SELECT page_id, map_url FROM hit")
oracle("det_sourcemap_exposed", ["asset"], _MAPS + """ SELECT map_url AS rel, 'Source Map Exposed' AS class, 'Medium' AS severity, 'confirmed' AS section,
  'source map is public' AS summary, map_url || ' answers 200' AS evidence FROM hit""")
oracle("ext_sourcemap_url", ["asset"], r"""SELECT page_id, regexp_extract(body, '//[#@]\s*sourceMappingURL=(\S+)', 1) AS map_ref FROM asset
  WHERE path LIKE '%.js' AND regexp_matches(body, '//[#@]\s*sourceMappingURL=\S+')""")
oracle("src_http_captures", ["asset"], """SELECT page_id * 3 + CASE WHEN path LIKE '%.js' THEN 0 WHEN path LIKE '%.map' THEN 1 ELSE 2 END AS capture_id,
  origin || path AS url, CAST(status AS BIGINT) AS status, substring(body, 1, 1500000) AS body FROM asset""")
oracle("pos_http", ["cap", "asset"], """SELECT 'Served over HTTPS' AS label, url AS rel FROM cap WHERE url LIKE 'https:%'
  UNION ALL SELECT 'HSTS configured', url FROM cap WHERE coalesce(hsts, '') <> '' UNION ALL SELECT 'CSP configured', url FROM cap WHERE coalesce(csp, '') <> ''
  UNION ALL SELECT 'Served over HTTPS', origin || path FROM asset WHERE origin LIKE 'https:%'
  UNION ALL SELECT 'security.txt present', origin || path FROM asset WHERE path = '/.well-known/security.txt' AND status = 200""")
oracle("agg_mixed_content", ["web"], f"""SELECT page_id, len({_MIXED})::BIGINT AS n_refs, {_MIXED}[1] AS first_ref FROM web
  WHERE url LIKE 'https:%' AND len({_MIXED}) > 0""")
_SRC = r"""regexp_extract_all(html, '(?i)<script[^>]+src\s*=\s*["'']([^"'']+)["'']', 1)"""
oracle("ext_script_srcs", ["web"], f"""SELECT page_id, pos, src, CASE WHEN src LIKE '//%' THEN regexp_extract(url, '^(https?:)', 1) || src
    ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || src END AS script_url
  FROM (SELECT page_id, url, unnest({_SRC}) AS src, unnest(range(len({_SRC}))) AS pos FROM web)""")
oracle("ext_inline_scripts", [], r"""SELECT page_id, pos, script FROM (
  SELECT page_id, unnest(s) AS script, unnest(range(len(s))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?is)<script>(.*?)</script', 1) AS s FROM pages))""")
oracle("join_page_bundles", ["web", "asset"], f""", src AS (SELECT page_id, url, unnest({_SRC}) AS s FROM web),
own AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || s AS script_url FROM src WHERE s LIKE '/%' AND s NOT LIKE '//%'),
capt AS (SELECT origin || path AS script_url, page_id * 3 AS capture_id, status FROM asset WHERE path LIKE '%.js')
SELECT own.page_id, CAST(0 AS BIGINT) AS pos, own.script_url, capt.capture_id, CAST(capt.status AS BIGINT) AS status
FROM own JOIN capt ON own.script_url = capt.script_url""")
oracle("win_bundle_cap", ["web"], r""", add AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS org, i FROM web, range(1, 14) r(i) WHERE i <= page_id % 13 + 1 AND i % 4 <> 0),
every AS (SELECT page_id, i, org || '/b' || i || '.js' AS script_url FROM add
  UNION ALL SELECT page_id, 0, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/js/' || page_id || '.js' FROM web WHERE page_id % 7 = 2)
SELECT page_id, pos - 1 AS pos, script_url FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS pos FROM every) WHERE pos <= 8""")
oracle("agg_request_count", ["cap", "asset"], r"""SELECT site, count(*) AS requests FROM (
  SELECT lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS site FROM cap UNION ALL SELECT lower(origin) FROM asset) GROUP BY site""")
