"""Deterministic tables derived from the given ones.

Each text is plain SQL that Spark and DuckDB read alike: here it becomes a
DataFrame, in an oracle a common table expression. Every derived table grows
with the given table it is built from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

SQL: dict[str, str] = {}

SQL["cap"] = """
SELECT page_id AS capture_id, url, 200 AS status,
  CASE WHEN page_id % 4 <> 3 THEN 'https://probe.example' END AS request_origin,
  CASE WHEN page_id % 4 = 1 THEN 'default-src self' WHEN page_id % 4 >= 2 THEN 'default-src self; Frame-Ancestors none' END AS csp,
  CASE WHEN page_id % 5 <> 0 THEN 'nosniff' END AS xcto,
  CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 7 <> 1 THEN 'no-referrer' END AS referrer_policy,
  CASE WHEN page_id % 11 <> 0 THEN 'geolocation=()' END AS permissions_policy,
  CASE WHEN page_id % 13 < 4 THEN 'DENY' END AS xfo,
  CASE WHEN page_id % 17 > 5 THEN 'max-age=31536000' END AS hsts,
  CASE WHEN page_id % 5 = 1 THEN 'nginx' WHEN page_id % 5 = 2 THEN 'nginx/1.18.0' END AS server,
  CASE WHEN page_id % 19 = 0 THEN 'Framework 4.17' END AS x_powered_by,
  CASE WHEN page_id % 9 = 0 THEN 'https://probe.example' WHEN page_id % 9 = 3 THEN '*' WHEN page_id % 9 = 6 THEN 'https://ok.example' END AS acao,
  CASE WHEN page_id % 2 = 0 THEN 'true' END AS acac
FROM pages
"""

SQL["cookie"] = """
SELECT page_id AS capture_id, url, concat('sid=', CAST(page_id AS STRING), '; Path=/',
  CASE WHEN page_id % 2 = 0 THEN '; HttpOnly' ELSE '' END, CASE WHEN page_id % 3 = 0 THEN '; Secure' ELSE '' END,
  CASE WHEN page_id % 5 = 0 THEN '; SameSite=Lax' ELSE '' END) AS cookie FROM pages
UNION ALL
SELECT page_id, url, concat(' theme =dark', CASE WHEN page_id % 4 = 0 THEN '; secure; httponly; samesite=strict' ELSE '' END)
FROM pages WHERE page_id % 2 = 1
"""

SQL["web"] = """
SELECT page_id, concat(url, CASE WHEN page_id % 10 = 3 THEN CASE WHEN url LIKE '%?%' THEN '&token=x' ELSE '?Session=x' END ELSE '' END) AS url,
  concat(html, CASE WHEN page_id % 7 = 0 THEN '<img src="http://cdn.example/a.png"><a HREF = ''http://cdn.example/b''>b</a>' ELSE '' END,
    CASE WHEN page_id % 7 = 1 THEN '<input name="p" type="password">' ELSE '' END,
    CASE WHEN page_id % 7 = 2 THEN concat('<script src="/js/', CAST(page_id AS STRING), '.js"></script><script src="//other.example/x.js"></script>') ELSE '' END,
    CASE WHEN page_id % 7 = 3 THEN '<title>Index of /files</title>' ELSE '' END,
    CASE WHEN page_id % 7 = 4 THEN 'Error: x at Object.run (/srv/app.js:10:15)' ELSE '' END) AS html
FROM pages
"""

SQL["asset"] = """
SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, concat('/js/', CAST(page_id AS STRING), '.js') AS path, 200 AS status,
  concat('var a=1;', CASE WHEN page_id % 4 = 0 THEN concat('k="AK', 'IA', lpad(CAST(page_id AS STRING), 16, '0'), '";') ELSE '' END,
    CASE WHEN page_id % 6 = 0 THEN concat('p="sk_', 'live_', lpad(CAST(page_id AS STRING), 20, '0'), '";') ELSE '' END,
    CASE WHEN page_id % 3 = 0 THEN concat(chr(10), '//# sourceMappingURL=', CAST(page_id AS STRING), '.js.map') ELSE '' END) AS body
FROM pages
UNION ALL
SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1), concat('/js/', CAST(page_id AS STRING), '.js.map'),
  CASE WHEN page_id % 2 = 0 THEN 200 ELSE 404 END, '{"version":3}' FROM pages
UNION ALL
SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1),
  CASE page_id % 5 WHEN 0 THEN '/.env' WHEN 1 THEN '/.git/HEAD' WHEN 2 THEN '/metrics' WHEN 3 THEN '/config.json' ELSE '/.well-known/security.txt' END,
  CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END,
  CASE page_id % 5 WHEN 0 THEN 'A_KEY=1' WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN 'ref: refs/heads/main' ELSE 'nothing' END WHEN 2 THEN '# HELP up' WHEN 3 THEN '{}' ELSE 'Contact: x' END
FROM pages
"""

SQL["code"] = """
SELECT o_orderkey AS file_id, concat('repo', CAST(o_custkey % 40 AS STRING)) AS repo,
  concat(CASE o_orderkey % 8 WHEN 0 THEN 'src/auth/' WHEN 1 THEN 'src/routes/' WHEN 2 THEN 'lib/models/' WHEN 3 THEN 'lib/crypto/' WHEN 4 THEN 'node_modules/x/' WHEN 5 THEN 'jobs/' WHEN 6 THEN '.next/' ELSE 'lib/util/' END,
    'f', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 9 = 0 THEN '.md' WHEN o_orderkey % 9 < 5 THEN '.js' ELSE '.ts' END) AS rel,
  concat('// file ', CAST(o_orderkey AS STRING), chr(10), 'async function f', CAST(o_orderkey AS STRING), '(req, res) {', chr(10),
   CASE o_orderkey % 17
    WHEN 0 THEN concat('  const id = req.query.id;', chr(10), '  return db.query("SELECT 1 WHERE a = " + id);')
    WHEN 1 THEN '  return db.query("SELECT 1 WHERE a = ?", [req.query.id]);'
    WHEN 2 THEN '  exec("ls " + req.body.dir);'
    WHEN 3 THEN '  fs.readFile("/data/" + req.params.name, cb);'
    WHEN 4 THEN '  const h = crypto.createHash("MD5").update(x);'
    WHEN 5 THEN '  const c = crypto.createCipheriv("aes-128-ecb", k, null);'
    WHEN 6 THEN '  const resetToken = Math.random();'
    WHEN 7 THEN '  if (signature !== expected) { return 0; }'
    WHEN 8 THEN '  return Item.findById(req.params.id);'
    WHEN 9 THEN '  return Item.findOne({ id: req.params.id, owner: req.user.id });'
    WHEN 10 THEN '  const t = jwt.sign({ id: 1 }, "fixed-value");'
    WHEN 11 THEN concat('  const w = await Item.findOne({ a: 1 });', chr(10), '  await w.save();')
    WHEN 12 THEN concat('  // no transaction here', chr(10), '  const w = await Item.count();', chr(10), '  await db.transaction(x);', chr(10), '  await w.save();')
    WHEN 13 THEN '  return db.query("SELECT " + columnName + " FROM t");'
    WHEN 14 THEN concat('  const c = jwt.verify(tok, key);', chr(10), '  const d = jwt.decode(tok);')
    WHEN 15 THEN '  const c = jwt.verify(tok, key, { algorithms: ["none"] });'
    ELSE '  const p = await bcrypt.hash(q, 12);' END, chr(10), '}') AS code
FROM orders
"""

SQL["fn_edge"] = """
SELECT p_partkey AS src_fn, CAST(p_size % 2 AS INT) AS src_pos, (p_partkey * 7 + 3) % n AS dst_fn, CAST((p_size + 1) % 2 AS INT) AS dst_pos
FROM part CROSS JOIN (SELECT count(*) AS n FROM part) t WHERE p_size % 3 <> 0
UNION ALL
SELECT p_partkey, CAST(p_size % 2 AS INT), (p_partkey * 11 + 5) % n, CAST(p_size % 2 AS INT)
FROM part CROSS JOIN (SELECT count(*) AS n FROM part) t WHERE p_size % 2 = 0
"""

SQL["fn_seed"] = """
SELECT p_partkey AS fn, CAST(p_size % 2 AS INT) AS pos FROM part WHERE p_partkey % 97 = 0
"""

SQL["find"] = """
SELECT event_id AS finding_id, concat('run', CAST(user_id % 3 AS STRING)) AS run, concat('class-', event_type) AS class,
  CASE user_id % 6 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low' WHEN 4 THEN 'Informational' ELSE 'Other' END AS severity,
  CASE WHEN event_id % 4 = 0 THEN 'runnable' ELSE 'repro' END AS proof_kind,
  CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 3 = 1 THEN false END AS signal,
  concat('src/u', CAST(user_id AS STRING), '.js') AS rel, CAST(event_id % 500 AS INT) AS line, props AS evidence
FROM events
"""

SQL["fx_file"] = """
SELECT p_partkey AS file_id, concat('src/m', CAST(p_partkey % 20 AS STRING), '/f', CAST(p_partkey AS STRING),
  CASE p_partkey % 4 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' WHEN 2 THEN '/index.js' ELSE '.cjs' END) AS rel FROM part
"""

SQL["fx_import"] = """
SELECT p_partkey AS file_id, 'g' AS local,
  CASE WHEN p_size % 7 = 0 THEN 'lodash' ELSE concat(CASE WHEN p_partkey % 4 = 2 THEN '../../m' ELSE '../m' END,
    CAST(((p_partkey * 7 + 3) % n) % 20 AS STRING), '/f', CAST((p_partkey * 7 + 3) % n AS STRING), CASE WHEN p_size % 6 = 1 THEN '.js' ELSE '' END) END AS source,
  CASE p_size % 3 WHEN 0 THEN 'default' WHEN 1 THEN '*' ELSE concat('h', CAST((p_partkey * 7 + 3) % n AS STRING)) END AS imported
FROM part CROSS JOIN (SELECT count(*) AS n FROM part) t
"""

SQL["fx_function"] = """
SELECT p_partkey * 2 AS fn_id, p_partkey AS file_id, concat('f', CAST(p_partkey % 500 AS STRING)) AS name, 'req' AS p0, 'res' AS p1, p_size % 2 = 0 AS is_async FROM part
UNION ALL
SELECT p_partkey * 2 + 1, p_partkey, concat('h', CAST(p_partkey AS STRING)), 'id', CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'opt' END, p_size % 3 = 0 FROM part
"""

SQL["fx_export"] = """
SELECT p_partkey AS file_id, CASE WHEN p_size % 2 = 0 THEN concat('h', CAST(p_partkey AS STRING)) ELSE 'default' END AS export_name, p_partkey * 2 + 1 AS fn_id
FROM part WHERE p_size % 5 <> 0
"""

SQL["fx_binding"] = """
SELECT p_partkey * 2 AS fn_id, 'id' AS lhs, 'body' AS ref, p_size % 4 = 0 AS has_source FROM part
UNION ALL SELECT p_partkey * 2, 'sql', 'id', false FROM part WHERE p_size % 3 = 0
UNION ALL SELECT p_partkey * 2 + 1, 'sql', 'id', false FROM part
"""

SQL["fx_call"] = """
SELECT l_orderkey AS order_key, l_linenumber AS seq, l_partkey * 2 + l_linenumber % 2 AS fn_id, l_partkey AS file_id,
  CASE CAST(l_quantity AS INT) % 12 WHEN 0 THEN 'query' WHEN 1 THEN 'exec' WHEN 2 THEN 'readFile' WHEN 3 THEN 'findById' WHEN 4 THEN 'findOne' WHEN 5 THEN 'save'
    WHEN 6 THEN 'createHash' WHEN 7 THEN 'createCipheriv' WHEN 8 THEN 'verify' WHEN 9 THEN 'sign' WHEN 10 THEN concat('h', CAST(l_suppkey AS STRING)) ELSE 'g' END AS name,
  CASE WHEN CAST(l_quantity AS INT) % 12 IN (8, 9) THEN 'jwt' WHEN CAST(l_quantity AS INT) % 12 = 2 THEN 'fs' WHEN CAST(l_quantity AS INT) % 12 IN (10, 11) THEN NULL ELSE 'db' END AS obj,
  CASE l_suppkey % 5 WHEN 0 THEN 'plus' WHEN 1 THEN 'template' WHEN 2 THEN 'identifier' WHEN 3 THEN 'string' ELSE 'call' END AS arg0_kind,
  CASE l_suppkey % 5 WHEN 3 THEN CASE l_orderkey % 3 WHEN 0 THEN 'MD5' WHEN 1 THEN 'aes-128-ecb' ELSE 'sha256' END END AS arg0_literal,
  CASE WHEN l_suppkey % 5 <> 3 THEN CASE l_linenumber % 3 WHEN 0 THEN 'id' WHEN 1 THEN 'sql' ELSE 'other' END END AS arg0_ref,
  l_suppkey % 5 <> 3 AND l_orderkey % 11 = 0 AS arg0_has_source,
  CASE l_orderkey % 4 WHEN 0 THEN 'algorithms' WHEN 1 THEN 'expiresIn' WHEN 2 THEN 'none' ELSE '' END AS option_key,
  CAST(l_orderkey % 300 + l_linenumber AS INT) AS line
FROM lineitem
"""

# documents with literals assigned to secret-named variables behind the text, and near misses
SQL["adoc"] = """
SELECT doc_id, concat(text, chr(10), CASE doc_id % 8
    WHEN 1 THEN concat('  const dbPassword = "hush', lpad(CAST(doc_id AS STRING), 8, '0'), '";')
    WHEN 2 THEN concat('api_key: ', chr(39), 'quiet', lpad(CAST(doc_id AS STRING), 9, 'q'), chr(39), ' # kept')
    WHEN 3 THEN 'password = "short"'
    WHEN 4 THEN concat('let Access_Key="', lpad(CAST(doc_id AS STRING), 12, 'k'), '"; let other_token =  "', lpad(CAST(doc_id AS STRING), 30, 't'), '"')
    WHEN 5 THEN concat('secret => "', lpad(CAST(doc_id AS STRING), 12, 'n'), '"')
    WHEN 6 THEN concat('credential:', chr(9), '"several words ', CAST(doc_id AS STRING), '"')
    WHEN 7 THEN concat('password = readFrom("', lpad(CAST(doc_id AS STRING), 12, 'f'), '")')
    ELSE 'nothing here' END) AS text
FROM documents
"""

# documents with fake credentials of every provider shape; the texts are cut in pieces so that no scanner takes them for real ones
SQL["sdoc"] = """
SELECT doc_id, lang, concat(text, chr(10), CASE doc_id % 10
    WHEN 1 THEN concat('id=AK', 'IA', lpad(CAST(doc_id AS STRING), 16, '0'), ' and AK', 'IA', lpad(CAST(doc_id AS STRING), 16, 'Z'))
    WHEN 2 THEN concat('xAK', 'IA', lpad(CAST(doc_id AS STRING), 16, '0'))
    WHEN 3 THEN concat('google AI', 'za', lpad(CAST(doc_id AS STRING), 35, 'b'))
    WHEN 4 THEN concat('slack xo', 'xb-', lpad(CAST(doc_id AS STRING), 12, '1'))
    WHEN 5 THEN concat('stripe sk_', 'test_', lpad(CAST(doc_id AS STRING), 18, 'c'), ' sk_', 'live_short')
    WHEN 6 THEN concat('git gh', 'p_', lpad(CAST(doc_id AS STRING), 36, 'd'))
    WHEN 7 THEN concat('-----BEGIN ', 'RSA PRIVATE KEY-----', chr(10), 'MIIE')
    WHEN 8 THEN concat('jwt ey', 'J', lpad(CAST(doc_id AS STRING), 12, 'e'), '.', lpad('f', 12, 'f'), '.', lpad('g', 12, 'g'))
    ELSE 'nothing here' END) AS text
FROM documents
"""

# a small program per part: imports, a helper with a sink, a handler that calls another file's helper
SQL["mod"] = """
SELECT p_partkey AS file_id,
  concat('src/m', CAST(p_partkey % 20 AS STRING), '/f', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 3 = 0 THEN '.ts' ELSE '.js' END) AS rel,
  concat(
    CASE p_size % 4
      WHEN 0 THEN concat('import { h', CAST((p_partkey * 7 + 3) % n AS STRING), ' } from "../m', CAST(((p_partkey * 7 + 3) % n) % 20 AS STRING), '/f', CAST((p_partkey * 7 + 3) % n AS STRING), '";')
      WHEN 1 THEN concat('const { h', CAST((p_partkey * 7 + 3) % n AS STRING), ' } = require("../m', CAST(((p_partkey * 7 + 3) % n) % 20 AS STRING), '/f', CAST((p_partkey * 7 + 3) % n AS STRING), '");')
      WHEN 2 THEN 'import lodash from "lodash";'
      ELSE 'const fs = require("fs");' END, chr(10),
    'function h', CAST(p_partkey AS STRING), '(id, opt) {', chr(10),
    CASE p_size % 3 WHEN 0 THEN '  return db.query("SELECT 1 WHERE a = " + id);' WHEN 1 THEN '  const sql = "x" + id;' ELSE '  return opt;' END, chr(10),
    CASE WHEN p_size % 3 = 1 THEN concat('  exec(sql);', chr(10)) ELSE '' END,
    '}', chr(10),
    'const g', CAST(p_partkey AS STRING), ' = async (req, res) => {', chr(10),
    CASE WHEN p_size % 2 = 0 THEN '  const v = req.query.v;' ELSE '  const v = "fixed";' END, chr(10),
    '  h', CASE WHEN p_size % 4 < 2 THEN CAST((p_partkey * 7 + 3) % n AS STRING) ELSE CAST(p_partkey AS STRING) END, '(v, 1);', chr(10),
    '};', chr(10),
    CASE WHEN p_size % 5 = 0 THEN concat('export { h', CAST(p_partkey AS STRING), ' };')
         WHEN p_size % 5 = 1 THEN concat('exports.h', CAST(p_partkey AS STRING), ' = h', CAST(p_partkey AS STRING), ';')
         ELSE concat('module.exports = { h', CAST(p_partkey AS STRING), ' };') END, chr(10)) AS code
FROM part CROSS JOIN (SELECT count(*) AS n FROM part) t
"""

# framework styles per part: decorated parameters, resolver maps, procedure chains, request calls
SQL["fw"] = """
SELECT p_partkey AS file_id, concat('src/fw/f', CAST(p_partkey AS STRING), '.ts') AS rel,
  CASE p_size % 4
    WHEN 0 THEN concat('export class C {', chr(10), '  @Get(":id")', chr(10), '  find(@Param("id") key', CAST(p_partkey AS STRING), ': string, plain: string) {', chr(10),
      '    return db.query("SELECT 1 WHERE a = " + key', CAST(p_partkey AS STRING), ');', chr(10), '  }', chr(10), '}', chr(10))
    WHEN 1 THEN concat('const resolvers = {', chr(10), '  Query: {', chr(10), '    one: (parent, args) => db.query("SELECT 1 WHERE a = " + args.id),', chr(10),
      '    two: (_, { term', CAST(p_partkey AS STRING), ', other: alias }) => db.query("SELECT 1 WHERE a = " + alias),', chr(10), '  },', chr(10), '};', chr(10))
    WHEN 2 THEN concat('const r = router({', chr(10), '  get: publicProcedure', chr(10), '    .input(schema)', chr(10), '    .query(({ input }) => {', chr(10),
      '      return db.query("SELECT 1 WHERE a = " + input.x);', chr(10), '    }),', chr(10), '  raw: publicProcedure.mutation(({ rawInput: inp', CAST(p_partkey AS STRING), ', ctx }) => run(ctx)),', chr(10), '});', chr(10))
    ELSE concat('async function POST(request) {', chr(10), '  const body = await request.json();', chr(10), '  const q = request.nextUrl.searchParams.get("q");', chr(10),
      '  const w = request.cookies.sid;', chr(10), '  return db.query("SELECT 1 WHERE a = " + body.x);', chr(10), '}', chr(10)) END AS code
FROM part
"""

# functions nested like a binary heap; only some of them have a name
SQL["nest"] = """
SELECT p_partkey AS fn_id, CASE WHEN p_partkey > 0 THEN CAST(floor((p_partkey - 1) / 2) AS BIGINT) END AS parent_fn, p_size % 4 = 0 AS is_carrier FROM part
"""

# what one tab showed last: events stand for page loads, one tab per user, some tabs closed
SQL["tab_load"] = """
SELECT user_id AS tab_id, event_id AS load_id, ts, concat('https://site', CAST(event_id % 50 AS STRING), '.example/') AS url,
  event_type = 'purchase' AND event_id % 3 = 0 AS closed
FROM events
"""

# remembered classes of earlier runs
SQL["memory"] = """
SELECT concat('class-', event_type) AS class, concat('seen as ', event_type) AS signature,
  min(ts) AS first_seen, min(ts) AS last_seen
FROM events WHERE event_id % 7 = 0 AND event_type IN ('click', 'view', 'signup') GROUP BY event_type
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived one built from the given tables of ``sf_dir``."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SQL[name]
    for base in BASE_TABLES:
        if f"FROM {base}" in text:
            spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
    return spark.sql(text)


def with_tables(names: list[str], body: str) -> str:
    """An oracle text: ``body`` preceded by the derived tables it reads."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n].strip()})" for n in names) + "\n" + body.strip()
