"""Surface rules on a faulty and a hardened site, and on single rows."""

import pytest
from pyspark.sql import functions as F

from ramparts import rules, schemas
from ramparts.functions import text, urls
from ramparts.operators import secrets, surface
from ramparts.plans.surface_scan import scan_site
from ramparts.sources.captures import prepare_captures

KEY = "AK" + "IA" + "R" * 16


def captures(spark, rows):
    shaped = [(i, url, origin, status, headers, cookies, body, None) for i, (url, origin, status, headers, cookies, body) in enumerate(rows)]
    return prepare_captures(spark.createDataFrame(shaped, schemas.HTTP_CAPTURES))


FAULTY = [
    ("http://bad.test/", rules.PROBE_ORIGIN, 200, {"X-Powered-By": "Kit 4.1", "Set-Cookie": "sid=1; Path=/", "Access-Control-Allow-Origin": rules.PROBE_ORIGIN,
                                                   "Access-Control-Allow-Credentials": "true"}, [],
     '<form><input name=p type="password"></form><script src="/main.js"></script>'),
    ("http://bad.test/main.js", None, 200, {}, [], f'const k="{KEY}";\n//# sourceMappingURL=main.js.map'),
    ("http://bad.test/main.js.map", None, 200, {}, [], "{}"),
    ("http://bad.test/.env", None, 200, {}, [], "DB=1"),
    ("http://bad.test/none", None, 500, {}, [], "Error: x\n    at Object.run (/srv/a.js:10:15)"),
]
HARDENED = [
    ("http://good.test/", rules.PROBE_ORIGIN, 200, {
        "Content-Security-Policy": "default-src 'self'; frame-ancestors 'none'", "X-Frame-Options": "DENY", "X-Content-Type-Options": "nosniff",
        "Referrer-Policy": "no-referrer", "Permissions-Policy": "camera=()"}, ["sid=1; HttpOnly; SameSite=Lax"], '<script src="/main.js"></script>'),
    ("http://good.test/.env", None, 404, {}, [], "not here"),
]


def with_roles(seen):
    role = (F.when(F.col("url").endswith(".js"), "script").when(F.col("url").endswith("/none"), "error").when(F.col("request_origin").isNotNull(), "page").otherwise("probe"))
    return seen.withColumn("role", role)


def test_faulty_site(spark):
    seen = with_roles(captures(spark, FAULTY))
    found = scan_site(seen).collect()
    classes = {f["class"] for f in found}
    assert {"Missing Security Header", "Insecure Cookie", "Permissive CORS", "Secret in JS Bundle", "Sensitive Path Exposed", "Credentials Over HTTP",
            "Verbose Error Disclosure", "Version Disclosure", "Clickjacking Exposure", "Source Map Exposed"} == classes
    assert {f["severity"] for f in found if f["class"] == "Sensitive Path Exposed"} == {"Critical"}
    cors = next(f for f in found if f["class"] == "Permissive CORS")
    assert cors["severity"] == "High" and "Access-Control-Allow-Origin" in " ".join(cors["proof"]["steps"])
    bundles = surface.page_bundles(seen, ["capture_id"])
    assert [r.script_url for r in bundles.collect()] == ["http://bad.test/main.js"]
    scripts = seen.filter("url like '%.js'")
    for rows in (0, 1000):
        maps = surface.exposed_source_maps(scripts, seen, ["capture_id"], broadcast_rows=rows).collect()
        assert [m.rel for m in maps] == ["http://bad.test/main.js.map"]
        joined = surface.bundle_captures(seen, seen.filter("url like '%.js'"), ["capture_id"], broadcast_rows=rows)
        assert [r.script_url for r in joined.collect()] == ["http://bad.test/main.js"]


def test_hardened_site(spark):
    assert scan_site(with_roles(captures(spark, HARDENED))).collect() == []


def test_empty_header_counts_as_missing(spark):
    bare = captures(spark, [("https://x.test/", None, 200, {"Referrer-Policy": ""}, [], "")])
    assert surface.missing_headers(bare).count() == 4
    assert surface.missing_hsts(bare).count() == 1


@pytest.mark.parametrize("acao,acac,severity", [(rules.PROBE_ORIGIN, None, "High"), ("*", "true", "High"), ("*", None, "Low"), ("https://own.test", "true", None), (None, None, None)])
def test_cors_levels(spark, acao, acac, severity):
    headers = {k: v for k, v in {"access-control-allow-origin": acao, "access-control-allow-credentials": acac}.items() if v}
    rows = surface.permissive_cors(captures(spark, [("https://x.test/", rules.PROBE_ORIGIN, 200, headers, [], "")])).collect()
    assert [r.severity for r in rows] == ([severity] if severity else [])


def test_cookie_flags(spark):
    flags = lambda url, cookie: sorted(r.summary.split()[-1] for r in surface.insecure_cookies(captures(spark, [(url, None, 200, {}, [cookie], "")])).collect())
    assert flags("https://x.test/", "sid=a; Path=/") == ["HttpOnly", "SameSite", "Secure"]
    assert flags("http://x.test/", "sid=a") == ["HttpOnly", "SameSite"]
    assert flags("https://x.test/", "sid=a; httponly; SECURE; SameSite=Lax") == []


def test_header_names_last_spelling_wins(spark):
    raw = spark.sql("select map('SERVER', 'a 1', 'set-cookie', 'k=v', 'server', 'b 2') as headers, array('m=n') as set_cookies, '' as body")
    seen = prepare_captures(raw).first()
    assert seen.headers == {"server": "b 2"} and sorted(seen.set_cookies) == ["k=v", "m=n"]


def test_url_validity_and_resolution(spark):
    rows = [("not-a-url", False), ("http://", False), ("https://a.test:99999/", False), ("https://a.test/ x", True), ("mailto:a@b", True), (None, False)]
    df = spark.createDataFrame(rows, "u string, ok boolean").select("u", "ok", urls.is_valid(F.col("u")).alias("got"))
    assert all(r.ok == r.got for r in df.collect())
    base = "https://A.test:443/x/y?z=1#f"
    want = {"../q": "https://a.test/q", "//h.test/a/../b": "https://h.test/b", "?k": "https://a.test/x/y?k", "#g": "https://a.test/x/y?z=1#g",
            "": "https://a.test/x/y?z=1", "/r/./s": "https://a.test/r/s", "t": "https://a.test/x/t", "../../..": "https://a.test/", "http://bad host/": None}
    got = spark.createDataFrame([(k,) for k in want], "r string").select("r", urls.resolve(F.col("r"), F.lit(base)).alias("o")).collect()
    assert {r.r: r.o for r in got} == want


def test_origins_are_compared_whole(spark):
    page = [("https://a.test/", None, 200, {}, [], '<script src="https://a.test.evil/x.js"></script><script src="/y.js"></script>')]
    assert [r.script_url for r in surface.page_bundles(captures(spark, page), []).collect()] == ["https://a.test/y.js"]


def test_word_edges_are_ascii(spark):
    rows = spark.createDataFrame([("é" + KEY,), ("x" + KEY,), (KEY + "é",), (KEY + "9",)], "t string")
    assert rows.filter(F.size(secrets.provider_matches(F.col("t"))) > 0).count() == 2


def test_stack_frames_on_long_lines(spark):
    long_line = " at (" * 20000 + ":1"
    rows = spark.createDataFrame([("at f (a.js:1:2)", True), ("at (a:1:2)", False), ("bat f (a:1:2)", False), ("at f\n(a:1:2)", False), (long_line, False)], "b string, want boolean")
    assert all(r.want == r.got for r in rows.select("want", surface.has_stack_frame(F.col("b")).alias("got")).collect())


def test_redact_and_positions(spark):
    rows = spark.createDataFrame([("123456789012", "123456789012"), ("1234567890123", "123456…23")], "v string, want string")
    assert all(r.want == r.got for r in rows.select("want", text.redact(F.col("v")).alias("got")).collect())
    found = text.match_evidence(spark.createDataFrame([("a\nbb K1 K2\nK3",)], "t string"), "t", "K[0-9]", []).collect()
    assert [(r.line, r.col, r.match, r.evidence) for r in found] == [(2, 4, "K1", "bb K1 K2"), (2, 7, "K2", "bb K1 K2"), (3, 1, "K3", "K3")]
