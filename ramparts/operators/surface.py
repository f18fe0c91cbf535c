"""HTTP surface detectors: captures and pages in, findings out.

All but the joins at the end are projections of one scan without any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramparts import rules
from ramparts.functions import text, urls
from ramparts.functions.http import header
from ramparts.functions.text import per_application
from ramparts.operators.secrets import first_provider
from ramparts.schemas import emit, finding, findings
from ramparts.session import lookup_join

RULES: dict[str, Callable[[], Column]] = {}


def row_rule(build: Callable[[], Column]) -> Callable[..., DataFrame]:
    """Register a rule over one capture row and turn it into a detector of its own."""
    build = per_application(build)
    RULES[build.__name__] = build

    def detector(captures: DataFrame, keep: list[str] | None = None) -> DataFrame:
        return emit(captures, [build()], keep)
    detector.__name__, detector.__doc__ = build.__name__, build.__doc__
    return detector


def scan_captures(captures: DataFrame, keep: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """Every row rule (or those named in ``only``) in a single pass over the captures."""
    return emit(captures, [RULES[name]() for name in (only or RULES)], keep)


def surface_finding(cls, severity, summary, evidence, **more) -> Column:
    return finding(detector_id="surface", cls=cls, severity=severity, rel=more.pop("rel", F.col("url")), summary=summary,
                   evidence=evidence, **more)


def path_of(url: Column) -> Column:
    return F.regexp_extract(urls.path_and_query(url), r"^([^?#]*)", 1)


@row_rule
def missing_headers() -> Column:
    return F.array(*[F.when(header(F.col("headers"), key).isNull(), surface_finding(
        "Missing Security Header", severity, f"no {name} header",
        F.concat(F.lit("GET "), F.col("url"), F.lit(f" answered without {name}")),
        impact="The browser falls back to its permissive default.", after=f"send {name}",
        contract="response header only")) for key, name, severity in rules.EXPECTED_HEADERS])


@row_rule
def missing_hsts() -> Column:
    bad = urls.is_https(F.col("url")) & header(F.col("headers"), "strict-transport-security").isNull()
    return F.array(F.when(bad, surface_finding(
        "Missing Security Header", "Medium", "no Strict-Transport-Security header",
        F.concat(F.lit("GET "), F.col("url"), F.lit(" answered over HTTPS without HSTS")),
        impact="The first request can be downgraded to HTTP.", after="send Strict-Transport-Security",
        contract="response header only")))


@row_rule
def clickjacking() -> Column:
    csp = F.coalesce(F.col("headers")["content-security-policy"], F.lit(""))
    bad = header(F.col("headers"), "x-frame-options").isNull() & ~csp.rlike("(?i)frame-ancestors")
    return F.array(F.when(bad, surface_finding(
        "Clickjacking Exposure", "Medium", "page can be framed by any site",
        F.concat(F.lit("GET "), F.col("url"), F.lit(" restricts framing nowhere")),
        impact="Users can be tricked into clicks on a hidden page.", after="send X-Frame-Options: DENY",
        contract="response header only")))


@row_rule
def version_disclosure() -> Column:
    return F.array(*[F.when(F.col("headers")[k].rlike(r"\d"), surface_finding(
        "Version Disclosure", "Informational", f"{k} names a version", F.concat(F.lit(f"{k}: "), F.col("headers")[k]),
        impact="Known faults of that version can be looked up.", before=F.concat(F.lit(f"{k}: "), F.col("headers")[k]),
        after="drop the version", contract="response header only")) for k in rules.VERSION_HEADERS])


@row_rule
def insecure_cookies() -> Column:
    def per_cookie(cookie: Column) -> Column:
        low, name = F.lower(cookie), text.trim_blank(F.substring_index(cookie, "=", 1))
        severity = F.when(name.rlike(rules.SESSION_COOKIE_NAME), "Medium").otherwise("Low")
        return F.array(*[F.when(~low.contains(flag.lower()) & (urls.is_https(F.col("url")) if flag == "Secure" else F.lit(True)), surface_finding(
            "Insecure Cookie", severity, F.concat(F.lit("cookie "), name, F.lit(f" lacks {flag}")),
            F.concat(F.lit("Set-Cookie: "), cookie), impact="The cookie can be stolen or sent along without intent.",
            before=F.concat(name, F.lit("=…")), after=F.concat(name, F.lit("=…; HttpOnly; Secure; SameSite=Lax")),
            contract="same value, stricter attributes")) for flag in rules.COOKIE_FLAGS])
    return F.flatten(F.transform(F.coalesce("set_cookies", F.array().cast("array<string>")), per_cookie))


@row_rule
def permissive_cors() -> Column:
    """Judged only on captures that were requested with a foreign Origin."""
    allow = header(F.col("headers"), "access-control-allow-origin")
    any_reader = (allow == F.col("request_origin")) | ((allow == "*") & (F.col("headers")["access-control-allow-credentials"] == "true"))
    shown = F.concat(F.lit("Access-Control-Allow-Origin: "), allow)
    steps = [F.concat(F.lit("Origin: "), F.col("request_origin")), shown]

    def judged(severity: str, summary: str) -> Column:
        return surface_finding("Permissive CORS", severity, summary, shown, steps=steps,
                               impact="Foreign sites can read answers meant for the user.",
                               after="allow listed origins only", contract="same-origin use is unaffected")
    return F.array(F.when(F.col("request_origin").isNotNull(),
                          F.when(any_reader, judged("High", "any origin may read answers"))
                          .when(allow == "*", judged("Low", "any origin may read public answers"))))


def mixed_references(body: Column) -> Column:
    return text.find_all(body, rules.MIXED_REFERENCE, 1)


@row_rule
def mixed_content() -> Column:
    first = F.regexp_extract(F.col("body"), rules.MIXED_REFERENCE, 1)
    return F.array(F.when(urls.is_https(F.col("url")) & F.col("body").rlike(rules.MIXED_REFERENCE), surface_finding(
        "Mixed Content", "Medium", "HTTPS page loads plain HTTP parts", F.concat(F.lit("loads "), first),
        impact="The parts can be changed on the way.", before=first, after=F.regexp_replace(first, "^http:", "https:"),
        contract="same part over TLS")))


@row_rule
def credentials_over_http() -> Column:
    return F.array(F.when(~urls.is_https(F.col("url")) & F.col("body").rlike(rules.PASSWORD_INPUT), surface_finding(
        "Credentials Over HTTP", "High", "password field on a plain HTTP page", F.concat(F.lit("password input on "), F.col("url")),
        impact="Passwords can be read on the way.", after="serve the form over HTTPS")))


@row_rule
def sensitive_urls() -> Column:
    return F.array(F.when(urls.has_sensitive_parameter(F.col("url")), surface_finding(
        "Sensitive Data in URL", "High", "secret value in the query string", F.concat(F.lit("query of "), F.col("url")),
        impact="URLs end up in logs, history and referrers.", before=F.col("url"), after="send the value in a body or cookie")))


@row_rule
def directory_listings() -> Column:
    return F.array(F.when(F.col("body").rlike(rules.LISTING), surface_finding(
        "Directory Listing", "Medium", "directory contents are listed", F.concat(F.col("url"), F.lit(" is a generated index")),
        impact="Hidden files can be found.")))


def has_stack_frame(body: Column) -> Column:
    """``at something(…:line:column)`` within one line.

    Written as three greedy passes per candidate line, since the direct pattern is cubic on the
    very long lines of minified pages.
    """
    def in_line(line: Column) -> Column:
        after_at = F.regexp_extract(line, rf"{text.EDGE}at{text.EDGE} ({text.DOT}+)", 1)
        before_position = F.regexp_extract(after_at, rf"^({text.DOT}+):\d+:\d+\)", 1)
        return before_position.rlike(rf"^{text.DOT}+\({text.DOT}+$")
    return F.when(body.rlike(r":\d+:\d+\)"), F.exists(F.split(body, "[\n\r]", -1), in_line)).otherwise(False)


@row_rule
def verbose_errors() -> Column:
    return F.array(F.when(F.col("body").rlike(rules.ERROR_WORDS) | has_stack_frame(F.col("body")), surface_finding(
        "Verbose Error Disclosure", "Medium", "error page shows internals",
        F.concat(F.lit("internals in the answer of "), F.col("url")), impact="Frameworks, paths and versions become known.")))


@row_rule
def bundle_secrets() -> Column:
    """First provider match per script, redacted; only captures whose path ends like a script."""
    def shown(first: Column) -> Column:
        return F.when(first.isNotNull(), surface_finding(
            "Secret in JS Bundle", "Critical", F.concat(first["name"], F.lit(" in a client script")),
            F.concat(F.col("url"), F.lit(" holds "), text.redact(first["match"])), impact="Every visitor can read the credential.",
            after="keep the credential on the server"))
    return F.transform(F.array(F.when(path_of(F.col("url")).rlike(r"\.[mc]?js$"), first_provider(F.col("body")))), shown)


@row_rule
def sensitive_paths() -> Column:
    """Probed paths that answer 200 with the body they should never show.

    The rule list is one expression on the path, so no join of sites and rules is needed.
    """
    chain = None
    for probed, severity, signature, label in rules.SENSITIVE_PATHS:
        test = (path_of(F.col("url")) == probed) & F.col("body").rlike(signature)
        hit = F.struct(F.lit(severity).alias("severity"), F.lit(label).alias("label"))
        chain = F.when(test, hit) if chain is None else chain.when(test, hit)
    known = path_of(F.col("url")).isin([p for p, *_ in rules.SENSITIVE_PATHS]) & (F.col("status") == 200)

    def shown(hit: Column) -> Column:
        return F.when(hit.isNotNull(), surface_finding(
            "Sensitive Path Exposed", hit["severity"], F.concat(hit["label"], F.lit(" is public")),
            F.concat(F.lit("GET "), F.col("url"), F.lit(" answers 200")), impact="Internal data can be read by anyone.",
            after="block the path"))
    return F.transform(F.array(F.when(known, chain)), shown)


def surface_positives(captures: DataFrame) -> DataFrame:
    """Good signs of a capture as (label, rel)."""
    signs = [
        (urls.is_https(F.col("url")), "Served over HTTPS"),
        (header(F.col("headers"), "strict-transport-security").isNotNull(), "HSTS configured"),
        (header(F.col("headers"), "content-security-policy").isNotNull(), "CSP configured"),
        ((path_of(F.col("url")) == rules.SECURITY_CONTACT_PATH) & (F.col("status") == 200), "security.txt present"),
    ]
    labels = F.array_compact(F.array(*[F.when(test, F.lit(label)) for test, label in signs]))
    return captures.select(F.explode(labels).alias("label"), F.col("url").alias("rel"))


def script_sources(pages: DataFrame, keep: list[str]) -> DataFrame:
    """External script sources of each page in document order, resolved against the page."""
    found = text.explode_once(pages, [*keep, "url"], text.find_all(F.col("body"), rules.SCRIPT_SOURCE, 1), "src", "pos")
    return found.withColumn("script_url", urls.resolve(F.col("src"), F.col("url")))


def inline_scripts(pages: DataFrame, keep: list[str]) -> DataFrame:
    return text.explode_once(pages, keep, text.find_all(F.col("body"), rules.INLINE_SCRIPT, 1), "script", "pos")


def page_bundles(pages: DataFrame, keep: list[str], cap: int | None = None) -> DataFrame:
    """The same-origin scripts of each page with their place; only the first ``cap`` if it is given."""
    resolved = F.transform(text.find_all(F.col("body"), rules.SCRIPT_SOURCE, 1), lambda s: urls.resolve(s, F.col("url")))
    own = F.filter(resolved, lambda u: u.isNotNull() & (urls.origin(u) == urls.origin(F.col("url"))))
    return text.explode_once(pages, [*keep, "url"], own if cap is None else F.slice(own, 1, cap), "script_url", "pos")


def source_map_reference(body: Column) -> Column:
    return text.first_match(body, rules.SOURCE_MAP, 1)


def exposed_source_maps(bundles: DataFrame, captures: DataFrame, keep: list[str],
                        broadcast_rows: int | None = None) -> DataFrame:
    """Bundles whose declared map, or else ``<bundle>.map``, answers with 200.

    The captures shrink to distinct map URLs first, so a URL captured many times counts once.
    """
    target = F.coalesce(urls.resolve(source_map_reference(F.col("body")), F.col("url")), F.concat(F.col("url"), F.lit(".map")))
    wanted = bundles.withColumn("map_url", target)
    answers = captures.filter("status = 200").select(F.col("url").alias("map_url")).distinct()
    extra = {} if broadcast_rows is None else {"broadcast_rows": broadcast_rows}
    hit = lookup_join(wanted, answers, ["map_url"], salt_by=["url", *keep], how="inner", **extra)
    return findings(hit, detector_id="surface", cls="Source Map Exposed", severity="Medium", rel=F.col("map_url"),
                    summary="source map is public", evidence=F.concat(F.col("map_url"), F.lit(" answers 200")),
                    impact="The original source can be rebuilt.", keep=keep)


def bundle_captures(pages: DataFrame, captures: DataFrame, keep: list[str],
                    broadcast_rows: int | None = None) -> DataFrame:
    """Scripts of a page joined with their captures; of several captures the lowest id is taken."""
    wanted = page_bundles(pages, keep)
    first = captures.groupBy(F.col("url").alias("script_url")).agg(
        F.min_by(F.struct("capture_id", "status"), "capture_id").alias("_c"))
    first = first.select("script_url", "_c.capture_id", "_c.status")
    extra = {} if broadcast_rows is None else {"broadcast_rows": broadcast_rows}
    return lookup_join(wanted, first, ["script_url"], salt_by=["url", "pos", *keep], how="inner", **extra)
