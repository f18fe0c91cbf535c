"""Queries over captures, cookies, pages and scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramparts.functions import urls
from ramparts.operators import surface
from ramparts.plans.catalog import long, query
from ramparts.rules import BUNDLES_PER_PAGE
from ramparts.sources.captures import cap_body, flat_headers
from ramparts.sources.derived import table

_HEADER_COLUMNS = {
    "content-security-policy": "csp", "x-content-type-options": "xcto", "referrer-policy": "referrer_policy",
    "permissions-policy": "permissions_policy", "x-frame-options": "xfo", "strict-transport-security": "hsts",
    "server": "server", "x-powered-by": "x_powered_by", "access-control-allow-origin": "acao",
    "access-control-allow-credentials": "acac",
}
_SHOWN = ["rel", "class", "severity", "section", "summary", "evidence"]


def captures(spark, sf) -> DataFrame:
    return table(spark, sf, "cap").withColumn("headers", flat_headers(_HEADER_COLUMNS))


def cookies(spark, sf) -> DataFrame:
    return table(spark, sf, "cookie").withColumn("set_cookies", F.array("cookie"))


def web(spark, sf) -> DataFrame:
    return table(spark, sf, "web").withColumnRenamed("html", "body")


def assets(spark, sf) -> DataFrame:
    """Asset captures with a full URL and one id per capture, numbered by kind."""
    return table(spark, sf, "asset").withColumn("url", F.concat("origin", "path")).withColumn(
        "capture_id", F.col("page_id") * 3 + F.when(F.col("path").endswith(".js"), 0).when(F.col("path").endswith(".map"), 1).otherwise(2)
    ).withColumn("body", cap_body(F.col("body")))


def scripts(spark, sf) -> DataFrame:
    return assets(spark, sf).filter(F.col("path").endswith(".js"))


@query
def src_http_captures(spark, sf):
    return assets(spark, sf).select("capture_id", "url", long("status"), "body")


def _register(name, detector, feed):
    def run(spark, sf):
        return detector(feed(spark, sf)).select(*_SHOWN)
    run.__name__ = name
    query(run)


for _name, _detector, _feed in [
    ("det_missing_header", surface.missing_headers, captures),
    ("det_missing_hsts", surface.missing_hsts, captures),
    ("det_clickjacking", surface.clickjacking, captures),
    ("det_version_disclosure", surface.version_disclosure, captures),
    ("det_insecure_cookie", surface.insecure_cookies, cookies),
    ("det_permissive_cors", surface.permissive_cors, captures),
    ("det_mixed_content", surface.mixed_content, web),
    ("det_credentials_over_http", surface.credentials_over_http, web),
    ("det_sensitive_url", surface.sensitive_urls, web),
    ("det_directory_listing", surface.directory_listings, web),
    ("det_verbose_error", surface.verbose_errors, web),
    ("det_secret_in_bundle", surface.bundle_secrets, scripts),
    ("det_sensitive_path", surface.sensitive_paths, assets),
]:
    _register(_name, _detector, _feed)


@query
def pos_http(spark, sf):
    probed = assets(spark, sf).withColumn("headers", F.create_map().cast("map<string,string>"))
    shown = ["url", "status", "headers"]
    return surface.surface_positives(captures(spark, sf).select(*shown).unionByName(probed.select(*shown)))


@query
def agg_mixed_content(spark, sf):
    pages = web(spark, sf).filter(urls.is_https(F.col("url")))
    refs = pages.withColumn("refs", surface.mixed_references(F.col("body"))).filter("size(refs) > 0")
    return refs.select("page_id", F.size("refs").cast("bigint").alias("n_refs"), F.element_at("refs", 1).alias("first_ref"))


@query
def ext_script_srcs(spark, sf):
    return surface.script_sources(web(spark, sf), ["page_id"]).select("page_id", long("pos"), "src", "script_url")


@query
def ext_inline_scripts(spark, sf):
    return surface.inline_scripts(table(spark, sf, "pages").withColumnRenamed("html", "body"), ["page_id"]).select(
        "page_id", long("pos"), "script")


@query
def ext_sourcemap_url(spark, sf):
    return scripts(spark, sf).select("page_id", surface.source_map_reference(F.col("body")).alias("map_ref")).filter("map_ref is not null")


@query
def det_sourcemap_exposed(spark, sf):
    return surface.exposed_source_maps(scripts(spark, sf), assets(spark, sf), ["page_id"]).select(*_SHOWN)


@query
def join_bundle_sourcemap(spark, sf):
    hit = surface.exposed_source_maps(scripts(spark, sf), assets(spark, sf), ["page_id"])
    return hit.select("page_id", F.col("rel").alias("map_url"))


@query
def join_page_bundles(spark, sf):
    return surface.bundle_captures(web(spark, sf), scripts(spark, sf), ["page_id"]).select(
        "page_id", long("pos"), "script_url", "capture_id", long("status"))


@query
def win_bundle_cap(spark, sf):
    many = web(spark, sf).withColumn("body", F.expr(
        "concat(body, array_join(transform(sequence(1, cast(page_id % 13 as int) + 1), i -> "
        "concat('<script src=\"', case when i % 4 = 0 then 'https://cdn.example' else '' end, '/b', i, '.js\"></script>')), ''))"))
    return surface.page_bundles(many, ["page_id"], cap=BUNDLES_PER_PAGE).select("page_id", long("pos"), "script_url")


@query
def join_sensitive_paths(spark, sf):
    return surface.sensitive_paths(assets(spark, sf), keep=["page_id"]).select("page_id", "rel", "severity", "summary")


@query
def win_first_secret_per_bundle(spark, sf):
    from ramparts.operators.secrets import first_provider
    docs = table(spark, sf, "sdoc").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    js = scripts(spark, sf).select(F.lit("script").alias("kind"), F.col("page_id").alias("id"), "body")
    both = docs.unionByName(js)
    first = both.select("kind", "id", F.explode(F.array_compact(F.array(first_provider(F.col("body"))))).alias("s"))
    return first.select("kind", "id", F.col("s.name").alias("rule"), F.col("s.match").alias("match"))


@query
def agg_request_count(spark, sf):
    used = captures(spark, sf).select("url").unionByName(assets(spark, sf).select("url"))
    return used.groupBy(urls.origin(F.col("url")).alias("site")).agg(F.count("*").alias("requests"))
