"""Queries over texts, paths and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ramparts.functions import text, urls
from ramparts.functions.http import normalized_headers
from ramparts.operators import secrets
from ramparts.plans.catalog import long, query
from ramparts.rules import FILE_CHARS
from ramparts.sources.code_files import classify_unit as unit_of
from ramparts.sources.code_files import code_files, is_code_path
from ramparts.sources.derived import table


@query
def src_code_files(spark, sf):
    return code_files(table(spark, sf, "code")).select("repo", "rel", "code", "unit")


@query
def src_size_cap(spark, sf):
    return table(spark, sf, "documents").filter(text.utf16_at_most(F.col("text"), FILE_CHARS)).select("doc_id", "text")


@query
def classify_unit(spark, sf):
    paths = table(spark, sf, "code").select(F.lit("code").alias("kind"), F.col("file_id").alias("id"), "rel")
    pages = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("rel"))
    return paths.unionByName(pages).withColumn("unit", unit_of(F.col("rel")))


@query
def filter_code_path(spark, sf):
    return table(spark, sf, "code").filter(is_code_path(F.col("rel"))).select("file_id", "rel")


def _odd_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.expr(
        "CASE page_id % 8 WHEN 3 THEN substring(url, 9) WHEN 5 THEN concat('HTTPS://User@', upper(substring(url, 9))) "
        "WHEN 6 THEN concat('http://h', page_id, '.example:', page_id % 3 * 40, '/p') WHEN 7 THEN 'http:// no host/' ELSE url END").alias("url"))


@query
def url_validity(spark, sf):
    return _odd_urls(spark, sf).select("page_id", "url", urls.is_valid(F.col("url")).alias("valid"))


@query
def url_origin(spark, sf):
    valid = _odd_urls(spark, sf).filter(urls.is_valid(F.col("url")))
    return valid.select("page_id", urls.origin(F.col("url")).alias("origin"), urls.is_https(F.col("url")).alias("is_https"))


@query
def url_resolve(spark, sf):
    links = table(spark, sf, "web").select("page_id", "url", F.posexplode(text.find_all(
        F.col("html"), "(?i)(?:src|href)\\s*=\\s*[\"']([^\"']*)[\"']", 1)).alias("pos", "ref"))
    varied = links.withColumn("ref", F.expr(
        "CASE pos % 6 WHEN 1 THEN concat('..', ref, '/./x') WHEN 2 THEN concat('?q=', substring(ref, 2)) "
        "WHEN 3 THEN concat('#', substring(ref, 2)) WHEN 4 THEN CASE WHEN ref LIKE '/%' THEN substring(ref, 2) ELSE ref END ELSE ref END"))
    return varied.select("page_id", long("pos"), "ref", urls.resolve(F.col("ref"), F.col("url")).alias("resolved"))


@query
def url_sensitive_param(spark, sf):
    return table(spark, sf, "web").filter(urls.has_sensitive_parameter(F.col("url"))).select("page_id", "url")


@query
def url_public_host(spark, sf):
    hosts = table(spark, sf, "pages").select("page_id", F.expr(
        "CASE page_id % 12 WHEN 0 THEN 'http://127.0.0.1/' WHEN 1 THEN concat('http://10.1.2.', page_id % 256, ':8080/x') "
        "WHEN 2 THEN concat('http://172.', page_id % 40, '.0.1/') WHEN 3 THEN 'https://192.168.1.9' WHEN 4 THEN 'http://169.254.169.254/latest' "
        "WHEN 5 THEN concat('http://100.', page_id % 200, '.3.4/') WHEN 6 THEN 'http://[::1]/' WHEN 7 THEN 'http://[fd00::12]:80/' "
        "WHEN 8 THEN 'http://printer.local/' WHEN 9 THEN 'http://[::ffff:10.0.0.1]/' WHEN 10 THEN 'ftp://files.example/' ELSE url END").alias("url"))
    return hosts.select("page_id", "url", urls.host_class(F.col("url")).alias("host_class"))


@query
def redact_secret(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("pos", "word"))
    return words.filter("length(word) > 10").select("doc_id", long("pos"), text.redact(F.col("word")).alias("shown"))


@query
def norm_headers(spark, sf):
    from ramparts.sources.captures import flat_headers
    raw = table(spark, sf, "cap").withColumn("headers", flat_headers(
        {"Server": "server", "SERVER": "x_powered_by", "X-Frame-Options": "xfo", "Set-Cookie": "url"}))
    flat = raw.select("capture_id", F.explode(normalized_headers(F.col("headers"))).alias("name", "value"))
    return flat


@query
def match_evidence(spark, sf):
    return text.match_evidence(table(spark, sf, "documents"), "text", "[0-9]{4,}", ["doc_id"])


@query
def det_secret_provider(spark, sf):
    docs = secrets.provider_findings(table(spark, sf, "sdoc"), "text", F.concat(F.lit("doc/"), F.col("doc_id")), ["doc_id"])
    return docs.select("rel", "class", "severity", "section", "summary", "evidence")


@query
def det_secret_assignment(spark, sf):
    docs = secrets.assignment_findings(table(spark, sf, "adoc"), "text", F.concat(F.lit("doc/"), F.col("doc_id")), ["doc_id"])
    pages = secrets.assignment_findings(table(spark, sf, "pages"), "html", F.concat(F.lit("page/"), F.col("page_id")), ["page_id"])
    shown = ["rel", "class", "severity", "section", "evidence", "line", "col"]
    return docs.select(*shown).unionByName(pages.select(*shown)).withColumn("line", long("line")).withColumn("col", long("col"))
