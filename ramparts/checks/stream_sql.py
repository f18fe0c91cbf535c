"""Independent SQL for the streams: what a batch over the same rows gives."""

from __future__ import annotations

from ramparts.checks.finding_sql import ORACLES as FINDING
from ramparts.checks.surface_sql import ORACLES as SURFACE
from ramparts.sources.derived import with_tables

ORACLES: dict[str, str] = {
    "stream_captures": " UNION ALL ".join(
        f"SELECT rel, class, severity, summary, evidence FROM ({SURFACE[k]})"
        for k in ("det_missing_header", "det_missing_hsts", "det_clickjacking", "det_version_disclosure", "det_permissive_cors")),
    "stream_latest_tab": with_tables(["tab_load"], """SELECT tab_id, ts, load_id, url FROM (
        SELECT *, row_number() OVER (PARTITION BY tab_id ORDER BY ts DESC, load_id DESC) AS k FROM tab_load) WHERE k = 1 AND NOT closed"""),
    "stream_dedup": with_tables(["find"], "SELECT DISTINCT run, class, evidence FROM find"),
    "stream_merge_dom_headers": with_tables(["cap", "web"], r"""SELECT capture_id AS tab_id, 'Missing Security Header' AS class, 'GET ' || url || ' answered over HTTPS without HSTS' AS evidence
          FROM cap WHERE url LIKE 'https:%' AND coalesce(hsts, '') = ''
        UNION ALL SELECT capture_id, 'Clickjacking Exposure', 'GET ' || url || ' restricts framing nowhere' FROM cap WHERE coalesce(xfo, '') = '' AND coalesce(csp, '') NOT ILIKE '%frame-ancestors%'
        UNION ALL SELECT page_id, 'Mixed Content', 'loads ' || m FROM (SELECT page_id, regexp_extract(html, '(?i)(?:src|href)\s*=\s*["''](http://[^"'']+)["'']', 1) AS m FROM web WHERE url LIKE 'https:%') WHERE m <> ''
        UNION ALL SELECT page_id, 'Credentials Over HTTP', 'password input on ' || url FROM web WHERE url NOT LIKE 'https:%' AND regexp_matches(html, '(?i)<input[^>]+type\s*=\s*["'']?password')
        UNION ALL SELECT page_id, 'Sensitive Data in URL', 'query of ' || url FROM web WHERE regexp_matches(url, '(?i)[?&](token|jwt|session|sessionid|access_token|api_key|apikey|password|pwd)=')"""),
    "stream_memory": FINDING["join_known_pattern"],
}
