"""Independent SQL for the fact queries, written from the rule texts."""

from __future__ import annotations

from ramparts.sources.derived import with_tables

ORACLES: dict[str, str] = {}


def oracle(name: str, tables: list[str], body: str) -> None:
    text = with_tables(tables, body)
    ORACLES[name] = text.replace("WITH ", "WITH RECURSIVE ", 1)


FX = ["fx_file", "fx_import", "fx_function", "fx_export", "fx_binding", "fx_call"]
# imports: all nine candidates, the first existing one wins
MODULES = r""", sfx(pos, s) AS (VALUES (0, ''), (1, '.js'), (2, '.ts'), (3, '.jsx'), (4, '.tsx'), (5, '.mjs'), (6, '.cjs'), (7, '/index.js'), (8, '/index.ts')),
imp AS (SELECT i.file_id, i.local, i.source, i.imported, f.rel, CASE WHEN i.source LIKE '../../%' THEN 'src/' || substring(i.source, 7)
    WHEN i.source LIKE '../%' THEN 'src/' || substring(i.source, 4) END AS base FROM fx_import i JOIN fx_file f USING (file_id)),
cand AS (SELECT imp.file_id, imp.local, t.file_id AS target_file, row_number() OVER (PARTITION BY imp.file_id, imp.local ORDER BY sfx.pos) AS k
  FROM imp JOIN sfx ON base IS NOT NULL JOIN fx_file t ON t.rel = imp.base || sfx.s),
mods AS (SELECT imp.*, cand.target_file FROM imp LEFT JOIN cand ON imp.file_id = cand.file_id AND imp.local = cand.local AND k = 1)"""
RESOLVED = MODULES + """, exported AS (SELECT m.*, coalesce((SELECT e.fn_id FROM fx_export e WHERE e.file_id = m.target_file AND e.export_name = CASE m.imported WHEN '*' THEN 'default' ELSE m.imported END),
    (SELECT e.fn_id FROM fx_export e WHERE e.file_id = m.target_file AND e.export_name = 'default')) AS export_fn FROM mods m),
lone_local AS (SELECT file_id, name, min(fn_id) AS fn FROM fx_function GROUP BY file_id, name HAVING count(*) = 1),
lone AS (SELECT name, min(fn_id) AS fn FROM fx_function GROUP BY name HAVING count(*) = 1),
res AS (SELECT c.*, CASE WHEN x.file_id IS NOT NULL THEN x.export_fn ELSE coalesce(ll.fn, lone.fn) END AS callee_fn FROM fx_call c
  LEFT JOIN exported x ON x.file_id = c.file_id AND x.local = coalesce(c.obj, c.name)
  LEFT JOIN lone_local ll ON ll.file_id = c.file_id AND ll.name = c.name LEFT JOIN lone ON lone.name = c.name)"""
ARGS = RESOLVED + """, args AS (SELECT r.order_key, r.seq, r.fn_id, r.callee_fn, r.arg0_ref AS ref, r.arg0_has_source AS has_source, f.p0 AS param
  FROM res r JOIN fx_function f ON f.fn_id = r.callee_fn)"""
TAINT = ARGS + """, edge AS (SELECT fn_id AS sf, ref AS sn, fn_id AS df, lhs AS dn FROM fx_binding UNION SELECT fn_id, ref, callee_fn, param FROM args),
t AS (SELECT fn_id, lhs AS name FROM fx_binding WHERE has_source UNION SELECT callee_fn, param FROM args WHERE has_source
  UNION SELECT e.df, e.dn FROM t JOIN edge e ON t.fn_id = e.sf AND t.name = e.sn)"""

oracle("join_module_resolution", FX, MODULES + " SELECT file_id, source, target_file FROM mods")
oracle("join_export_lookup", FX, MODULES + """ SELECT m.file_id, m.target_file, m.imported, coalesce(
  (SELECT e.fn_id FROM fx_export e WHERE e.file_id = m.target_file AND e.export_name = m.imported),
  (SELECT e.fn_id FROM fx_export e WHERE e.file_id = m.target_file AND e.export_name = 'default')) AS export_fn FROM mods m WHERE m.target_file IS NOT NULL""")
oracle("join_call_resolution", FX, RESOLVED + " SELECT order_key, seq, name, obj, callee_fn FROM res")
oracle("join_arg_param", FX, ARGS + " SELECT order_key, seq, callee_fn, ref, param FROM args")
oracle("taint_local", FX, """, t AS (SELECT fn_id, lhs AS name FROM fx_binding WHERE has_source
  UNION SELECT b.fn_id, b.lhs FROM t JOIN fx_binding b ON t.fn_id = b.fn_id AND t.name = b.ref) SELECT fn_id, name FROM t""")
oracle("taint_interproc", ["fn_edge", "fn_seed"], """, t AS (SELECT fn AS fn_id, pos FROM fn_seed
  UNION SELECT e.dst_fn, e.dst_pos FROM t JOIN fn_edge e ON t.fn_id = e.src_fn AND t.pos = e.src_pos) SELECT fn_id, 'p' || pos AS name FROM t""")
oracle("taint_carrier", ["nest"], """, up AS (SELECT fn_id, fn_id AS at FROM nest
  UNION SELECT u.fn_id, n.parent_fn FROM up u JOIN nest n ON u.at = n.fn_id WHERE NOT n.is_carrier AND n.parent_fn IS NOT NULL)
SELECT f.fn_id, c.at AS carrier_fn FROM nest f LEFT JOIN (SELECT u.* FROM up u JOIN nest n ON u.at = n.fn_id WHERE n.is_carrier) c USING (fn_id)""")
oracle("join_sink_taint", FX, TAINT + """ SELECT order_key, seq, name, arg0_ref, arg0_has_source OR EXISTS (
  SELECT 1 FROM t WHERE t.fn_id = c.fn_id AND t.name = c.arg0_ref) AS confirmed FROM fx_call c WHERE name IN ('query', 'exec', 'readFile')""")
oracle("taint_reach", FX, ARGS + """, edge AS (SELECT fn_id AS sf, ref AS sn, fn_id AS df, lhs AS dn FROM fx_binding UNION SELECT fn_id, ref, callee_fn, param FROM args),
seed AS (SELECT fn_id, lhs AS name FROM fx_binding WHERE has_source UNION SELECT callee_fn, param FROM args WHERE has_source),
t(fn_id, name, hops, src) USING KEY (fn_id, name) AS (SELECT fn_id, name, CAST(0 AS BIGINT), {'f': fn_id, 'n': name} FROM seed
  UNION SELECT e.df, e.dn, max(t.hops) + 1, min(t.src) FROM t JOIN edge e ON t.fn_id = e.sf AND t.name = e.sn
  WHERE NOT EXISTS (SELECT 1 FROM recurring.t r WHERE r.fn_id = e.df AND r.name = e.dn) GROUP BY e.df, e.dn)
SELECT c.order_key, c.seq, c.fn_id, c.name AS sink, CAST(c.line AS BIGINT) AS line, t.src.f AS source_fn, t.src.n AS source_name, t.hops
  FROM fx_call c JOIN t ON t.fn_id = c.fn_id AND t.name = c.arg0_ref WHERE c.name IN ('query', 'exec', 'readFile')""")
