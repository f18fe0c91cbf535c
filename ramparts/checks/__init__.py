"""Independent SQL per query."""


def all_oracles() -> dict[str, str]:
    from ramparts.checks import code_sql, fact_sql, finding_sql, stream_sql, surface_sql
    out: dict[str, str] = {}
    for module in (surface_sql, finding_sql, fact_sql, code_sql, stream_sql):
        out.update(module.ORACLES)
    return out
