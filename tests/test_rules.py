"""Rules as rows: the same findings as the built-in rules, versions, and bad rows refused by name."""

import pytest
from pyspark.sql import functions as F

from ramparts.operators import code, rule_rows, secrets

KEYS = ["AKIA" + "A1B2C3D4E5F6G7H8", "ghp_" + "a1" * 18, "sk_live_" + "0123456789abcdefXY", "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12,
        "-----BEGIN RSA PRIVATE KEY-----", "xoxb-" + "1234567890-abc", "AIza" + "x" * 35]


def _texts(spark):
    rows = [(1, f"one {KEYS[0]} two {KEYS[1]}\n{KEYS[2]}"), (2, "\n".join(KEYS)), (3, ""), (4, None), (5, f"x{KEYS[0]}"), (6, KEYS[0] + " " + KEYS[0]), (6, KEYS[3] + KEYS[3]),
            (7, "helmet(); bcrypt.hash(p); crypto.randomBytes(8)"), (8, "db.query('a = ?', [x])")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("rel", F.concat(F.lit("d/"), F.col("doc_id"))).withColumn("class", F.lit("clashes"))


def test_rules_from_a_table_give_the_findings_of_the_built_in_rules(spark):
    docs, chosen = _texts(spark), rule_rows.load_rules(rule_rows.own_rules(spark).repartition(3))
    assert [r["place"] for r in chosen] == list(range(14))
    got = rule_rows.rule_findings(docs, chosen, "text", F.col("rel"), ["doc_id", "rel"])
    want = secrets.located_provider_findings(docs, "text", F.col("rel"), ["doc_id", "rel"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() >= 10
    files = docs.withColumn("file_id", F.col("doc_id"))
    assert sorted(map(str, rule_rows.rule_signs(files, chosen, "text", ["rel", "file_id"]).collect())) == sorted(map(str, code.good_practices(files, "text").collect()))


def _rule(**fields):
    row = {"version": 1, "place": 0, "rule_id": "own", "detector_id": "mine", "kind": "match", "class": "Internal Name", "label": "host", "severity": "Low",
           "pattern": r"[a-z]+\.corp", "hints": None, "proves": False, "impact": None} | fields
    return tuple(row.values())


def test_versions_kinds_and_empty_tables(spark):
    table = spark.createDataFrame([_rule(), _rule(version=2, severity="High"), _rule(version=2, rule_id="b", pattern="corp", hints=["corp"], proves=True, place=None)], rule_rows.RULE_ROWS)
    docs = spark.createDataFrame([(1, "a.corp\nb.corp c.corp")], "doc_id long, text string")

    def found(chosen):
        return sorted((r.severity, r.section, r.line, r.col, r.summary) for r in rule_rows.rule_findings(docs, chosen, "text", F.lit("d"), ["doc_id"]).collect())
    low = [("unconfirmed", 1, 1, "host in text"), ("unconfirmed", 2, 1, "host in text"), ("unconfirmed", 2, 8, "host in text")]
    assert found(rule_rows.load_rules(table, 1)) == [("Low", *r) for r in low]
    newest = rule_rows.load_rules(table)
    assert [r["rule_id"] for r in newest] == ["own", "b"]
    assert found(newest) == sorted([("High", *r) for r in low] + [("Low", "confirmed", *at, "host in text") for at in ((1, 3), (2, 3), (2, 10))])
    assert found([]) == [] and rule_rows.rule_signs(docs, newest, "text", ["doc_id"]).count() == 0
    assert rule_rows.load_rules(table.filter("false")) == []
    assert rule_rows.rule_findings(docs.filter("false"), newest, "text", F.lit("d"), ["doc_id"]).count() == 0


def test_bad_rows_are_refused_by_name(spark):
    bad = {"broken": {"pattern": "(a"}, "empty": {"pattern": "a*"}, "grave": {"severity": "Terrible"}, "kind": {"kind": "guess"}, "hint": {"hints": ["a", ""]},
           "nameless": {"label": None}, "classless": {"class": None}}
    rows = [_rule(rule_id=name, **fields) for name, fields in bad.items()] + [_rule(), _rule(rule_id="twice"), _rule(rule_id="twice"), _rule(rule_id=None), _rule(rule_id="timeless", version=None)]
    with pytest.raises(rule_rows.RuleError) as error:
        rule_rows.load_rules(spark.createDataFrame(rows, rule_rows.RULE_ROWS))
    said = str(error.value)
    assert all(f"{name}: " in said for name in [*bad, "twice", "timeless"]) and "without a name" in said and "own: " not in said
    with pytest.raises(rule_rows.RuleError, match="no version 7"):
        rule_rows.load_rules(rule_rows.own_rules(spark), 7)
    with pytest.raises(rule_rows.RuleError, match="more than"):
        rule_rows.load_rules(spark.createDataFrame([_rule(rule_id=str(n)) for n in range(rule_rows.MOST_RULES + 1)], rule_rows.RULE_ROWS))


def test_a_scan_takes_rules_of_a_table(spark):
    from ramparts.plans.code_scan import scan_code
    files = spark.createDataFrame([(1, "a.js", "const u = 1;\nfetch('db.corp');", "business")], "file_id long, rel string, code string, unit string")
    chosen = rule_rows.load_rules(spark.createDataFrame([_rule()], rule_rows.RULE_ROWS))
    assert [(r["class"], r.line, r.col, r.rel) for r in scan_code(files, rules=chosen).filter("detector_id = 'mine'").collect()] == [("Internal Name", 2, 8, "a.js")]
