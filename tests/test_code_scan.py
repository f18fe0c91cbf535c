"""End-to-end code scans over small programs written for these tests."""

from collections import Counter

import pytest

from ramparts.operators import code, facts
from ramparts.plans import code_scan
from ramparts.sources.code_files import code_files, read_tree

KEY = "AK" + "IA" + "7" * 16
PUSH = "gh" + "p_" + "m" * 36

FAULTY = {
    "harbour/stock.js": '''
// crates in and out
const move = async (shelf, amount) => {
  const crate = await Crate.findUnique({ shelf });
  if (crate.left < amount) throw new Error("empty");
  await crate.update({
    left: crate.left - amount,
  });
};
''',
    "harbour/siren.js": f'''
var otpSeed = Math.random() * 1e6;
module.exports.blow = (ctx) => {{
  execSync(`play ${{ctx.query.tune}} --loud`);
}};
function seal(crate) {{
  return crypto.createHash('sha1').update(crate).digest();
}}
const deploy = {{ push: "{PUSH}", region: "{KEY}" }};
function refused(given, hmac) {{
  return hmac !== given;
}}
''',
    "harbour/desk.ts": '''
import * as fs from "fs";
/* berths: pool.execute("DELETE " + request.body.x) stays a comment */
export const logOf = (request, reply) => {
  fs.createReadStream("/srv/logs/" + request.query.day).pipe(reply);
};

export const berthCard = async (request, reply) => {
  const note = "exec('ls ' + request.body.y)";
  const wanted = request.params.berth;
  reply.send(await pool.execute(
    "SELECT hull, mast FROM berths" +
    " WHERE berth = '" + wanted + "'"
  ));
};
''',
    "harbour/crew.js": '''
const passOf = (sailor) => jwt.sign({ sailor }, "tide-and-wind", { algorithm: "none" });
const nameOn = (pass) => jwt.decode(pass).sailor;
exports.file = async (ctx) => {
  ctx.body = await Sailor.findByPk(ctx.params.sailor);
};
''',
}

SOUND = {
    "pier/gate.ts": '''
import { z } from "zod";
const Plate = z.object({ plate: z.string() });
export const enter = async (request, reply) => {
  const { plate } = Plate.parse(request.body);
  const slip = crypto.randomBytes(24).toString("base64url");
  await pool.execute("UPDATE gates SET slip = ? WHERE plate = ?", [slip, plate]);
  reply.send({ slip });
};
export const sameSlip = (one, other) => one.length === other.length && crypto.timingSafeEqual(one, other);
''',
    "pier/sailors.js": '''
exports.mine = async (ctx) => {
  ctx.body = await Sailor.findOne({ where: { id: ctx.params.sailor, harbour: ctx.session.harbour } });
};
exports.enrol = async (ctx) => {
  const locked = await argon2.hash(ctx.request.body.phrase);
  await Sailor.create({ locked });
};
const pass = (sailor) => jwt.sign({ sailor }, process.env.SEAL, { expiresIn: 900, algorithm: "HS512" });
const check = (p) => jwt.verify(p, process.env.SEAL, { algorithms: ["HS512"] });
''',
    "pier/stock.js": '''
async function move(shelf, amount) {
  return sequelize.transaction(async (t) => {
    const crate = await Crate.findByPk(shelf, { transaction: t, lock: true });
    await crate.update({ left: crate.left - amount }, { transaction: t });
  });
}
''',
}

ACROSS = {
    "lib/ledger.js": '''
function total(rows) {
  return rows.length;
}

export function entry(mark) {
  const shown = total([mark]);
  return conn.raw("SELECT " + shown + " FROM ledger WHERE mark = " + mark);
}
''',
    "lib/print.js": '''
import { execSync } from "child_process";

function spool(sheet) {
  execSync("lpr -P dock " + sheet);
}

export function label(sheet) {
  spool(sheet);
}
''',
    "web/pages.js": '''
import { entry } from "../lib/ledger";
import { label } from "../lib/print";

export const history = async (request, reply) => {
  const mark = request.query.mark;
  const rows = entry(mark);
  reply.send(await rows);
};

export const stick = (request, reply) => {
  label(request.body.sheet);
  reply.send("sent");
};

function nightly(sheet) {
  execSync("lpr -P night " + sheet);
}
''',
}

FRAMEWORKS = {
    "nest/buoys.controller.ts": '''
@Controller("buoys")
export class Buoys {
  @Delete(":buoy")
  drop(@Param("buoy") buoy: string, reason: string) {
    this.log(reason);
    return this.db.execute("DELETE FROM buoys WHERE buoy = " + buoy);
  }

  @Get()
  near(@Query("lat") lat: string, @Query("lon") lon: string) {
    return this.db.execute(`SELECT * FROM buoys WHERE lat = ${lat} AND lon = ${lon}`);
  }

  @Get("all")
  every() {
    return this.db.execute("SELECT * FROM buoys ORDER BY ?", ["buoy"]);
  }
}
''',
    "next/tides.ts": '''
export const GET = async (request) => {
  const harbour = request.nextUrl.searchParams.get("harbour");
  return conn.raw("SELECT height FROM tides WHERE harbour = '" + harbour + "' LIMIT 1");
};

export const PUT = async (request) => {
  const sent = await request.formData();
  await conn.raw("UPDATE tides SET height = " + sent.height);
};
''',
    "graph/fleet.js": '''
export default {
  Subscription: {
    moved: (fleet, args) => conn.raw("LISTEN moves_" + args.fleet),
  },
  Query: {
    ship: (_root, { imo }) => conn.raw("SELECT flag FROM ships WHERE imo = " + imo),
    sister: (ship, args) => conn.raw("SELECT flag FROM ships WHERE imo = " + ship.sister),
  },
};
''',
    "rpc/cargo.ts": '''
export const cargo = router({
  weigh: openProcedure.mutation(({ input }) => note(input.bill)),
  find: openProcedure
    .input(z.object({ bill: z.string(), port: z.string() }))
    .query(async ({ input }) => {
      const bill = input.bill;
      return conn.raw("SELECT kilos FROM cargo WHERE bill = '" + bill + "'");
    }),
});

function note(bill) {
  return conn.raw("INSERT INTO weighed VALUES ('" + bill + "')");
}
''',
}


def table(spark, program):
    rows = [(i, "r", rel, text) for i, (rel, text) in enumerate(sorted(program.items()))]
    return code_files(spark.createDataFrame(rows, "file_id long, repo string, rel string, code string"))


def scan(spark, program, memory=None):
    return [r.asDict() for r in code_scan.scan_code(table(spark, program), memory).collect()]


def test_faulty_program_shows_every_class(spark):
    found = scan(spark, FAULTY)
    sections = Counter((f["class"], f["section"]) for f in found)
    assert sections == {
        ("Hardcoded Secret", "confirmed"): 2, ("SQL Injection", "confirmed"): 1, ("Command Injection", "confirmed"): 1,
        ("Weak Hash Algorithm", "confirmed"): 1, ("Insecure Randomness", "confirmed"): 1, ("Path Traversal", "confirmed"): 1,
        ("Non-constant-time Comparison", "unconfirmed"): 1, ("Broken Object-Level Authorization", "unconfirmed"): 1,
        ("JWT Implementation Error", "unconfirmed"): 4, ("Race Condition (TOCTOU)", "unconfirmed"): 1}
    lines = {f["class"]: f["line"] for f in found}
    assert lines["SQL Injection"] == 11 and lines["Path Traversal"] == 5 and lines["Race Condition (TOCTOU)"] == 4


def test_sound_program_is_quiet_and_earns_positives(spark):
    assert scan(spark, SOUND) == []
    labels = {r.label for r in code.first_per_label(code.good_practices(table(spark, SOUND))).collect()}
    assert labels == {"Queries with bound values", "Slow password hash", "Timing-safe equality", "Tokens from system randomness", "Schema validation"}


def test_taint_crosses_files_and_functions(spark):
    found = scan(spark, ACROSS)
    assert {(f["class"], f["rel"], f["section"]) for f in found} == {
        ("SQL Injection", "lib/ledger.js", "confirmed"), ("Command Injection", "lib/print.js", "confirmed"), ("Command Injection", "web/pages.js", "unconfirmed")}


def test_repositories_do_not_mix(spark):
    one = [(i, "one", rel, text) for i, (rel, text) in enumerate(sorted(ACROSS.items()))]
    same_path = (10, "two", "lib/ledger.js", "export function entry(mark) {\n  log(mark);\n  return conn.raw(\"SELECT \" + mark);\n}\n")
    files = code_files(spark.createDataFrame([*one, same_path], "file_id long, repo string, rel string, code string"))
    found = [(r["class"], r["line"], r["section"]) for r in code_scan.scan_code(files).filter("class = 'SQL Injection'").collect()]
    assert sorted(found) == [("SQL Injection", 3, "unconfirmed"), ("SQL Injection", 8, "confirmed")]


def test_framework_sources(spark):
    found = Counter((f["rel"], f["section"]) for f in scan(spark, FRAMEWORKS) if f["class"] == "SQL Injection")
    assert found == {("nest/buoys.controller.ts", "confirmed"): 2, ("next/tides.ts", "confirmed"): 2, ("graph/fleet.js", "confirmed"): 2,
                     ("graph/fleet.js", "unconfirmed"): 1, ("rpc/cargo.ts", "confirmed"): 2}


def test_long_procedure_inputs_are_sources(spark):
    fields = ",\n".join(f"    field{i}: z.string().describe('column number {i} of the form')" for i in range(60))
    program = {"rpc/form.ts": "export const form = router({\n  save: openProcedure.input(z.object({\n" + fields + "\n  })).mutation(async ({ input }) => {\n"
                              "    return conn.raw(\"INSERT INTO form VALUES ('\" + input.field7 + \"')\");\n  }),\n});\n"}
    assert [f["section"] for f in scan(spark, program) if f["class"] == "SQL Injection"] == ["confirmed"]


def test_known_classes_on_a_second_run(spark):
    from ramparts.operators.memory import load_memory, merge_memory, write_memory
    from ramparts.operators.triage import confirmed_classes
    from ramparts.session import scratch
    from pyspark.sql import functions as F
    first = code_scan.scan_code(table(spark, ACROSS))
    where = scratch(spark, "memory")
    empty = load_memory(spark, where)
    assert empty.count() == 0
    write_memory(merge_memory(empty, confirmed_classes(first), F.current_timestamp()), where)
    again = scan(spark, ACROSS, load_memory(spark, where))
    assert again and all(f["known"] for f in again)


def test_assigned_secrets_show_beside_provider_hints(spark):
    program = {"a.js": f'// looks like eyJ\nconst password = "correct-horse-battery";\nconst apiKey = "{PUSH}";\n'}
    assert Counter((f["line"], f["section"]) for f in scan(spark, program)) == {(2, "unconfirmed"): 1, (3, "confirmed"): 1}


def test_own_detector_joins_the_scan(spark):
    from pyspark.sql import functions as F
    from ramparts.schemas import findings
    code_scan.register_detector("todo", lambda files: findings(
        files.filter(F.col("code").contains("nightly")), detector_id="todo", cls="Left-over", severity="Low", rel=F.col("rel"), summary="s", evidence="e"))
    try:
        assert "Left-over" in {f["class"] for f in scan(spark, ACROSS)}
    finally:
        code_scan.CUSTOM_DETECTORS.clear()


def test_failing_detectors_cost_their_own_findings_only(spark):
    from pyspark.sql import functions as F
    from ramparts.schemas import findings

    def raises(files):
        raise KeyError("no rules")
    code_scan.register_detector("plan", raises)
    code_scan.register_detector("run", lambda files: findings(files, detector_id="run", cls="Broken", severity="Low", rel=F.raise_error(F.lit("odd file")).cast("string"), summary="s", evidence="e"))
    code_scan.register_detector("good", lambda files: findings(files, detector_id="good", cls="Seen", severity="Low", rel=F.col("rel"), summary="s", evidence="e"))
    try:
        found, failed = code_scan.scan_with_quarantine(table(spark, {"a.js": "crypto.createHash('md5');\n"}))
        assert {r["class"] for r in found.collect()} == {"Seen", "Weak Hash Algorithm"}
        reasons = dict(map(tuple, failed.collect()))
        assert set(reasons) == {"plan", "run"} and "no rules" in reasons["plan"] and "odd file" in reasons["run"]
    finally:
        code_scan.CUSTOM_DETECTORS.clear()


def test_files_that_cannot_be_read_are_named(spark, tmp_path):
    from ramparts.sources.code_files import quarantined_files
    for rel, data in {"src/a.js": b"let a;", "src/b c+d.ts": b"let \xff\xfe b;", "src/gone.js": b"x", "notes.md": b"\xff"}.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(data)
    tree = read_tree(spark, str(tmp_path))
    rows = quarantined_files(spark, str(tmp_path), tree.filter("rel <> 'src/gone.js'"))
    assert {tuple(r) for r in rows.collect()} == {("src/b c+d.ts", "undecodable"), ("src/gone.js", "unreadable")}


def test_memory_of_another_shape_is_an_error(spark, tmp_path):
    from ramparts.operators.memory import load_memory
    (tmp_path / "memory").mkdir()
    (tmp_path / "memory" / "part-0.parquet").write_text("no table")
    assert load_memory(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        load_memory(spark, str(tmp_path / "memory")).count()


FLOWS = [
    ("id", ["id"]), ('"a" + id', ["id"]), ("id.trim()", []), ("a || b", []), ("ok ? a : b", []), ("[a, b]", []), ("{ a: b }", []),
    ("`x ${a} y ${b.c} z`", ["a", "b"]), ("f(a, b || c)", ["a"]), ('"x" + (a || b)', []), ("await load(a)", ["a"]), ("a.b.c", ["a"]),
    ("req.query.id", [facts.SOURCE]), ("req.query.id.trim()", []), ("await request.json()", [facts.SOURCE]), ("request.headers.get(\"x\")", [facts.SOURCE]),
    ("req.user", ["req"]), ("a[b]", ["a"]), ("xs.map(x => q(x))", []), ("null", []), ("12", []), ("'text'", []), ("req.body.a || \"\"", []),
]


def test_flow_names(spark):
    rows = [(i, "a.js", f"const taken = 1;\nsink({expression});\n") for i, (expression, _) in enumerate(FLOWS)]
    calls = facts.calls_of(facts.lex(spark.createDataFrame(rows, "file_id long, rel string, code string"), []), []).filter("name = 'sink'").collect()
    found = {c.file_id: sorted({n for a in c.args for n in a.refs} | ({facts.SOURCE} if any(a.has_source for a in c.args) else set())) for c in calls}
    assert found == {i: sorted(names) for i, (_, names) in enumerate(FLOWS)}


def flow(sql, before="const wanted = req.query.id;"):
    return "exports.show = async (req, res) => {\n  " + before + "\n  return pool.query(" + sql + ");\n};\n"


DEEP = {
    "plain": flow('"SELECT " + wanted'),
    "long": flow(" + ".join(f'"part {i} (" + n{i}' for i in range(1000)) + " + wanted"),
    "calls": flow('"SELECT " + ' + "f(" * 40 + "wanted" + ")" * 40),
    "groups": flow('"SELECT " + ' + "(" * 40 + "wanted" + ")" * 40),
    "steps": flow('"SELECT " + found', "const found = req.query" + "".join(f".step{i}[{i}]" for i in range(60)) + ";"),
    "template": flow("`SELECT ${ pick(`'${wanted}'`, { a: \"}\" }) } FROM t`"),
    "own_line": flow('"SELECT " + wanted').replace("=> {", "=>\n{"),
    "one_line": flow('"SELECT " + wanted').replace("\n", " "),
    "regex": flow('"SELECT " + wanted', 'const odd = /["`(]/.test(req.url); const wanted = req.query.id;'),
    "no_semicolons": flow('"SELECT " + wanted').replace(";", ""),
    "typed": flow('"SELECT " + wanted', "const wanted: string = req.query.id;").replace("(req, res)", "(req: Request, res: Response): Promise<void>"),
}


def test_code_of_any_depth_and_layout(spark):
    program = {f"src/{name}.ts": text for name, text in DEEP.items()}
    found = {f["rel"]: f["section"] for f in scan(spark, program) if f["class"] == "SQL Injection"}
    assert found == {rel: "confirmed" for rel in program}


def test_comments_and_strings_hold_no_code(spark):
    program = {"a.js": '''
/*
 db.query("S " + req.query.id);
 crypto.createHash("md5");
*/
const text = "exec('ls ' + req.body.y)", more = 'createHash("md5")', tick = `db.query(req.query.id)`;
// jwt.decode(x)
const pattern = /jwt.decode(x)/;
if (a /* === signature */ ) { run(); }
'''}
    assert scan(spark, program) == []


LAYOUTS = {
    "formatted": lambda code: code,
    "no indentation": lambda code: "\n".join(line.strip() for line in code.split("\n")),
    "braces on their own lines": lambda code: code.replace(" {\n", "\n{\n"),
    "few lines": lambda code: code.replace("{\n", "{ ").replace(";\n", "; "),
}


def test_layout_changes_no_finding(spark):
    program = {rel: text for rel, text in (FAULTY | ACROSS).items() if "// crates" not in text and "/* berths" not in text}
    rows = [(f"{layout} {rel}", layout, f"{layout}/{rel}", change(text)) for layout, change in LAYOUTS.items() for rel, text in program.items()]
    found = code_scan.scan_code(code_files(spark.createDataFrame(rows, "file_id string, repo string, rel string, code string"))).collect()
    per_layout = {layout: Counter((f["rel"][len(layout):], f["class"], f["section"], f["summary"]) for f in found if f["rel"].startswith(f"{layout}/")) for layout in LAYOUTS}
    assert sum(per_layout["formatted"].values()) > 10 and all(p == per_layout["formatted"] for p in per_layout.values())


def test_functions_in_one_line(spark):
    code_text = "function a(x) { return x } const b = (y) => ({ y }), c = z => z + 1; class K { m(p) { go(p) } async n({ q, r: s }, ...t) { go(q) } }\n"
    lexed = facts.lex(spark.createDataFrame([(1, "a.js", code_text)], "file_id long, rel string, code string"), [])
    rows = {r["name"]: r for r in facts.functions_of(lexed, []).collect()}
    assert {n: (r["kind"], r["src"]) for n, r in rows.items()} == {
        "a": ("function", "function a(x) { return x }"), "b": ("arrow", "b = (y) => ({ y }),"), "c": ("arrow", "c = z => z + 1;"),
        "m": ("method", "m(p) { go(p) }"), "n": ("method", "async n({ q, r: s }, ...t) { go(q) }")}
    assert [(p["name"], p["pattern"]) for p in rows["n"]["params"]] == [(None, "q , r : s"), (None, None)]
    assert rows["n"]["is_async"] and not rows["m"]["is_async"]
    calls = {(c["name"], c["col"]): c["fn_id"] for c in facts.calls_of(lexed, []).collect()}
    assert set(calls.values()) == {rows["m"]["fn_id"], rows["n"]["fn_id"]}


def test_timing_fix_keeps_the_negation(spark):
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([("if (a.sig !== b) {",), ("return mac == other.mac;",), ("x = 1;",)], "t string")
    fixed = [r[0] for r in rows.select(code.constant_time(F.col("t"))).collect()]
    assert fixed == ["if (!crypto.timingSafeEqual(Buffer.from(a.sig), Buffer.from(b))) {",
                     "return crypto.timingSafeEqual(Buffer.from(mac), Buffer.from(other.mac));", "x = 1;"]


def test_tree_source_skips_folders_and_extensions(spark, tmp_path):
    tmp_path = tmp_path / "a tree+1 100%"
    for rel, text in {"src/a.js": "let a;", "src/api/b.ts": "let b;", "node_modules/c.js": "x", ".git/d.js": "x", "src/e.md": "x", "src/out/f.js": "x"}.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(text)
    rows = {(r.rel, r.unit, r.code) for r in read_tree(spark, str(tmp_path)).collect()}
    assert rows == {("src/a.js", "business", "let a;"), ("src/api/b.ts", "routing", "let b;")}
