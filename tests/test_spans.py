"""Functions found where files are cut into tokens: the same as by joins over tokens, without a shuffle."""

import glob

from ramparts.operators import code, facts
from ramparts.session import shared_dir

TEXTS = [
    "async function POST(request, { id, other: alias }) {\n  const q = await request.json();\n  return db.query(`a ${q + 1}`);\n}\n",
    "const f = async (a: string, b = [1, 2]): Promise<T> => { return a === token; };\nexport default x => y => x + y;\n",
    "class C {\n  /* one */ @Get(':id')\n  find(@Param('id') key: string, private readonly plain: T) { return key; }\n}\n",
    "const r = { Query: { one: (_, { term, other: alias }) => db.query('a' + alias) }, go: router.procedure.input(s).query(({ input: inp }) => run(inp)) };\n",
    "// café ☃\r\nlet a = function named() { return function* () {} }, b = function (\n", "", "/* open", "(", None,
]
SCHEMA = "file_id long, rel string, code string"


def _files(spark, ids):
    return spark.createDataFrame([(i, f"src/f{n}.js", t) for n, (i, t) in enumerate(zip(ids, TEXTS, strict=True))], SCHEMA)


def _shown(fns):
    return sorted(str(r) for r in fns.select("file_id", "start", "end", "end_line", "end_off", "line", "col", "start_off", "kind", "name", "is_async", "params_at", "up", "up_prev1", "up_prev2",
                                             "up_chain", "prev1", "params", "resolver", "procedure", "decorated", "is_carrier").collect())


def test_functions_equal_joins_over_tokens(spark):
    for ids in (range(len(TEXTS)), [0, 1, 2, 0, 1, 5, 6, 7, 8], [None, 1, 2, 3, None, 5, 5, 7, 8]):
        files = _files(spark, ids)
        joined = _shown(facts._joined_functions(facts.lex(files, [])))
        assert joined and _shown(facts._functions(facts.lex(files, []))) == joined


def test_function_text_of_files_that_share_an_id(spark):
    files = _files(spark, [0, 1, 2, 0, 4, 5, 6, 7, 8])
    rows = code.function_rows(facts.lex(files, []), ["rel"]).filter("fn_name = 'POST'").collect()
    # a function of either file meets the text of both, as facts are joined with their file by id
    assert {r["rel"] for r in rows} == {"src/f0.js", "src/f3.js"}
    assert next(r["src"] for r in rows if r["rel"] == "src/f0.js") == TEXTS[0].rstrip("\n")


def test_functions_need_no_token_table_and_no_shuffle(spark):
    before = len(glob.glob(f"{shared_dir(spark)}/tokens-*"))
    rows = code.function_rows(facts.lex(_files(spark, range(len(TEXTS))), []), ["rel"], stored=False)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert rows.filter("fn_name = 'POST' AND is_async").count() == 1
    assert len(glob.glob(f"{shared_dir(spark)}/tokens-*")) == before


def test_comparisons_group_their_sides_only(spark):
    lexed = facts.lex(_files(spark, range(len(TEXTS))), [])
    found = {(r["left_name"], r["op"], r["right_name"]) for r in facts.comparisons_of(lexed, ["rel"]).collect()}
    assert found == {("a", "===", "token")}
    assert "chains" not in lexed.made
    assert {(r["t"], r["n1"]) for r in lexed.tokens.filter("beside AND chain = pos").collect()} == {("a", "==="), ("token", ";")}
