"""Hot keys, both join paths, order independence, and streams against batches."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ramparts.operators import fixes, taint, triage
from ramparts.session import lookup_join, ranked, scratch
from ramparts.streaming import flows


def test_lookup_join_is_the_same_salted_or_broadcast(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"))
    right = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("left", "inner"):
        plain = sorted(map(tuple, left.join(right, "k", how).select("id", "k", "v").collect()))
        for rows in (0, 1000):
            got = lookup_join(left, right, ["k"], ["id"], how, broadcast_rows=rows, salts=4)
            assert sorted(map(tuple, got.select("id", "k", "v").collect())) == plain


def test_ranked_equals_row_number_with_one_hot_group(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise((F.col("id") % 20).cast("string")).alias("g"), (F.col("id") * 7919 % 97).alias("x"))
    want = rows.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.col("x").desc(), "id")))
    got = ranked(rows, ["g"], [F.col("x").desc(), F.col("id").asc()], "r")
    assert sorted((r.id, r.r) for r in got.collect()) == sorted((r.id, r.r) for r in want.collect())


def _graph(spark):
    edges = [(i, "a", (i * 7 + 3) % 60, "a") for i in range(60)] + [(5, "a", i, "b") for i in range(60)] + [(i, "b", i, "c") for i in range(0, 60, 3)] + [(None, "a", 1, "z")]
    return (spark.createDataFrame([(0, "a")], "fn_id long, name string"),
            spark.createDataFrame(edges, "src_fn long, src_name string, dst_fn long, dst_name string"))


def _reach(seeds, edges):
    known, fresh = set(seeds), set(seeds)
    while fresh:
        fresh = {(c, d) for a, b, c, d in edges if (a, b) in fresh} - known
        known |= fresh
    return known


def test_closure_ignores_partitions_and_join_path(spark):
    seeds, edges = _graph(spark)
    want = _reach([tuple(r) for r in seeds.collect()], [tuple(r) for r in edges.collect()])
    for parts in (1, 5):
        for rows in (0, 1000):
            got = taint.closure(seeds, edges.repartition(parts), broadcast_rows=rows, salts=3)
            assert sorted(map(tuple, got.collect())) == sorted(want)


def _random_graph(seed, names=90):
    """Chains, trees, circles with and without a way in, ladders, self-loops, repeats and edges into seeds."""
    import random
    dice = random.Random(seed)
    edges = [(dice.randrange(names), "n", dice.randrange(names), "n") for _ in range(dice.choice([30, 80, 140]))]
    edges += [(1000 + i, "chain", 1001 + i, "chain") for i in range(40)] + [(dice.randrange(names), "n", 1000, "chain")]
    edges += [(2000 + i, "ring", 2000 + (i + 1) % 9, "ring") for i in range(9)] + [(2003, "ring", 2100, "tail")]
    edges += [(3000 + i, "loop", 3000 + (i + 1) % 7, "loop") for i in range(7)] + [(1020, "chain", 3002, "loop"), (3005, "loop", 3100, "tail")]
    edges += [(4000 + i + a, "rung", 4000 + i + b, "rung") for i in range(0, 20, 2) for a in (0, 1) for b in (2, 3)] + [(1040, "chain", 4000, "rung"), (3100, "tail", 4001, "rung")]
    edges += [(5, "n", 5, "n"), (5000, "dead", 5001, "dead"), (5001, "dead", 5002, "dead"), edges[0], (1010, "chain", 0, "n"), (None, "n", 1, "n")]
    return [(0, "n"), (dice.randrange(names), "n")], edges


def test_shortened_closure_equals_the_plain_walk(spark):
    for seed in range(2):
        seeds, edges = _random_graph(seed)
        rows = spark.createDataFrame(edges, "src_fn long, src_name string, dst_fn long, dst_name string")
        begin = spark.createDataFrame(seeds, "fn_id long, name string")
        want = sorted(_reach(seeds, [e for e in edges if e[0] is not None]))
        for after, rows_sent in ((1, 0), (2, 1000)):
            got = taint.closure(begin, rows, broadcast_rows=rows_sent, salts=3, shortcut_after=after)
            assert sorted(map(tuple, got.collect())) == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    chain = spark.range(10_000).select(F.col("id").alias("src_fn"), F.lit("a").alias("src_name"), (F.col("id") + 1).alias("dst_fn"), F.lit("a").alias("dst_name"))
    labels, plain = [], taint.scratch
    monkeypatch.setattr(taint, "scratch", lambda session, label: labels.append(label) or plain(session, label))
    got = taint.closure(spark.createDataFrame([(0, "a")], "fn_id long, name string"), chain)
    assert got.count() == 10_001 and got.distinct().count() == 10_001
    # rounds of the walk before the shortening, written pointers, and the empty walk after it
    assert 8 + labels.count("pointers") + 1 < 20 and labels.count("taint") == 2


def test_traced_closure_gives_nearest_sources_and_ways(spark):
    _, edges = _graph(spark)
    seeds = spark.createDataFrame([(0, "a"), (9, "a"), (9, "c")], "fn_id long, name string")
    listed = [tuple(r) for r in edges.collect() if r[0] is not None]
    known = {tuple(r): (0, tuple(r)) for r in seeds.collect()}
    fresh, hops = set(known), 0
    while fresh:
        hops, found = hops + 1, {}
        for a, b, c, d in listed:
            if (a, b) in fresh and (c, d) not in known:
                found[c, d] = min(found.get((c, d), known[a, b][1]), known[a, b][1])
        known |= {k: (hops, v) for k, v in found.items()}
        fresh = set(found)
    for rows in (0, 1000):
        got = taint.traced_closure(seeds, edges, broadcast_rows=rows, salts=3)
        assert {(r.fn_id, r.name): (r.hops, (r.source_fn, r.source_name)) for r in got.collect()} == known
    steps = {((a, b), (c, d)) for a, b, c, d in listed}
    for fn, name, path in taint.witness_paths(got, got).collect():
        path = [tuple(p) for p in path]
        assert path[-1] == (fn, name) and path[0] == known[fn, name][1] and len(path) == known[fn, name][0] + 1
        assert all(pair in steps for pair in zip(path, path[1:]))


def test_closure_cap_raises_and_no_seed_is_empty(spark):
    seeds, edges = _graph(spark)
    with pytest.raises(taint.FixpointError):
        taint.closure(seeds, edges, max_rounds=2)
    assert taint.closure(seeds.filter("false"), edges).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ramparts_edges")]


def test_closure_does_not_shuffle_the_edges(spark):
    import contextlib
    import io
    keys = ["src_fn", "src_name", "_salt"]
    name, buckets = "bucket_probe", int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = spark.range(1000).select(F.col("id").alias("src_fn"), F.concat(F.lit("a"), F.col("id")).alias("src_name"), (F.col("id") % 3).cast("int").alias("_salt"))
    edges.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", scratch(spark, "probe")).saveAsTable(name)
    try:
        step = edges.filter("src_fn < 50").hint("merge")
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            spark.table(name).join(step, keys).explain()
        assert "SortMergeJoin" in out.getvalue() and out.getvalue().count("Exchange hashpartitioning") == 1
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_carriers(spark):
    fns = spark.createDataFrame([(1, None, True), (2, 1, False), (3, 2, False), (4, 3, True), (5, 4, False), (6, None, False), (7, 6, False)],
                                "fn_id long, parent_fn long, is_carrier boolean")
    for rows in (0, 1000):
        got = {r.fn_id: r.carrier_fn for r in taint.carriers(fns, broadcast_rows=rows).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: None, 7: None}
    circle = spark.createDataFrame([(1, 2, False), (2, 1, False)], "fn_id long, parent_fn long, is_carrier boolean")
    with pytest.raises(taint.FixpointError):
        taint.carriers(circle, max_rounds=4)


def _find(spark):
    return spark.range(600).select(
        F.col("id").alias("finding_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.concat(F.lit("c"), F.col("id") % 4).alias("class"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 11).cast("string")).alias("evidence"),
        F.when(F.col("id") % 2 == 0, "runnable").otherwise("repro").alias("proof_kind"), F.when(F.col("id") % 5 > 1, F.col("id") % 5 == 2).alias("signal"))


def test_dedup_is_idempotent_and_sections_are_complete(spark):
    once = triage.dedup_findings(_find(spark), ["finding_id"])
    twice = triage.dedup_findings(once, ["finding_id"])
    assert sorted(r.finding_id for r in once.collect()) == sorted(r.finding_id for r in twice.collect())
    judged = triage.assign_section(_find(spark))
    assert judged.filter("section = 'confirmed'").count() + judged.filter("section = 'unconfirmed'").count() == 600
    assert judged.filter("proof_kind = 'repro' and proven = false").count() == 0


def _split(df, folder, spark, parts=range(4)):
    for part in parts:
        df.filter(F.col("finding_id") % 4 == part).coalesce(1).write.mode("append").parquet(folder)


def test_streams_in_several_batches_equal_the_batch(spark):
    findings = triage.assign_section(_find(spark))
    folder = scratch(spark, "in")
    _split(findings, folder, spark)
    stream = lambda: flows.read_stream(spark, folder, "*.parquet", files_per_trigger=1)
    unique = flows.run_append(flows.dedup_stream(stream(), ["class", "evidence"], ["finding_id"], "30 days").select("class", "evidence"), "t")
    assert sorted(map(tuple, unique.collect())) == sorted(map(tuple, findings.select("class", "evidence").distinct().collect()))
    memory = spark.createDataFrame([("c9", "s", None, None)], "class string, signature string, first_seen timestamp, last_seen timestamp")
    marked, merged = flows.memory_stream(stream(), memory, ["finding_id"])
    assert marked.count() == 600
    want = {r["class"]: r.t for r in findings.filter("section = 'confirmed'").groupBy("class").agg(F.max("ts").alias("t")).collect()}
    got = {r["class"]: r.last_seen for r in merged.collect()}
    assert got.pop("c9") is None and got == want


def _loads(spark, rows):
    return spark.createDataFrame(rows, "tab_id long, load_id long, t long, url string, closed boolean").withColumn("ts", F.timestamp_seconds("t")).drop("t")


def _files_below(path):
    import glob
    return sorted(p.removeprefix(path) for p in glob.glob(f"{path}/tabs/*/*"))


def test_latest_tab_stream_equals_batch_after_every_file(spark):
    folder, place, sofar = scratch(spark, "tabs-in"), scratch(spark, "tabs"), []
    # out of order, closed and opened again, a late load of a closed tab, a null tab, ties by time, a bucket that loses all its tabs, an empty file
    files = [[(n % 7, n, n * 37 % 101, f"u{n}", n % 13 == 0) for n in range(0, 120, step)] for step in (1, 3)]
    files += [[(3, 500, 900, None, True), (None, 501, 5, "u", False)], [], [(3, 502, 800, "late", False), (4, 503, 901, "a", False), (4, 504, 901, "b", True)],
              [(n, 600 + n, 1000, "end", True) for n in range(7)], [(3, 700, 1001, "again", False), (3, 701, 1001, "tie", False)]]
    for rows in files:
        sofar += rows
        _loads(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        for _ in range(2 if len(rows) == 2 else 1):  # now and then a start without a new file
            got = flows.latest_tabs_stream(flows.read_stream(spark, folder, "*.parquet", files_per_trigger=1), place, buckets=4)
        want = flows.latest_tabs(_loads(spark, sofar))
        assert sorted(map(str, got.select("tab_id", "ts", "load_id", "url").collect())) == sorted(map(str, want.select("tab_id", "ts", "load_id", "url").collect()))
    assert len(_files_below(place)) <= 4 * 2


def test_closed_tabs_leave_the_state_in_the_time_named(spark):
    folder, place = scratch(spark, "tabs-in"), scratch(spark, "tabs")
    for rows in ([(n, n, n, "u", False) for n in range(20)], [(n, 100 + n, 50, "u", n % 2 == 0) for n in range(20)], [(99, 300, 7200, "u", False), *[(n, 400 + n, 7200, "v", False) for n in range(1, 20, 2)]]):
        _loads(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        got = flows.latest_tabs_stream(flows.read_stream(spark, folder, "*.parquet", files_per_trigger=1), place, late="1 hour", buckets=1)
    index = max((r for r in spark.read.parquet(f"{place}/index").collect()), key=lambda r: r.batch)
    state = spark.read.parquet(f"{place}/tabs/bucket=0/slot={index.slot}").filter("filled")
    assert got.count() == state.count() == 11  # open tabs only: the ten closings of two hours ago are gone


def test_a_tab_batch_that_runs_again_changes_nothing(spark, monkeypatch):
    folder, place, plain = scratch(spark, "tabs-in"), scratch(spark, "tabs"), flows.run_batches
    monkeypatch.setattr(flows, "run_batches", lambda rows, handle, where, mode="append": plain(rows, lambda batch, n: (handle(batch, n), handle(batch, n)), where, mode))
    sofar = []
    for start in range(3):
        rows = [(n % 5, 10 * n + start, n * 31 % 17 + start, "u", n % 4 == 0) for n in range(30)]
        sofar += rows
        _loads(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        got = flows.latest_tabs_stream(flows.read_stream(spark, folder, "*.parquet", files_per_trigger=1), place, buckets=2)
        assert sorted(map(str, got.select("tab_id", "load_id").collect())) == sorted(map(str, flows.latest_tabs(_loads(spark, sofar)).select("tab_id", "load_id").collect()))


def test_streams_go_on_after_a_restart(spark):
    findings = triage.assign_section(_find(spark))
    folder, places = scratch(spark, "restart-in"), {k: scratch(spark, k) for k in ("unique", "memory", "tabs")}
    memory = spark.createDataFrame([("c9", "s", None, None)], "class string, signature string, first_seen timestamp, last_seen timestamp")
    loads = lambda df: df.select((F.col("finding_id") % 7).alias("tab_id"), F.col("finding_id").alias("load_id"), "ts", F.col("evidence").alias("url"),
                                 (F.col("finding_id") % 13 == 0).alias("closed"))
    # half the files, a new start with the other half, a start without new files
    for parts in (range(2), range(2, 4), ()):
        _split(findings, folder, spark, parts)
        stream = lambda: flows.read_stream(spark, folder, "*.parquet", files_per_trigger=1)
        unique = flows.run_append(flows.dedup_stream(stream(), ["class", "evidence"], ["finding_id"], "30 days").select("class", "evidence"), "t", places["unique"])
        marked, merged = flows.memory_stream(stream(), memory, ["finding_id"], places["memory"])
        tabs = flows.latest_tabs_stream(loads(stream()), places["tabs"])
    assert sorted(map(tuple, unique.collect())) == sorted(map(tuple, findings.select("class", "evidence").distinct().collect()))
    assert sorted(r.finding_id for r in marked.select("finding_id").collect()) == sorted(r.finding_id for r in findings.collect())
    want = {r["class"]: r.t for r in findings.filter("section = 'confirmed'").groupBy("class").agg(F.max("ts").alias("t")).collect()}
    got = {r["class"]: r.last_seen for r in merged.collect()}
    assert got.pop("c9") is None and got == want
    assert sorted(map(tuple, tabs.collect())) == sorted(map(tuple, flows.latest_tabs(loads(findings)).collect()))


def test_late_findings_are_neither_lost_nor_repeated(spark):
    day, where, folder = 86_400, scratch(spark, "exact"), scratch(spark, "late-in")
    files = [[(1, "a", "x", 100 * day), (2, "b", "x", 100 * day), (3, "a", "x", 101 * day), (4, None, "x", 100 * day)],
             [(5, "late", "y", 40 * day), (6, "a", "x", 40 * day), (7, None, "x", 41 * day)], [(8, "b", "x", 300 * day), (9, "late", "y", 41 * day), (10, "c", "z", 1 * day)]]
    shape = "finding_id long, class string, evidence string, t long"
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, shape).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(folder)
        stream = flows.read_stream(spark, folder, "*.parquet", files_per_trigger=1)
        for _ in range(2):  # a start with the new file, and one without any
            got = flows.dedup_exactly(stream, ["class", "evidence"], where, buckets=4)
        firsts = {}
        for row in (r for part in files[:n + 1] for r in part):
            firsts.setdefault(row[1:3], row[0])
        assert {(r["class"], r.evidence): r.finding_id for r in got.collect()} == firsts and got.count() == len(firsts)


def test_fixes_apply_in_line_order(spark):
    files = spark.createDataFrame([(1, "a\na\nb"), (2, "x")], "file_id long, code string")
    todo = spark.createDataFrame([(1, 1, "a", "A", True), (1, 2, "a", "AA", True), (1, 3, "zz", "q", True), (1, 3, "b", "B", False)],
                                 "file_id long, line int, before string, after string, applyable boolean")
    for rows in (0, 1000):
        got = {r.file_id: (r.code, r.applied, r.conflicts) for r in fixes.apply_fixes(files, todo, broadcast_rows=rows).collect()}
        assert got == {1: ("A\nAA\nb", 2, 2), 2: ("x", 0, 0)}


def test_a_streamed_table_may_be_a_folder_of_files(spark):
    folder = scratch(spark, "given")
    rows = spark.range(40).select("id", (F.col("id") * 3).alias("v"))
    rows.repartition(4).write.parquet(f"{folder}/rows.parquet")
    spark.range(7).select("id", F.lit("other").alias("w")).repartition(2).write.parquet(f"{folder}/others.parquet")
    got = flows.run_append(flows.read_stream(spark, folder, "rows.parquet", files_per_trigger=1), "got")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_not_broadcast_by_their_size_on_disk(spark):
    from ramparts.operators import facts
    place = scratch(spark, "small-on-disk")
    spark.range(4000).select(F.col("id").alias("file_id"), F.lit("a").alias("rel"), F.lit("x" * 500).alias("code")).write.parquet(place)
    lexed = facts.Lexed(spark.read.parquet(place), spark.range(1), ("file_id", "rel"))
    got = lexed.with_files(spark.range(9000).select((F.col("id") % 5000).alias("file_id"), "id"), ["rel"], "code")
    plan = _plan(got)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert got.count() == 8000


def test_files_without_a_rules_words_are_left_out_and_results_stay(spark):
    from ramparts.operators import code, facts
    texts = ["const token = Math.random();", "const a = math.floor(random);", "const sessionKey = 1 + Math\n  .random() * 9;", "call(x);", None]
    files = spark.createDataFrame([(i, f"src/f{i}.js", "business", t) for i, t in enumerate(texts)], "file_id long, rel string, unit string, code string")
    fewer = facts.mentioning(files, *code.RANDOM_WORDS)
    assert sorted(r.file_id for r in fewer.collect()) == [0, 1, 2]

    def found(some):
        rows = code.insecure_random(facts.bindings_of(facts.lex(some, ["unit"]), ["rel", "unit"])).select("rel", "line", "summary")
        return sorted(map(tuple, rows.collect()))
    assert found(fewer) == found(files) and len(found(fewer)) == 2


_LEXED = ["import { a, b as c } from './x';\nimport * as d from 'y';\nconst { e, f: g } = require('z'), { h } = other;\nexport { k as l, m };\nexport default function n(p, { q, r: [s] }) { return p; }",
          "const t = t1.input(z).query(async ({ input, ctx: w }) => { const u = await req.json(); return db.find({ id: u.id, list: ['a', `b${c + '('}`] }, !x); });",
          "module.exports = { k, v: w };\nexports.one = one;\nclass A { @Get(':id') async m(@Param('id') id: string, [b, c] = []): Promise<void> { this.v = Math.random() + q.w; } }",
          "const resolvers = { Query: { two: (_, { term, other: alias }) => run(term, req.query.v), async *three(o) { save(Math.floor(Math.random())); } } };", "", None]


def test_facts_read_the_same_of_a_table_that_holds_what_they_need(spark):
    from ramparts.operators import facts
    files = spark.createDataFrame([(i, f"src/f{i}.js", t) for i, t in enumerate(_LEXED)], "file_id long, rel string, code string")
    read = {"functions": lambda x: facts.functions_of(x, []), "calls": lambda x: facts.calls_of(x, []), "bindings": lambda x: facts.bindings_of(x),
            "imports": lambda x: facts.imports_of(x, []), "exports": facts.exports_of}
    full = facts.lex(files, [])
    for fact, rows in read.items():
        part = facts.lex(files, [], [fact])
        assert part.tokens.count() < full.tokens.count() and len(part.tokens.columns) < len(full.tokens.columns)
        want = sorted(map(str, rows(full).collect()))
        assert want and sorted(map(str, rows(part).collect())) == want
    # taint enters through the same operands, though only those at a request are grouped
    flowing = facts.chains(full).filter("flows is not null").select("file_id", "inside", "region", "chain", "flows")
    assert sorted(map(tuple, facts._names_flowing(full).collect())) == sorted(map(tuple, flowing.collect()))


def test_a_lookup_makes_its_left_side_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch
    left = spark.range(60).select((F.col("id") % 3).alias("k"), "id").mapInArrow(seen, "k long, id long")
    right = spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = lookup_join(left, right, ["k"], ["id"], broadcast_rows=0)
    assert sorted(r.v for r in got.collect()) == sorted(2 * (i % 3) for i in range(60))
    assert made.value == 60


def test_a_scan_is_no_single_plan_of_all_detectors(spark):
    from ramparts.plans import code_scan
    text = "async function f(req) {\n  const a = await Item.findById(req.params.id);\n  await a.save();\n  exec('ls ' + req.body.dir);\n}\n"
    files = spark.createDataFrame([(1, "src/a.js", "business", text)], "file_id long, rel string, unit string, code string")
    got = code_scan.scan_code(files)
    # bindings and comparisons are joined as they are read; what needs calls, functions or taint is written before
    assert _plan(got).count("SortMergeJoin") <= 6
    assert sorted(r["class"] for r in got.collect()) == ["Broken Object-Level Authorization", "Command Injection", "Race Condition (TOCTOU)"]
