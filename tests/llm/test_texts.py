"""Mixing, classifiers, chat formatting, page text and the pipeline."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fixtures import documents, rows_of
from ramparts.llm import chat_format, html_main, mixing, quality, toxicity
from ramparts.llm.queries import ORACLES, QUERIES


def fill(sizes):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        rest = total - sum(full.values())
        goal = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = [s for s in open_ if goal[s] > 2 * sizes[s]]
        if not above:
            return full | goal
        full |= {s: 2.0 * sizes[s] for s in above}


@pytest.mark.parametrize("shard", [200_000, 700])
def test_mix(spark, shard):
    docs = documents(spark)
    got = rows_of(mixing.mix(docs, shard_words=shard))
    texts = rows_of(docs.select("doc_id", "text", "source"))
    sizes, taken, target, n = defaultdict(int), defaultdict(int), {}, len(texts)
    for _, text, source in texts:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    for _, size, source, source_size, goal, took in got:
        assert source_size == sizes[source] and 0 <= took <= 2 * size
        taken[source] += took
        target[source] = goal
    want = fill(sizes)
    shards = {s: max(1, -(-sizes[s] // shard)) for s in sizes}
    assert len(got) == n and all(abs(target[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK * (shards[s] + 1) for s in want)
    again = rows_of(mixing.mix(docs.repartition(3), shard_words=shard))
    assert sorted(again, key=str) == sorted(got, key=str)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_apportion(spark):
    votes = {"a": 53, "b": 24, "c": 23, "d": 0, "e": 1}
    df = spark.createDataFrame([(1, k, v, 17) for k, v in votes.items()], "g int, name string, votes long, seats long")
    won = dict.fromkeys(votes, 0)
    for _ in range(17):
        won[max((v / (2 * won[k] + 1), k) for k, v in votes.items() if v)[1]] += 1
    assert dict(rows_of(mixing.apportion(df, ["g"], ["name"], "votes", "seats").select("name", "quota"))) == won


# about 300 toxic and 500 poor rows to learn from: the toxic words of the rarer languages are hardly among them
@pytest.mark.parametrize("score,label,threshold,least", [(toxicity.score_toxicity, "toxic", 0.7, 0.75), (quality.score_quality, "quality", 0.5, 0.85)])
def test_classifiers(spark, score, label, threshold, least):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels, "doc_id").select("doc_id", "text", label).filter(F.col(label).isNotNull())
    held = [r for r in rows_of(score(known, labels).select("doc_id", label, "predicted", "score")) if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    right = {v: sum(p == v for _, y, p, _ in held if y == v) / sum(y == v for _, y, *_ in held) for v in (0, 1)}
    assert min(right.values()) > least and all(0 <= s <= 1 and p == (s >= threshold) for *_, p, s in held)
    awkward = documents(spark)
    out = score(awkward, labels)
    assert out.count() == awkward.count() and out.filter("score IS NULL").count() == 0
    assert score(awkward.limit(0), labels).count() == 0 and score(awkward, labels.limit(0)).select("score").distinct().count() == 1


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\<|b<|im_end|>\n\\n"), (2, 0, "user", "hi"), (2, 1, "assistant", "other é"), (3, 0, "user", "hi"), (3, 1, "assistant", "other é"),
            (4, 0, None, None), (5, 0, "assistant", ""), (5, 0, "assistant", ""), (None, 0, "user\nx", "<"), (None, 1, "assistant", "<" * 5), (6, 0, "user", "hi")]
    rows += [(7, i, ("user", "assistant")[i % 2], f"turn {i} \\<|") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS node", "2 AS low").repartition(4)
    tree, members = chat_format.format_conversations(df)
    want = []
    for conv in {r[0] for r in rows}:
        turns = [(role or "", text or "") for c, _, role, text in rows if c == conv]
        learned = "".join(t for r, t in turns if r == "assistant")
        size = sum(len(chat_format.format_turn(r, t)[0]) for r, t in turns)
        want.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), size))
    assert sorted(rows_of(chat_format.read_back(tree, members)), key=str) == sorted(want, key=str)
    # every node once, no gaps in the stream, depth first: ancestors stand before their node
    nodes = sorted(rows_of(tree.select("low", "high", "position", "ancestors")))
    assert nodes[0][0] == 0 and all(a[1] == b[0] for a, b in zip(nodes, nodes[1:])) and len(nodes) == 308
    assert all(sum(s["high"] - s["low"] for s in n[3]) == n[2] and all(s["high"] <= n[0] for s in n[3]) for n in nodes)
    assert chat_format.read_back(*chat_format.format_conversations(df.limit(0))).count() == 0


def test_chat_query(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    got = QUERIES["op9_chat_format"](spark, "/root/testdata/sf0.01")
    want = con.execute(ORACLES["op9_chat_format"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(rows_of(got)) == sorted(want.fetchall())


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p></p>", ""),
    ("<title>T</title><body><nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>One  two&nbsp;&amp; <b>three</b><br>four<p>Short.</article><footer>F</footer>", "Head\nOne two & three four\nShort."),
    ("<div class='sidebar'>" + "words " * 60 + "</div><div id=main><p>" + "text " * 40 + "</p><p>end</p></div><div>Small print</div>", ("text " * 40).strip() + "\nend"),
    ("<article><p>" + "a " * 60 + "</p><div class='ad'>Buy</div><p>b</p><section id='comments'><p>" + "no " * 80 + "</p></section></article>", ("a " * 60).strip() + "\nb"),
    ("<article><p>cut off &am", "cut off &am"), ("<script>var a='<p>x</p>'</script><p>y</p><style>p{}</style>", "y"), ("plain text", "plain text"),
    ("<body class='has-sidebar'><main><p>kept</p></main><form><p>name</p></form>", "kept"),
])
def test_page_text(page, text):
    assert html_main.main_text(page) == text


@pytest.mark.parametrize("page,text", [
    ("<article><p class='ad'>Buy<p>Text<p>More</article>", "Text\nMore"),
    ("<article><ul><li class=ad>Buy<li>One<li>Two</ul><p>Text</article>", "One\nTwo\nText"),
    ("<article><p>Text</p><div class=ad>Buy</article><p>after</p>", "Text"),
    ("<article><table><tr><td class=ad>Buy<td>Cell<tr><td>Next</table></article>", "Cell\nNext"),
    ("<article><p>a <span class=ad>Buy <span>now</span></span> b</p></article>", "a b"),
    ("<div class='layout sidebar-right'><article><p>Text</p><div class=ad>Buy</div><p>More</p></article></div><p>x</p>", "Text\nMore"),
    ("<div class='sidebar'><main><p>Text</p></main></div>", "Text"),
    ("<div id=main><p>" + "text " * 40 + "</p></div><div class=sidebar><article>Teaser</article></div>", ("text " * 40).strip()),
    ("<p>Text</p><section id=comments><article>" + "no " * 80 + "</article></section>", "Text"),
])
def test_page_ends(page, text):
    assert html_main.main_text(page) == text


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (1, "u", "<p>a</p>"), (None, "u", "<p>a</p>")], "page_id long, url string, html string").withColumn("text", F.lit(3))
    assert sorted(rows_of(html_main.extract(pages).select("text"))) == [("",), ("a",), ("a",)]
    assert html_main.extract(pages.limit(0)).count() == 0


def test_pipeline_stages(spark):
    """Every stage but the last keeps the columns and acts on what it is given."""
    sf = "/root/testdata/sf0.001"
    docs = documents(spark).withColumn("n_chars", F.char_length("text").cast("long")).select(*corpus_pipeline.COLUMNS).persist()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).persist()
        assert out.columns == list(corpus_pipeline.COLUMNS) and 0 < out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs = out
    texts = [t for (t,) in rows_of(docs.select("text")) if t]
    assert len(set(texts)) == len(texts)
    assert rows_of(corpus_pipeline.STAGES[-1][1](spark, docs, sf))
