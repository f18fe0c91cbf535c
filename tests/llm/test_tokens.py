"""SentencePiece tables, the Merkle manifest and collocations against plain versions."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from fixtures import documents, rows_of
from ramparts.llm import collocations, manifest, piece_bpe
from ramparts.llm.queries import QUERIES, tokenizer_path

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_tokens_of_awkward_texts(spark, library):
    loaded = piece_bpe.load_model(MODEL)
    encoder, decoder, pick, pieces = piece_bpe.Encoder(loaded), piece_bpe.Decoder(loaded), random.Random(5), list(loaded["ids"])
    texts = ["", " ", "  ", " " * 45, "▁x ▁", "<s></s><0x41>", "\n\ta\x00b\r", "ﬁ Ⅳ é", "a" * 3000, "\U0001F600" * 20, "in" * 500 + " the" * 500]
    for _ in range(3000):
        texts.append("".join(pick.choice(pieces) for _ in range(pick.randint(1, 12))))
        texts.append("".join(chr(pick.choice([pick.randint(0, 0xD7FF), pick.randint(32, 383), 32])) for _ in range(pick.randint(0, 20))))
        texts.append("".join(pick.choice("ab tehrin ▁\n한") for _ in range(pick.randint(0, 60))))
    for text in texts:
        ids = array("i", encoder.ids(text)).tolist()
        assert ids == library.encode(text), text
        assert decoder.text(ids) == library.decode(ids), text
    lists = []
    for _ in range(3000):
        ids = [pick.randrange(32000) if pick.random() < 0.5 else pick.randrange(3, 259) for _ in range(pick.randint(0, 8))]
        assert decoder.text(ids) == library.decode(ids), ids
        lists.append(ids if ids else None)
    lists += [encoder_ids for encoder_ids in map(library.encode, texts)]
    for part in (lists, lists[:1], [None], [[]], []):
        assert decoder.column_of(pa.array(part, pa.list_(pa.int32()))).to_pylist() == [library.decode(ids or []) for ids in part]


def test_tokens_of_rows(spark, library):
    docs = documents(spark).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    done = piece_bpe.decode(piece_bpe.encode(docs, MODEL), MODEL)
    got = rows_of(done.select("doc_id", "text", "ids", "decoded"))
    assert len(got) == docs.count() and set(done.columns) == set(docs.columns)
    for _, text, ids, decoded in got:
        assert ids == library.encode(text or "") and decoded == library.decode(ids)
    assert piece_bpe.decode(piece_bpe.encode(docs.limit(0), MODEL), MODEL).count() == 0


def test_tokens_query(spark, library):
    sf = "/root/testdata/sf0.01"
    texts = dict(rows_of(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")))
    got = rows_of(QUERIES["op11_sentencepiece"](spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
    assert len(got) == len(texts) and tokenizer_path("piece_bpe_32k.model") == MODEL
    for doc, count, ids_sha, decoded_sha in got:
        ids = library.encode(texts[doc] or "")
        assert (count, ids_sha, decoded_sha) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))


def plain_tree(nodes):
    """Root, and the siblings and sides of every node."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(places):
            beside = at ^ 1
            paths[i].append((at % 2, nodes[beside] if beside < len(nodes) else ""))
        nodes = [digest("".join(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]
        places = [at // 2 for at in places]
    return nodes[0], paths


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded) by whole trees in memory."""
    def leaf(row, more=0):
        fields = [*row[:3], row[3] if row[3] is None else row[3] + more, row[4]]
        return digest("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = plain_tree([leaf(r) for r in groups[name]])
    root, above = plain_tree([trees[n][0] for n in names])
    out = []
    for name, upper in zip(names, above):
        for row, path in zip(groups[name], trees[name][1]):
            path = path + upper
            node = leaf(row, int(row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0))
            for is_right, sibling in path:
                node = digest(sibling + node if is_right else node + sibling)
            out.append((row[0], leaf(row), trees[name][0], root, digest("".join(s for _, s in path)), node, node == root))
    return out


def run_manifest(df):
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    return manifest.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"n_chars": more},
                             F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


@pytest.mark.parametrize("levels", [10, 2])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "BLOCK_LEVELS", levels)
    docs = documents(spark).withColumn("n_chars", F.when(F.col("doc_id") % 5 != 0, F.length("text"))).select(
        "*", F.lit("clash").alias("leaf"), F.lit(1).alias("pos"), F.lit(2).alias("grp"))
    docs = docs.unionByName(docs.limit(3).withColumn("lang", F.lit("")), allowMissingColumns=True).unionByName(
        docs.limit(1).withColumn("lang", F.lit("\U0001F600")).withColumn("n_chars", F.lit(2 ** 31 - 1)))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    want = plain_manifest(rows_of(docs.select("doc_id", "source", "lang", "n_chars", "text")))
    got = rows_of(run_manifest(docs))
    assert Counter(got) == Counter(want)
    assert sum(not r[-1] for r in got) > 5


def test_manifest_of_few_rows(spark):
    docs = documents(spark).withColumn("n_chars", F.lit(4))
    assert run_manifest(docs.limit(0)).count() == 0
    one = docs.filter("doc_id = 9013")
    only, = rows_of(run_manifest(one))
    assert only[1] == only[2] == only[3] and only[4] == digest("")


def plain_collocations(rows, least, best, covered):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            named = "und" if lang is None else lang
            n[named] += len(words)
            for k in (1, 2, 3):
                f[named].update(" ".join(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        wanted = {p: a for p, a in counts.items() if " " in p and a >= least}
        scored = []
        for p, a in wanted.items():
            words = p.split(" ")
            if any(f" {p} " in f" {q} " and p != q and 100 * b >= covered * a for q, b in wanted.items()):
                continue
            cuts = [(counts[" ".join(words[:k])], counts[" ".join(words[k:])]) for k in range(1, len(words))]
            score, _, l, r = min((1_000_000 * a * a // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
            scored.append((-score, -a, p.encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return out


@pytest.mark.parametrize("least, best, covered", [(10, 2000, 50), (3, 40, 90)])
def test_collocations(spark, least, best, covered):
    docs = documents(spark).withColumn("n", F.lit(1)).withColumn("words", F.lit(2)).withColumn("w1", F.lit(3))
    odd = [("\tA b\tC.a  b c;A B\x0bc\x0c\ra,b c" * 30, ""), ("x . . y", None), ("...", "en"), ("\x00 q\x01 \x00 q\x01 " * 20, "\U0001F600"), ("é É " * 15, "en")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(odd)], "doc_id long, text string, lang string"), allowMissingColumns=True)
    docs = docs.filter("doc_id < 150 or doc_id > 9000 or doc_id is null")
    want = plain_collocations(rows_of(docs.select("text", "lang")), least, best, covered)
    assert sorted(rows_of(collocations.collocations(docs, least=least, best=best, covered=covered))) == sorted(want)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_texts_are_cut_once_and_prefixes_summed_on_their_own(spark):
    docs = spark.createDataFrame([("a b a b", "en")] * 9, "text string, lang string")
    words = collocations._words(docs, "text", "lang")
    rows = collocations.windows(docs, least=1)
    for frame in (rows, words.select("lang", F.explode_outer("words"))):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1 and "size(" not in plan and "slice(" not in plan
    assert Counter(rows_of(rows)) == {("en", "a", "b", "a"): 9, ("en", "b", "a", "b"): 9, ("en", "a", "b", "."): 9, ("en", "b", ".", "."): 9}
    phrases, totals = collocations.phrase_counts(docs, least=1)
    plan = phrases._jdf.queryExecution().optimizedPlan().toString() + totals._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and rows_of(totals) == [("en", 36)]
    assert sorted(rows_of(phrases.filter("order < 3").select("order", "w1", "w2", "f")), key=str) == [(1, "a", None, 18), (1, "b", None, 18), (2, "a", "b", 18), (2, "b", "a", 9)]


def test_scores_are_exact(spark):
    counts = [(10, 20, 30), (10 ** 15, 10 ** 15, 10 ** 15 + 1), (3 * 10 ** 9 + 7, 3 * 10 ** 9 + 8, 5 * 10 ** 12 + 3), (999_999_937, 10 ** 13 + 1, 999_999_938)]
    got = rows_of(spark.createDataFrame(counts, "a long, l long, r long").select("a", "l", "r", collocations._score("a", "l", "r")))
    assert all(score == 1_000_000 * a * a // (l * r) for a, l, r, score in got)
