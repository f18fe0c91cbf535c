"""Embedding links and benchmark leaks against brute force."""

from collections import Counter

import numpy as np
import pytest

from fixtures import documents, rows_of
from ramparts.llm import decontaminate, embed_dedup


def brute_links(rows, cosine=0.93):
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        a = np.array(v, np.float64) / np.abs(v).max() if ok else None
        unit.append(a / np.linalg.norm(a) if ok else None)
    links = set()
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links |= {(i, j), (j, i)}
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in links:
        a, b = sorted((find(i), find(j)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
        root[b] = a
    return [(rows[i][0], sum(1 for a, _ in links if a == i), rows[find(i)][0]) for i in range(len(rows))]


def vectors(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(12):
            centre = rng.normal(size=24)
            for _ in range(int(rng.integers(1, 12))):
                v = centre + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.28])
                rows.append((n, [float(x) for x in v], label))
                n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 2, None, 0), (n + 3, [0.0] * 24, 0), (n + 4, [None] + rows[0][1][1:], 0),
             (n + 5, [float("nan")] + rows[0][1][1:], 0), (n + 6, [float("inf")] * 24, 1), (n + 7, rows[0][1], None), (n + 8, [], 1), (n + 9, rows[0][1][:5], 0),
             (None, rows[0][1], 0), (n + 10, [x * 1e300 for x in rows[0][1]], 0), (n + 11, [x * 1e-300 for x in rows[0][1]], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS key", "2 AS cell", "3 AS kept"), rows


@pytest.mark.parametrize("chunk", [1024, 16])
def test_embeddings(spark, chunk):
    df, rows = vectors(spark)
    got = rows_of(embed_dedup.near_vectors(df, chunk=chunk))
    want = [(i, n, c, i is not None and i == c) for i, n, c in brute_links(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_embedding_recall(spark):
    """Pairs just above the limit, among all vectors of the given table."""
    rng = np.random.default_rng(8)
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], r["label"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    for i in range(len(rows)):
        unit = np.array(rows[i][1]) / np.linalg.norm(rows[i][1])
        side = rng.normal(size=len(unit))
        side -= side @ unit * unit
        cosine = 0.93 + 0.01 * rng.random()
        rows.append((10_000 + i, (cosine * unit + np.sqrt(1 - cosine * cosine) * side / np.linalg.norm(side)).tolist(), rows[i][2]))
    got = {r[0]: r[1] for r in rows_of(embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))}
    want = brute_links(rows)
    total = sum(n for _, n, _ in want)
    assert sum(got.values()) >= 0.98 * total and total >= len(rows)
    assert all(got[i] <= n for i, n, _ in want)


def subsequence(a, b):
    """Length of the longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
    return row[-1]


def test_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = ([chr(97 + c) for c in rng.integers(0, 6, n)] for n in rng.integers(1, 90, 2))
        assert decontaminate.common_subsequence(decontaminate.places_of(a), len(a), b) == subsequence(a, b)


def test_words():
    text = "".join(map(chr, range(128))) + "Ab_1 c\x1cd-e"
    assert decontaminate.words_of(text) == decontaminate._WORD.findall(text.lower())
    assert decontaminate.words_of("Ünï \u2003 x") == ["ünï", "x"] and decontaminate.words_of(None) == []


def test_leaks(spark):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = rows_of(bench.select("item_id", "text").orderBy("item_id"))
    docs = documents(spark).select("doc_id", "text", "source")
    filler = [t for (t,) in rows_of(docs.filter("length(text) > 3000").select("text").orderBy("doc_id", "text").limit(2))]
    half = items[1][1].split()
    planted = [(7000, filler[0] + " " + items[0][1] + " " + filler[1]), (7001, items[1][1].upper()),
               (7002, filler[0] + " " + " ".join(w for i, w in enumerate(half) if i % 6 != 3) + " " + filler[1]), (7003, filler[1])]
    docs = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"), allowMissingColumns=True).repartition(4)
    bench = bench.unionByName(spark.createDataFrame([(None, "words without an id stand here"), (900, None), (901, ""), (902, "two words")], "item_id long, text string"))
    got = rows_of(decontaminate.find_leaks(docs, bench).select("doc_id", "text", "leaked_items"))
    pieces = [(i, p) for i, t in items for p in decontaminate.pieces_of(t)]
    for doc_id, text, leaked in got:
        words, want = decontaminate.words_of(text), set()
        for low in range(0, max(1, len(words)), 64):
            window = words[low:low + 128]
            for i, p in pieces:
                share, close = subsequence(p, window) / len(p), p[-6:]
                if share >= 0.65 or share >= 0.5 and subsequence(close, window) >= 0.5 * len(close):
                    want.add(i)
        assert set(leaked) == want, doc_id
    by_id = {r[0]: r[2] for r in got}
    assert by_id[7000] == [items[0][0]] and by_id[7001] == [items[1][0]] and by_id[7002] == [items[1][0]] and by_id[7003] == []
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).filter("contaminated").count() == 0


def brute_leaks(texts, items, chosen=None):
    """Items of each (chosen) text by comparing every span of every window with every piece; document frequencies are of ``texts``."""
    texts = [decontaminate.words_of(t) for t in texts]
    counts = Counter(w for words in texts for w in set(words))
    heavy = {w for w in {w for _, t in items for w in decontaminate.words_of(t)} if np.log((len(texts) + 1) / (counts[w] + 1)) >= 1}
    pieces = [(i, *([p, q, c]), *map(decontaminate.places_of, (p, q, c))) for i, t in items for p in decontaminate.pieces_of(t)
              for q in [[w for w in p if w in heavy] or p] for c in [[w for w in p[-6:] if w in heavy] or p[-6:]]]
    common, out = decontaminate.common_subsequence, []
    for words in texts if chosen is None else texts[chosen]:
        want = set()
        for window in (words[low:low + 128] for low in range(0, max(1, len(words)), 64)):
            for i, p, q, c, whole, weighted, close in pieces:
                if i in want or common(whole, len(p), window) < 0.5 * len(p):
                    continue
                size = int(np.ceil(1.5 * len(p)))
                for part in (window[k:k + size] for k in range(len(window))):
                    share = min(common(whole, len(p), part) / len(p), common(weighted, len(q), part) / len(q))
                    if share >= 0.65 or share >= 0.5 and common(close, len(c), part) >= 0.5 * len(c):
                        want.add(i)
                        break
        out.append(want)
    return out


def many_items(n, rng):
    """``n`` items of 12 to 40 words and, for each, a text of 300 words that holds it; 20 words stand in all texts."""
    vocabulary = [f"w{k}" for k in range(6000)]
    weight = 1 / np.arange(1, 6001)
    common = [f"c{k}" for k in range(20)]

    def words(size):
        return [common[rng.integers(20)] if rng.random() < 0.4 else w for w in rng.choice(vocabulary, size, p=weight / weight.sum())]
    items = [words(rng.integers(12, 40)) for _ in range(n)] + [[common[k] for k in rng.permutation(20)]]
    texts = []
    for item in items:
        filler = words(300) + common
        texts.append(" ".join(filler[:150] + item + filler[150:]))
    return [(k, " ".join(item)) for k, item in enumerate(items)], texts


def test_leaks_of_many_items(spark):
    """A crowded latent space loses verbatim items and those of common words only; none may be lost."""
    items, texts = many_items(1500, np.random.default_rng(5))
    texts = texts[-300:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = dict(rows_of(decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "leaked_items")))
    assert all(1201 + k in got[k] for k in range(300))
    for k, want in enumerate(brute_leaks(texts, items, slice(280, 300))):
        assert set(got[280 + k]) == want


def test_clean_documents_stay(spark):
    """Scattered words of an item are no leak, and neither are its stop words close together; a close copy with some words changed is one."""
    item = "of ravel is mistor the quanter was blenk that of glimmer is the was that of"
    stops, rng = ["of", "is", "the", "was", "that"], np.random.default_rng(3)
    fill = [" ".join(stops + [f"x{k}" for k in rng.integers(0, 900, 200)]) for _ in range(40)]
    wide = " ".join(w + " " + " ".join(f"x{k}" for k in rng.integers(0, 900, 6)) for w in item.split())
    texts = fill + [f"{fill[0]} {wide} {fill[1]}", f"{fill[0]} of one is two the three was four that of five is the was that of {fill[1]}",
                    f"{fill[0]} of ravel is mistor the new quanter was other that of glimmer is the was that of {fill[1]}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(rows_of(decontaminate.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).select("doc_id", "leaked_items")))
    assert got[40] == [] and got[41] == [] and got[42] == [1]
    assert [set(got[k]) for k in range(43)] == brute_leaks(texts, [(1, item)])
