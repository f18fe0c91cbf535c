"""License scan, repeated passages and SimHash against brute force."""

import hashlib
import re
from math import ceil

import pytest
import xxhash

from fixtures import documents, rows_of
from ramparts.llm import license_scan, simhash, suffix_dedup
from ramparts.llm.components import connected_components


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).persist()


def by_row(docs, *columns):
    return sorted(rows_of(docs.select(*columns)), key=lambda r: (r[0] is not None, r[0] or 0, str(r)))


def lower(text):
    return (text or "").encode().lower().decode()


def test_license_labels_need_their_deciding_words(spark):
    cases = {
        "licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc", "licensed under CC BY-NC-SA 4.0.": "cc-by,cc-by-nc-sa",
        "was released under the terms of a new free license": "", "Released under the BSD license.": "", "Released under the MIT License.": "mit",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "cc-by-nc-sa",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "cc-by-nd",
        "this work is licensed under the GNU Lesser General Public License version 3": "", "Licensed under the Zebra License, Version 2.0": "",
        "Licensed under the Apache License, Version 2.0": "apache",
    }
    rows = spark.createDataFrame([(n, "intro words " * 40 + text + " and more" * 30) for n, text in enumerate(cases)], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.scan(rows).collect()} == dict(enumerate(cases.values()))


def test_license_texts_longer_than_a_block(spark):
    whole = " ".join(f"clause{n} holds" if n % 9 else "and the" for n in range(400))
    near = " ".join(w for n, w in enumerate(whole.split()) if n % 10)
    rows = spark.createDataFrame([(1, "x " * 300 + whole), (2, near), (3, " ".join(whole.split()[:300])), (4, None)], "doc_id long, text string")
    got = license_scan.scan(rows, templates=((whole, "own"),)).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == {1: "own", 2: "own", 3: "", 4: ""}


def test_license_scan(docs):
    want = []
    for doc_id, text in by_row(docs, "doc_id", "text"):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places, base, labels, score = [], set(), set(), 0.0
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
            places += at
            if at:
                base.add(label)
                score = 1.0
        half = license_scan.BLOCK_WORDS // 2
        for low in range(0, max(1, len(words)), half):
            held = set(words[low:low + license_scan.BLOCK_WORDS])
            for sentence, label, own, others in license_scan.TEMPLATES:
                if set(own.split()) - held or set(others.split()) & held:
                    continue
                t = set(sentence.split())
                if len(t & held) >= ceil(license_scan.THRESHOLD * len(t) - 1e-9):
                    labels.add(label)
                    score = max(score, len(t & held) / len(t))
        want.append((doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                     ",".join(sorted(base | labels)), round(score, 9)))
    got = [(*r[:-1], round(r[-1], 9)) for r in rows_of(license_scan.scan(docs))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[2] for r in got) > 6 and any("cc-by-nc" in r[6] for r in got)


def brute_passages(rows, width):
    first = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - width + 1) if doc_id is not None else ():
            s = raw[i:i + width]
            first[s] = min(first.get(s, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1) if doc_id is not None else ():
            if first[raw[i:i + width]] < doc_id:
                gone[i:i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc_id, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("piece", [None, 3000])
def test_passages(docs, piece, monkeypatch):
    if piece:
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    want = brute_passages(by_row(docs, "doc_id", "text"), 50)
    assert sorted(rows_of(suffix_dedup.dedup_passages(docs)), key=str) == sorted(want, key=str)
    assert sum(r[2] for r in want) > 10_000


def test_passages_keep_text_and_columns(docs):
    out = suffix_dedup.dedup_passages(docs, columns=("kept_text", "begins", "ends", "n_removed"), carry=("source",))
    assert out.columns == ["doc_id", "source", "kept_text", "begins", "ends", "n_removed"]
    assert out.filter("aggregate(zip_with(begins, ends, (b, e) -> e - b), 0L, (a, x) -> a + x) != n_removed").count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(values, near):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for a in values:
        for b in values:
            if a < b and near(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_simhash(docs):
    rows = [(i, brute_fingerprint(t)) for i, t in by_row(docs, "doc_id", "text")]
    root = brute_components(sorted({f for _, f in rows}), lambda a, b: (a ^ b).bit_count() <= 3)
    low = {}
    for i, f in rows:
        if i is not None:
            low[root[f]] = min(i, low.get(root[f], i))
    got = rows_of(simhash.near_duplicates(docs).selectExpr("id", "fp", "component_id"))
    assert sorted(((i, f & (1 << 64) - 1, c) for i, f, c in got), key=str) == sorted(((i, f, low.get(root[f])) for i, f in rows), key=str)


@pytest.mark.parametrize("bucket", [4096, 8])
def test_near_fingerprints(spark, bucket):
    """Dense groups, with buckets split into chunks as well."""
    import random
    rng = random.Random(5)
    values = set()
    for centre in [rng.getrandbits(64) for _ in range(6)]:
        for _ in range(70):
            v = centre
            for _ in range(rng.randrange(5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values |= {rng.getrandbits(64) for _ in range(60)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long"), bucket=bucket)
    got = {n: r for n, r in rows_of(connected_components(links, "a", "b"))}
    want = brute_components(sorted(signed), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert {v: got.get(v, v) for v in signed} == want
    assert links.count() < 10 * len(values)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 5), (7, 7), (None, 1), (200, 3)]
    got = dict(rows_of(connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")))
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 5: 3, 200: 3}


def test_empty(spark, docs):
    none = docs.limit(0)
    for df in (license_scan.scan(none), suffix_dedup.dedup_passages(none), simhash.near_duplicates(none)):
        assert df.count() == 0
