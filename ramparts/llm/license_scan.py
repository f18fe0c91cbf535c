"""License scan: exact containment join of license templates with blocks of text. DataFrame operations only.

Templates and phrases are token sets. A block (a window of ``BLOCK_WORDS`` words, moved by half) matches a
template if it holds at least ``threshold`` of the template's tokens, among them the words that tell the license
from its siblings; a phrase needs all of them, and then its words in a row. Tokens are ordered by their number of occurrences in all documents, rare first. The filters:

* prefix: of ``n`` template tokens ``need`` must be there, so one of the ``n - need + 1`` rarest must;
* length: a block with fewer different template tokens than ``need`` cannot match;
* position: a shared token at place ``p`` of the template's order leaves at most ``n - p`` shared tokens,
  and likewise in the block, so the first shared token must leave enough on both sides.

What passes is verified exactly. Templates are a bounded list (``MAX_TOKENS`` in all), so they travel as
literals; documents are never shuffled as texts, only their few matching blocks are.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramparts.llm.common import ascii_lower, stored, whole

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BLOCK_WORDS = 128
THRESHOLD = 0.8
MAX_TOKENS = 5000

# Fixed phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Sentences of well-known public notices: the label, the words that decide for it, and those that decide for a sibling.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
     "to deal in the software without restriction", "mit", "permission granted charge software restriction", ""),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache", "apache", ""),
    ("licensed under the apache license version 2 0", "apache", "apache", ""),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
     "published by the free software foundation", "gpl", "gnu general public", "lesser affero library"),
    ("this work is licensed under the gnu general public license version 3", "gpl", "gnu general public", "lesser affero library"),
    ("released under the mit license", "mit", "mit license", ""),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following "
     "conditions are met", "bsd", "redistribution source binary forms conditions", ""),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl", "mozilla", ""),
)
# The terms a Creative Commons attribution license may add: as the notice and as the short name writes them.
TERMS = (("noncommercial", "nc"), ("sharealike", "sa"), ("noderivatives", "nd"))


def commons_notices():
    """Notices of the attribution licenses: every choice of terms but share-alike without derivatives."""
    for chosen in ((), (0,), (1,), (2,), (0, 1), (0, 2)):
        label = "-".join(["cc-by", *(TERMS[i][1] for i in chosen)])
        for form, frame, deciding in ((0, "this work is licensed under a creative commons attribution {} 4 0 international license", "commons attribution"),
                                      (1, "licensed under cc by {} 4 0", "cc by")):
            terms = " ".join(TERMS[i][form] for i in chosen)
            yield " ".join(frame.format(terms).split()), label, f"{deciding} {terms}", " ".join(t[form] for i, t in enumerate(TERMS) if i not in chosen)


TEMPLATES = (*NOTICES, *commons_notices())


def license_words(text):
    """Lower-cased words of a text."""
    return F.filter(F.split(ascii_lower(whole(text)), SEPARATORS), lambda w: w != "")


def _words_of(sentence: str) -> list[str]:
    return sentence.split()


def token_counts(docs: DataFrame, text_col: str, tokens: list[str]) -> dict[str, int]:
    """Occurrences of the template tokens in all documents: at most one row per token comes to the driver."""
    hits = docs.select(F.explode(F.filter(license_words(text_col), lambda w: w.isin(tokens))).alias("token"))
    return {r["token"]: r["n"] for r in hits.groupBy("token").agg(F.count("*").alias("n")).collect()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES,
         threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs`` with the contract's columns; ``score`` is the best containment found.

    A template is (sentence, label) or (sentence, label, deciding words, words of siblings). It counts if a block
    holds ``threshold`` of the sentence's different words, all deciding words and none of its siblings' words, so of
    similar notices the one whose own words are there wins; siblings that share a block are told apart by what it
    holds as a whole. Blocks grow with the longest template, so whole license texts can be given. Null and empty texts have
    no words and score 0; null ids and repeated rows give a row each; an empty table gives no rows. Labels and
    phrases found in several blocks count once per place. Other columns are not read.
    """
    entries = [(_words_of(p), label, True, [], []) for p, label in phrases]
    entries += [(_words_of(t), label, False, *(_words_of(w) for w in (deciding or ("", "")))) for t, label, *deciding in templates]
    vocabulary = sorted({w for words, _, _, own, others in entries for w in (*words, *own, *others)})
    if len(vocabulary) > MAX_TOKENS:
        raise ValueError(f"at most {MAX_TOKENS} template tokens")
    half = max(block_words // 2, *(len(words) for words, *_ in entries))
    counts = token_counts(docs, text_col, vocabulary)
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    plans = []
    for n, (words, label, phrase, *_) in enumerate(entries):
        ranked = sorted({order[w] for w in words})
        need = len(ranked) if phrase else ceil(threshold * len(ranked) - 1e-9)
        plans.append((n, words, label, phrase, ranked, need))
    prefix = sorted({r for *_, ranked, need in plans for r in ranked[:len(ranked) - need + 1]})
    rare = [w for w, r in order.items() if r in set(prefix)]

    words = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), license_words(text_col).alias("words"))
                   .select("row", "doc_id", F.size("words").cast("long").alias("n_words"),
                           F.when(F.arrays_overlap("words", F.array(*map(F.lit, rare))), F.col("words")).alias("words")), "license")
    blocks = (words.filter("words IS NOT NULL")
              .select("row", "n_words", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_words") / half) - 1)),
                                                                 lambda b: F.slice("words", (b * half + 1).cast("int"), 2 * half))).alias("block", "held")))
    ranks = F.create_map(*(x for w, r in order.items() for x in (F.lit(w), F.lit(r))))
    known = F.filter("held", lambda w: w.isin(vocabulary))
    blocks = blocks.withColumn("tokens", F.sort_array(F.array_distinct(F.transform(known, lambda w: F.element_at(ranks, w))))).filter(F.size("tokens") > 0)
    # the inverted index of the templates: token -> (template, place in its order, tokens, needed)
    index: dict[int, list] = {r: [] for r in prefix}
    for n, _, _, _, ranked, need in plans:
        for place, r in enumerate(ranked[:len(ranked) - need + 1]):
            index[r].append((n, place, len(ranked), need))
    spark = docs.sparkSession
    rows = [(r, *e) for r, found in index.items() for e in found]
    lookup = F.broadcast(spark.createDataFrame(rows, "token int, template int, place int, width int, need int"))
    probes = (blocks.filter(F.arrays_overlap("tokens", F.array(*map(F.lit, prefix))))
              .select("*", F.posexplode("tokens").alias("at", "token")).join(lookup, "token")
              .filter((F.size("tokens") >= F.col("need")) & (F.col("width") - F.col("place") >= F.col("need"))
                      & (F.size("tokens") - F.col("at") >= F.col("need"))))
    ranked_of = F.array(*(F.array(*map(F.lit, ranked)) for *_, ranked, _ in plans))
    wanted = F.element_at(ranked_of, F.col("template") + 1)
    shared = F.array_intersect("tokens", wanted)

    def ranks_of(part: int):
        return F.element_at(F.array(*(F.array(*(F.lit(order[w]) for w in e[part])).cast("array<int>") for e in entries)), F.col("template") + 1)
    decided = (F.size(F.array_except(ranks_of(3), F.col("tokens"))) == 0) & ~F.arrays_overlap(ranks_of(4), F.col("tokens"))
    # a pair found through several prefix tokens is taken at the first
    pairs = (probes.filter(F.size(shared) >= F.col("need")).filter(F.element_at(shared, 1) == F.col("token")).filter(decided)
             .withColumn("score", F.size(shared) / F.col("width")))
    phrase_of = F.array(*(F.array(*map(F.lit, words)) if phrase else F.array().cast("array<string>") for _, words, _, phrase, _, _ in plans))
    label_of = F.array(*(F.lit(label) for _, _, label, *_ in plans))
    wording = F.element_at(phrase_of, F.col("template") + 1)
    starts = F.filter(F.sequence(F.lit(1), F.least(F.lit(half), F.size("held"))), lambda i: F.slice("held", i, F.size(wording)) == wording)
    pairs = (pairs.select("row", "block", "score", F.element_at(label_of, F.col("template") + 1).alias("label"), (F.size(wording) > 0).alias("base"),
                          F.when(F.size(wording) > 0, starts).alias("starts"))
             .filter("NOT base OR size(starts) > 0"))
    place = F.col("block").cast("long") * half - 1
    found = pairs.groupBy("row").agg(
        F.coalesce(F.sum(F.when(F.col("base"), F.size("starts"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(F.col("base"), place + F.element_at("starts", 1))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), place + F.element_at("starts", -1))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"))
    return words.select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
