"""Phrase collocations per language: counts of words, pairs and triples, cohesion scores, best phrases.

Method: top-order marginalisation. Every word occurrence starts one window of the longest size, made of
the word and its lead columns (the next words of its piece, padded where the piece ends). Only these
windows are counted. Sums over successively shorter prefixes of the windows give the rest: dropping
the last column turns counts of triples into counts of pairs, since every pair occurrence starts exactly
one padded triple, and so on down to words and the language's total. No n-gram of another order is ever
generated from the texts.

Words that cannot reach the least count are first replaced by one mark, by a table of hashed word counts
of fixed size; this changes no result, as a phrase occurs no more often than its words. Windows are counted
before anything is summed, so the sums work on distinct windows; both steps add up inside tasks first, so a pair that stands everywhere is one row per task. Words that stand in many
phrases meet in equi-joins over phrases that reach the least count, which adaptive execution splits.

Defined results: a null text counts as empty and has no words, as has a text of separators only; texts of
any length are read whole, inside the row; repeated rows count again; a null language is ``und``; ties of
score and count go by the phrase; an empty table gives no rows; other columns are ignored. Scores are
exact whole numbers: products are decimals of 38 digits, enough for counts up to 10^15.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ramparts.llm.common import ascii_lower, stored, whole

SEPARATORS = ".,;:!?\n\x0b\x0c\r"
PAD, RARE = ".", ","  # no word holds a separator
LONGEST = 3
LEAST, BEST, COVERED = 10, 2000, 50
SCALE = 1_000_000
BUCKETS = 1 << 22  # bytes broadcast to sort out rare words early
ORDERS = [f"w{i}" for i in range(1, LONGEST + 1)]


def _words(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, words) per text; separators stand between the words as words of their own, blanks are gone, capitals are kept."""
    flat = F.regexp_replace(whole(text_col), f"[{SEPARATORS}]", f" {PAD} ")
    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.split(flat, "[ \t]+").alias("words"))


def _lower(word: Column) -> Column:
    """A-Z lower-cased, word by word: ``translate`` looks up every character, ``lower`` does the same on ASCII only."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(ascii_lower(word))


def _bucket(word: str) -> Column:
    return F.pmod(F.xxhash64("lang", word), F.lit(BUCKETS))


def frequent_buckets(words: DataFrame, least: int) -> DataFrame:
    """One row with a byte per bucket of (language, word) hashes: 1 where the words of a bucket have ``least`` occurrences together.

    The size is fixed, whatever the vocabulary: a rare word that shares a bucket is merely not sorted out early.
    """
    # the outer form does not test the array in a filter of its own, which would cut the text again
    each = words.select("lang", F.explode_outer("words").alias("word")).filter(~F.col("word").isin("", PAD)).select("lang", _lower(F.col("word")).alias("word"))
    full = each.groupBy((_bucket("word") + 1).alias("bucket")).count().filter(F.col("count") >= least)
    maps = full.groupBy(F.bitmap_bucket_number("bucket").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bucket")).alias("bits"))
    flags = np.zeros(BUCKETS, np.uint8)
    for part, bits in maps.collect():  # at most BUCKETS / 32768 rows
        flags[(part - 1) * 32768:part * 32768] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[:BUCKETS - (part - 1) * 32768]
    return stored(words.sparkSession.createDataFrame([(bytearray(flags.tobytes()),)], "flags binary"), "flags")


def windows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> DataFrame:
    """(lang, w1, w2, w3) per word occurrence: the word and its lead columns, padded at the end of its piece.

    A word that has less than ``least`` occurrences for sure is in no phrase that counts, so it is written as
    ``RARE`` and ends the window; most windows then agree with others before they are counted.
    """
    words = _words(docs, text_col, lang_col)
    frequent = frequent_buckets(words, least).scalar()
    rows = words.select("lang", "words", F.posexplode_outer("words").alias("at", "w1")).filter(~F.col("w1").isin("", PAD))
    # lead columns are read from the text's array at the places behind the word, so no word is moved
    rows = rows.select("lang", *[_lower(F.get("words", F.col("at") + i)).alias(w) for i, w in enumerate(ORDERS)])

    def kept(word: str) -> Column:
        known = F.substring(frequent, (_bucket(word) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")
        return F.when(F.col(word).isNull() | F.col(word).isin("", PAD), F.lit(PAD)).when(known, F.col(word)).otherwise(F.lit(RARE))
    rows = rows.select("lang", *[kept(w).alias(w) for w in ORDERS])
    ended = F.lit(False)
    shown = [F.col("lang"), F.col("w1")]
    for shorter, longer in zip(ORDERS, ORDERS[1:]):
        ended = ended | F.col(shorter).isin(PAD, RARE)
        shown.append(F.when(ended, F.lit(PAD)).otherwise(F.col(longer)).alias(longer))
    return rows.select(*shown)


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Counts of all phrases of 1 to 3 words with at least ``least`` occurrences, and the words per language."""
    # one key column of joined words: half the bytes of three in the shuffle
    counted = windows(docs, text_col, lang_col, least).groupBy("lang", F.concat_ws(" ", *ORDERS).alias("window")).agg(F.count("*").alias("c"))
    # written, as several readers would otherwise all read the texts; this also frees the shuffled windows
    cut = stored(counted, "windows", "zstd")

    def phrases(rows: DataFrame, key: str, order: int) -> DataFrame:
        parts = [F.split_part(key, F.lit(" "), F.lit(i)) if i <= order else F.lit(None).cast("string") for i in range(1, LONGEST + 1)]
        # a padded prefix is a shorter phrase that its own order counts
        return rows.filter(F.col("f") >= least).select("lang", F.lit(order).alias("order"), *[p.alias(w) for p, w in zip(parts, ORDERS)], "f").filter(
            ~F.col(ORDERS[order - 1]).isin(PAD, RARE))
    rows = phrases(cut.withColumnRenamed("c", "f"), "window", LONGEST)  # the top order is counted already
    for order in range(LONGEST - 1, 1, -1):
        rows = rows.unionByName(phrases(cut.groupBy("lang", F.substring_index("window", " ", order).alias("prefix")).agg(F.sum("c").alias("f")), "prefix", order))
    words = stored(cut.groupBy("lang", F.substring_index("window", " ", 1).alias("prefix")).agg(F.sum("c").alias("f")), "words")
    rows = stored(rows.unionByName(phrases(words, "prefix", 1)), "phrases")
    return rows, words.groupBy("lang").agg(F.sum("f").alias("n"))


def _of_order(phrases: DataFrame, order: int, names: list[str], count: str) -> DataFrame:
    return phrases.filter(F.col("order") == order).select("lang", *[F.col(w).alias(n) for w, n in zip(ORDERS, names)], F.col("f").alias(count))


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)) without rounding on the way."""
    return F.expr(f"CAST((CAST({a} AS DECIMAL(16,0)) * CAST({a} AS DECIMAL(16,0)) * {SCALE}BD) div "
                  f"(CAST({left} AS DECIMAL(16,0)) * CAST({right} AS DECIMAL(16,0))) AS BIGINT)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, best: int = BEST, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` phrases of 2 and 3 words of every language.

    A phrase counts if it occurs ``least`` times; its score is that of its worst cut. It is dropped if it
    stands inside a longer counted phrase with ``covered`` percent of its occurrences or more.
    """
    phrases, totals = phrase_counts(docs, text_col, lang_col, least)
    w1, w2, w3 = ORDERS
    triples = _of_order(phrases, 3, ORDERS, "a")
    pairs = _of_order(phrases, 2, ORDERS, "a")

    def word(name: str, count: str) -> DataFrame:
        return _of_order(phrases, 1, [name], count)
    longer = triples.select("lang", w1, w2, F.col("a").alias("in_longer")).unionByName(
        triples.select("lang", F.col(w2).alias(w1), F.col(w3).alias(w2), F.col("a").alias("in_longer"))).groupBy("lang", w1, w2).agg(F.max("in_longer").alias("in_longer"))
    open_pairs = pairs.join(longer, ["lang", w1, w2], "left").filter(F.expr(f"in_longer IS NULL OR 100 * in_longer < {covered} * a"))
    of_two = (open_pairs.join(word(w1, "l"), ["lang", w1]).join(word(w2, "r"), ["lang", w2])
              .select("lang", F.concat_ws(" ", w1, w2).alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score")))
    cut = (triples.join(word(w1, "l1"), ["lang", w1]).join(_of_order(phrases, 2, [w2, w3], "r1"), ["lang", w2, w3])
           .join(_of_order(phrases, 2, [w1, w2], "l2"), ["lang", w1, w2]).join(word(w3, "r2"), ["lang", w3]))
    worst = F.least(*[F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)])
    of_three = cut.select("lang", F.concat_ws(" ", *ORDERS).alias("phrase"), "a", worst.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = of_two.unionByName(of_three).withColumn("rank", F.row_number().over(place).cast("long")).filter(F.col("rank") <= best)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
