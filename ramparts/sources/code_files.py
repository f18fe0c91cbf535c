"""Code file source: a folder tree, or any table with a path and a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ramparts import rules
from ramparts.functions.text import utf16_at_most


def classify_unit(rel: Column) -> Column:
    """The logical unit a path belongs to; the first rule that matches decides."""
    unit = None
    for name, words in rules.UNITS:
        test = rel.rlike(f"(?i){words}")
        unit = F.when(test, name) if unit is None else unit.when(test, name)
    return unit.otherwise(rules.DEFAULT_UNIT)


def is_code_path(rel: Column) -> Column:
    """A scanned extension and no skipped or hidden directory above the file."""
    folders = F.slice(F.split(rel, "/"), 1, F.size(F.split(rel, "/")) - 1)
    skipped = F.exists(folders, lambda d: d.isin(rules.SKIPPED_DIRECTORIES) | d.startswith("."))
    return rel.rlike(rf"[^/]\.(?:{'|'.join(rules.CODE_EXTENSIONS)})\z") & ~skipped


def code_files(files: DataFrame, rel: str = "rel", code: str = "code", max_chars: int | None = None) -> DataFrame:
    """Keep scanned paths and add their unit; all other columns stay, and files of any size.

    With ``max_chars`` a column ``oversize`` marks the files above it, for callers that treat them apart.
    """
    kept = files.filter(is_code_path(F.col(rel))).withColumn("unit", classify_unit(F.col(rel)))
    return kept if max_chars is None else kept.withColumn("oversize", ~utf16_at_most(F.col(code), max_chars))


def _relative(path: Column, root: str) -> Column:
    # file paths are percent-encoded, a plus stands for itself
    plain = F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^file:/*", "/")
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(plain, F.lit(base)), F.substring(plain, len(base) + 1, 1 << 30)).otherwise(plain)


def read_tree(spark: SparkSession, root: str, repo: str = "repo") -> DataFrame:
    """Read a folder tree as one row per file.

    Unreadable files are skipped; ``quarantined_files`` names them. Path filters run on file metadata, so
    skipped files are never opened.
    """
    raw = (spark.read.option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
           .option("ignoreCorruptFiles", True).option("wholetext", True).text(root))
    return code_files(raw.select(F.lit(repo).alias("repo"), _relative(F.col("_metadata.file_path"), root).alias("rel"), F.col("value").alias("code")))


def quarantined_files(spark: SparkSession, root: str, tree: DataFrame) -> DataFrame:
    """(rel, reason) of the files of a folder tree that ``tree``, the rows read from it, does not hold whole.

    The listing asks for names only, so no file is opened a second time for it. ``unreadable`` files are listed
    but have no row; ``undecodable`` ones have bytes that are no UTF-8.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    wanted = listed.select(_relative(F.col("path"), root).alias("rel")).filter(is_code_path(F.col("rel")))
    missing = wanted.join(tree.select("rel"), "rel", "left_anti").select("rel", F.lit("unreadable").alias("reason"))
    return missing.unionByName(tree.filter(~F.is_valid_utf8("code")).select("rel", F.lit("undecodable").alias("reason")))
