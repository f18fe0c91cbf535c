"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import duckdb

SF = "/root/testdata/sf0.001"


def documents(spark):
    """The smallest documents table plus awkward rows, with columns whose names clash with results."""
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    con = duckdb.connect()
    text = con.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE length(text) > 900 ORDER BY doc_id LIMIT 3").fetchall()
    long = (text[0][0] + " ") * 40
    rows = [
        (9001, None, "en", None), (9002, "", None, "src0"), (9003, " \t\n", "en", "src0"), (9004, text[0][0], "en", "src0"), (9005, text[0][0], "en", "src0"),
        (9006, text[1][0] + " Extra words at the end.", "en", ""), (9007, "one", "en", "src1"), (9008, "ONE", "en", "src1"), (9009, "one two", "en", "src1"),
        (9010, long, "en", "zz"), (9011, long + text[2][0], "en", "zz"), (9012, "a" * 400, "en", "zz"), (9013, "a" * 120 + "b" + "a" * 300, "en", "zz"),
        (9014, "Released under the MIT License. CC BY-NC 4.0 and the Apache  License; GNU\nGeneral Public License", "en", "zz"),
        (9015, "Kelvin GNU gİ " + "x " * 300 + "gnu general public license gnu general public license", "en", "\U0001F600"),
        (9016, text[0][0][:200] + "é" + text[0][0][200:], "en", "￿"), (9005, text[0][0], "en", "src0"), (None, text[0][0], "en", "src0"), (None, None, None, None),
    ]
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return base.unionByName(extra).selectExpr("*", "1 AS score", "'x' AS target", "2 AS size", "3 AS id", "4 AS fp", "5 AS digit", "6 AS words", "7 AS predicted").repartition(5)


def rows_of(df):
    return [tuple(r) for r in df.collect()]
