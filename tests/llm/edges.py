"""Rows that every text operator has to stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"wort{i % 977} und" for i in range(30_000))
WORDS = "the quick brown fox jumps over the lazy dog and runs to the hills with a friend of that dog "
TEXTS = [
    (1, WORDS * 4, "en", "src1"),
    (2, WORDS * 4, "en", "src1"),
    (2, WORDS * 4, "en", "src1"),
    (3, None, "de", None),
    (4, "", None, "src2"),
    (5, "  \t\n ", "de", "src2"),
    (6, "word", "fr", "odd"),
    (7, LONG, "de", "src3"),
    (None, WORDS * 5, "en", "src4"),
    (None, None, None, None),
    (8, "Größe ÉTÉ | MIT License\n\nReleased under the MIT License.\nshared line of text here", "de", "src5"),
    (9, "shared line of text here\nSHARED LINE of text here \nshort\nown line number nine", "en", "src5"),
    (10, "\n", "en", "src12345678901234567890"),
]
#: Names that the operators use themselves.
CLASHES = ["row", "words", "fingerprint", "fp", "component_id", "shard", "slot", "tokens", "copies", "rest", "passes", "item_id", "coverage", "hash", "band", "n_words", "kept", "size"] + [
    f"__{c}" for c in "row tokens rest copy copies passes domain language source id text_hash key key0 slice number bucket moved place offset gone again slot docs metrics failed kept base_failed".split()
]


def documents(spark: SparkSession, rows=TEXTS) -> DataFrame:
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema)
    return frame.selectExpr("*", *[f"'x' as {c}" for c in CLASHES])


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark).where("false")
