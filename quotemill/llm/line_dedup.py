"""Line deduplication over a whole corpus.

The lines of every text are normalised, hashed to 128 bits and exploded once with their positions; a
pre-aggregated groupBy finds the hashes that stand in several documents and the smallest id that holds
each; an equi-join tells every row which of its positions it loses; the texts are then put together
again from the other positions. Lines travel as hashes only; the texts are shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import durable, join_spread

MIN_CHARS, MIN_DOCS = 10, 2
#: A row without an id comes after all others.
NO_ID = (1 << 63) - 1


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The normalised line, or None if it is too short to be judged."""
    key = line.strip(b" \t\n\x0b\x0c\r").lower()
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and sum((c & 0xC0) != 0x80 for c in key) < min_chars:
        return None
    return key


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


#: A document is an id; rows without one are told apart by their text. A row is known by its document and the hash of its text.
DOCUMENT, ROW = ("id", "nameless"), ("id", "nameless", "text_hash")


def _named(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.when(F.col(id_col).isNull(), F.md5(text)).otherwise("").alias("nameless"),
        F.xxhash64(text).alias("text_hash"),
        text.cast("binary").alias("text"),
        *more,
    )


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(ROW, pos, high, low): place and hash of every line that is long enough to be judged."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, digests = [], [], []
            for row, text in enumerate(batch.column("text")):
                for pos, line in enumerate(text.as_py().split(b"\n")):
                    if (k := line_key(line, min_chars)) is not None:
                        rows.append(row)
                        places.append(pos)
                        digests.append(_digest(k))
            halves = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
            taken = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ROW]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(places, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], [*ROW, "pos", "high", "low"])

    return _named(docs, id_col, text_col).mapInArrow(scan, "id long, nameless string, text_hash long, pos int, high long, low long")


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(ROW, pos) of each line that its row has to lose. Rows that repeat are one row here."""
    lines = durable(hashed_lines(docs, id_col, text_col, min_chars))
    document = F.struct(*DOCUMENT)
    count = F.count_distinct(document) if min_docs > 2 else F.when(F.min(document) < F.max(document), 2).otherwise(1)
    shared = lines.groupBy("high", "low").agg(F.min(document).alias("keeper"), count.alias("n")).where(F.col("n") >= min_docs)
    lost = join_spread(lines, shared.select("high", "low", "keeper"), ["high", "low"]).where(document != F.col("keeper"))
    return lost.select(*ROW, "pos")


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every row with the lines that it keeps.

    A line is judged by its key: stripped white space, A-Z lower-cased. Keys of at least `min_chars`
    code points that stand in at least `min_docs` documents stay only in the document with the
    smallest id, where all their lines stay. Rows with the same id are one document. A null text is
    one empty line; a null id counts as the largest, and rows without an id are the same document if
    their texts are equal. Repeated lines in one document alone are kept. An empty table gives an empty
    result. Other columns of `docs` are not read.
    """
    lost = duplicate_lines(docs, id_col, text_col, min_chars, min_docs)
    per_row = lost.groupBy(*ROW).agg(F.collect_set("pos").alias("lost"))
    rows = _named(docs, id_col, text_col, F.col(id_col).cast("long").alias("doc_id"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(batch.column("text"), batch.column("lost"), strict=True):
                lines, bad = text.as_py().split(b"\n"), frozenset(gone.as_py() or ())
                texts.append(b"\n".join(x for pos, x in enumerate(lines) if pos not in bad) if bad else text.as_py())
                n_lines.append(len(lines))
                n_dropped.append(len(bad))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                ["doc_id", "text", "n_lines", "n_dropped"],
            )

    joined = rows.join(per_row, list(ROW), "left").select("doc_id", "text", "lost")
    out = joined.mapInArrow(rebuild, "doc_id long, text binary, n_lines long, n_dropped long")
    return out.withColumn("text", F.col("text").cast("string"))


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text."""
    kept = drop_duplicate_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def kept_sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


ORACLE_SQL = """
WITH lines AS (
  SELECT r, doc_id, struct_pack(id := coalesce(doc_id, 9223372036854775807), nameless := CASE WHEN doc_id IS NULL THEN md5(text) ELSE '' END) AS id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, text, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
),
shared AS (
  SELECT key, min(id) AS keeper FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT id) >= 2
),
judged AS (
  SELECT l.*, s.keeper IS NOT NULL AND l.id <> s.keeper AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key AND length(l.key) >= 10
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
