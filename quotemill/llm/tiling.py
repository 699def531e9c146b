"""Benchmark decontamination by greedy string tiling.

Rolling (Karp-Rabin) hashes of five words are computed for all benchmark items and all documents; a
Spark join on the hash gives the shared seeds. A tile of t words holds t - 4 seeds, t / 5 at least, so a
document that covers 80 % of an item of L words meets h = 0.16 L of the item's seeds at least, rounded up.
It still meets one if the h - 1 seeds that most documents have are left out, so only the others make a pair
of document and item; all seeds are then joined for these pairs alone. Seeds on one diagonal that follow each other form a
match; for every pair of document and item the longest match of unmarked words is marked again and
again until none of five words is left. The tiles may stand in any order, so reordered passages are
found too. An item whose words are covered up to the threshold contaminates the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.llm.common import durable, whole_runs

SEED_WORDS, THRESHOLD = 5, 0.8
#: Hashes of the benchmark are sent to all tasks up to this many (16 MB); beyond it, a join alone filters.
MAX_SENT_SEEDS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = bytes(32 if b < 128 and not chr(b).isalnum() else (b + 32 if 65 <= b <= 90 else b) for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of ASCII letters, digits and all other characters beyond ASCII."""
    return (text or b"").translate(_TABLE).split()


def rolling_hashes(words: list[bytes], known: dict[bytes, int], size: int = SEED_WORDS) -> np.ndarray:
    """Signed 64-bit Karp-Rabin hashes of all runs of `size` words, of all words if there are fewer. known: word hashes so far."""
    size = min(size, len(words))
    if not size:
        return np.array([], np.int64)
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, 1)
    h = np.array([known[w] for w in words], np.uint64)
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _BASE + h[k : k + n]
    if size < SEED_WORDS:
        out = out * _BASE + np.uint64(size)
    return out.view(np.int64)


def greedy_tiles(doc: np.ndarray, item: np.ndarray, size: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Tiles (document word, item word, length) from the seeds (doc[i], item[i]).

    Longest first; ties go to the earlier document word, then the earlier item word.
    """
    pairs = np.unique(np.stack([doc, item], axis=1).astype(np.int64), axis=0)
    tiles: list[tuple[int, int, int]] = []
    while len(pairs):
        d, i = pairs[:, 0], pairs[:, 1]
        order = np.lexsort((d, d - i))
        d, i = d[order], i[order]
        starts = np.flatnonzero(np.r_[True, (np.diff(d - i) != 0) | (np.diff(d) != 1)])
        lengths = np.diff(np.r_[starts, len(d)])
        best = starts[np.lexsort((i[starts], d[starts], -lengths))[0]]
        length = int(lengths[np.searchsorted(starts, best)]) + size - 1
        tile = (int(d[best]), int(i[best]), length)
        tiles.append(tile)
        free = ((d + size <= tile[0]) | (d >= tile[0] + length)) & ((i + size <= tile[1]) | (i >= tile[1] + length))
        pairs = np.stack([d[free], i[free]], axis=1)
    return tiles


def _seed_rows(frame: DataFrame, keys: list[str], sent=None) -> DataFrame:
    """keys + (pos, hash, n_words) of each seed; frame: the keys and `body` (bytes). sent: broadcast hashes."""
    schema = ", ".join(f"{k} long" for k in keys) + ", pos int, hash long, n_words int"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value if sent is not None else None
        known: dict[bytes, int] = {}
        for batch in batches:
            at, pos, hashes, sizes = [np.array([], np.int64)], [np.array([], np.int64)], [np.array([], np.int64)], []
            counts = []
            for row, text in enumerate(batch.column("body")):
                words = words_of(text.as_py())
                if len(known) > 200_000:
                    known.clear()
                found = rolling_hashes(words, known)
                where = np.arange(len(found))
                if wanted is not None and len(found):
                    slot = np.minimum(np.searchsorted(wanted, found), max(len(wanted) - 1, 0))
                    where = np.flatnonzero(wanted[slot] == found) if len(wanted) else where[:0]
                if len(where):
                    at.append(np.full(len(where), row))
                    pos.append(where)
                    hashes.append(found[where])
                    sizes.append(np.full(len(where), len(words)))
                    counts.append(len(where))
            rows = pa.array(np.concatenate(at))
            columns = [batch.column(k).take(rows) for k in keys]
            n_words = np.concatenate(sizes) if sizes else np.array([], np.int64)
            columns += [pa.array(np.concatenate(pos), pa.int32()), pa.array(np.concatenate(hashes)), pa.array(n_words, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "pos", "hash", "n_words"])

    return frame.mapInArrow(scan, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, max_sent: int = MAX_SENT_SEEDS) -> DataFrame:
    """(doc_id, text_hash, item_id, coverage, n_tiles, longest) for each contaminated pair.

    docs: doc_id, text; benchmark: item_id, text. Null and wordless texts never match. An item of
    fewer than five words is met only by a document of just these words. Items with a null id can't be
    named and are left out; documents with a null id are reported with it. Repeated rows (same id and
    text) count once; texts that share an id are judged one by one. Ties between tiles go to the earlier
    word; of seeds that equally many documents have, the later ones are left out. An empty table on
    either side gives an empty result. Other columns aren't read.
    """
    context = docs.sparkSession.sparkContext
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("binary").alias("body"))
    seeds = _seed_rows(items, ["item"]).withColumnsRenamed({"pos": "item_pos", "n_words": "item_words"}).distinct()
    few = seeds.select("hash").distinct().limit(max_sent + 1)
    sent = None
    if few.count() <= max_sent:
        sent = context.broadcast(np.sort(np.array([r[0] for r in few.toLocalIterator()], np.int64)))
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(body).alias("text_hash"), body.cast("binary").alias("body"))
    found = _seed_rows(rows, ["doc", "text_hash"], sent).select(F.col("doc").isNull().alias("no_id"), F.coalesce("doc", F.lit(0)).alias("doc"), "text_hash", "pos", "hash")
    whole = ["no_id", "doc", "text_hash"]
    if sent is None:
        found = found.join(seeds.select("hash").distinct(), "hash", "left_semi")
    found = durable(found)
    busy = found.groupBy("hash").agg(F.count("*").alias("n"))
    seeds = durable(seeds.join(busy, "hash"))
    spare = F.ceil(F.col("item_words") * (threshold / SEED_WORDS) - 1e-9) - 1
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("n"), F.desc("item_pos")))  # an item is a row
    rare = seeds.withColumn("place", place).where(F.col("place") > spare).select("hash", "item").distinct()
    pairs = found.select(*whole, "hash").distinct().join(rare, "hash").select(*whole, "item").distinct()
    hits = found.join(pairs, whole).join(seeds.select("item", "hash", "item_pos", "item_words"), ["item", "hash"])
    dealt = hits.select(*whole, "item", "pos", "item_pos", "item_words")
    keys = ["no_id", "doc", "text_hash", "item"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, run in whole_runs(batches, keys):
            starts = np.flatnonzero(np.r_[True, np.diff(run) != 0])
            ends = np.r_[starts[1:], len(run)]
            pos, item_pos = table.column("pos").to_numpy(), table.column("item_pos").to_numpy()
            total = table.column("item_words").to_numpy()[starts]
            cover, tiles, longest = [], [], []
            for a, b, n in zip(starts, ends, total, strict=True):
                found = greedy_tiles(pos[a:b], item_pos[a:b], min(SEED_WORDS, int(n)))
                cover.append(sum(t[2] for t in found) / n)
                tiles.append(len(found))
                longest.append(max(t[2] for t in found))
            head = table.take(pa.array(starts)).combine_chunks()
            columns = [head.column(k).combine_chunks() for k in keys]
            columns += [pa.array(cover, pa.float64()), pa.array(tiles, pa.int32()), pa.array(longest, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "coverage", "n_tiles", "longest"])

    schema = "no_id boolean, doc long, text_hash long, item long, coverage double, n_tiles int, longest int"
    judged = dealt.mapInArrow(tile, schema).where(F.col("coverage") >= threshold)
    doc_id = F.when(~F.col("no_id"), F.col("doc")).alias("doc_id")
    return judged.select(doc_id, "text_hash", F.col("item").alias("item_id"), "coverage", "n_tiles", "longest")


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(docs, benchmark).drop("text_hash")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that no benchmark item contaminates, with all their columns."""
    gone = find_leaks(docs, benchmark, threshold).select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__gone_text")).distinct()
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]) & (text_hash == gone["__gone_text"]), "left_anti")


def brute_force_words(text: str | None) -> list[str]:
    """The word rule again, by a pattern; for tests."""
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
