"""SimHash near-duplicates with a pivot distance table.

Steps, all distributed:

1. fingerprint every whole text (64 bits, majority of the shingles' XXH64 bits);
2. keep one row per distinct fingerprint, so that exact copies cost nothing further;
3. deal the distinct fingerprints into buckets by an equi-join key that cannot lose a link: the 64
   bits form 6 blocks, 3 differing bits touch at most 3 of them, so two linked fingerprints agree
   on some 3 whole blocks (20 keys of about 32 bits each);
4. inside a bucket, look the fingerprints up in the pivot table (their Hamming distances to
   reference fingerprints), discard every pair with a coordinate that differs by more than the
   threshold (triangle inequality), and verify the survivors by counting the differing bits;
5. contract the links into components.

The pivot table alone has no equality to join on, so step 3 bounds which pairs are looked up. A
bucket with more than `chunk` fingerprints is dealt over pairs of chunks and every task sends back
only a spanning forest of its rows, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import durable, join_spread, whole_runs
from quotemill.llm.components import connected_components

SHINGLE, SEED, THRESHOLD = 3, 42, 3
PIVOTS, PIVOT_SEED = 24, 20240229
BLOCKS, SHARED_BLOCKS, CHUNK = 6, 3, 512


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text; 0 if it has no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        flat = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(flat[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64
        )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long. A null text counts as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(scan, "doc_id long, fp long")


def _masks() -> list[int]:
    """Bit masks of every choice of SHARED_BLOCKS out of BLOCKS, as signed longs."""
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(blocks, SHARED_BLOCKS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _pivots(count: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(PIVOT_SEED).integers(0, 1 << 64, count, np.uint64, endpoint=False)


def pivot_links(prints: np.ndarray, groups: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (child, root) that connect, inside each run of equal `groups`, what is linked.

    prints: uint64; groups: run numbers in ascending order.
    """
    n = len(prints)
    table = np.bitwise_count(prints[:, None] ^ _pivots()[None, :]).astype(np.int8)
    ends = np.searchsorted(groups, groups, side="right")
    left, right = [], []
    active = np.arange(n)
    for lag in range(1, n):
        active = active[active + lag < ends[active]]
        if not len(active):
            break
        other = active + lag
        near = np.abs(table[active] - table[other]).max(axis=1) <= threshold
        a, b = active[near], other[near]
        true = np.bitwise_count(prints[a] ^ prints[b]) <= threshold
        left.append(a[true])
        right.append(b[true])
    if not left:
        return np.array([], np.int64), np.array([], np.int64)
    a, b, roots = np.concatenate(left), np.concatenate(right), np.arange(n)
    while True:
        least = np.minimum(roots[a], roots[b])
        before = roots.copy()
        np.minimum.at(roots, a, least)
        np.minimum.at(roots, b, least)
        roots = roots[roots]
        if np.array_equal(before, roots):
            break
    child = np.flatnonzero(roots != np.arange(n))
    return child, roots[child]


def _scan_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (band, key, part) -> the links of each run."""
    for rows, run in whole_runs(batches, ["band", "key", "part"]):
        signed = rows.column("fp").to_numpy().astype(np.int64)
        child, root = pivot_links(signed.view(np.uint64), run)
        yield pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[root])], ["u", "v"])


def fingerprint_links(prints: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Distinct `fp` rows -> (u, v) edges that connect all fingerprints within the threshold."""
    band = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks()]))
    keys = prints.select("fp", band.alias("band", "key"))
    crowd = keys.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    parts = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda t: t != F.col("own")),
            lambda t: F.least(F.col("own"), t) * F.col("chunks") + F.greatest(F.col("own"), t),
        )
    )
    dealt = (
        join_spread(keys, crowd, ["band", "key"])
        .withColumn("chunks", chunks)
        .withColumn("own", own)
        .select("band", "key", F.explode(parts.cast("array<int>")).alias("part"), "fp")
    )
    dealt = dealt.repartition("band", "key", "part").sortWithinPartitions("band", "key", "part")
    return dealt.mapInArrow(_scan_buckets, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs`.

    component_id is the smallest id reachable over links of at most 3 differing bits, the row's own
    included. A null or wordless text has fingerprint zero and links like any other. Repeated rows
    stay repeated. A null id is never the smallest; component_id is null only if every id in the
    component is. Ties don't arise: the smallest id is unique. An empty table gives an empty result.
    Other columns of `docs` are not read.
    """
    prints = durable(with_fingerprints(docs, id_col, text_col))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = connected_components(fingerprint_links(distinct.select("fp")))
    member = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("component", "fp")
    )
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    label = join_spread(member, least, ["root"]).select("fp", "component_id")
    return prints.join(label, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_duplicates(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """Keep one document of each group: the row whose doc_id is the component's smallest.

    find: gives doc_id and component_id of each row.
    Rows that repeat a doc_id are one document, of which one row stays. Rows without a doc_id can't
    be named and stay. All columns of `docs` are returned.
    """
    found = find(docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.take(1):
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
