"""Maximal periodic runs of words, found tile by tile and stitched in Spark.

Periods are dealt into octaves [P, 2P). For an octave a document is cut into tiles that overlap by four of
its scales, so that every two periods of a run lie in one tile. A tile is solved alone: the places where a
word equals the word one period on form a stretch of at least one period, which meets a multiple of P, and
from that boundary two Z-functions give how far it reaches either way. What a tile finds are fragments; they are
shuffled by document and period, and fragments that overlap by a period are one run.

A document that one tile holds is solved where it is read; only its fragments, if it has any, go on. The
tiles of longer documents are dealt to all tasks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.llm.common import durable, join_spread

#: Words of a run at least; it also holds two periods at least.
MIN_WORDS = 12
#: Words by which the tiles of the small octaves are apart; octaves up to TILE / 8 share their tiles.
TILE = 1 << 14
#: Periods below this are compared by shifts of the whole tile; those above, from boundaries.
SHIFTED = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the tail that the query's contract repeats in a tenth of the documents; a null id has none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word as the number of its first like."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def z_function(s: list[int]) -> list[int]:
    """For each place, the length of the longest stretch that starts there and equals the start of `s`."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(maxsize=64)
def _smallest_factor(limit: int) -> np.ndarray:
    """The smallest prime factor of every number up to `limit`."""
    spf = np.arange(limit + 1)
    for p in range(2, int(limit**0.5) + 1):
        if spf[p] == p:
            part = spf[p * p :: p]
            part[part == np.arange(p * p, limit + 1, p)] = p
    return spf


def _shifted(w: np.ndarray, q: int) -> list[tuple[int, int]]:
    """Stretches [start, end) of at least two periods and MIN_WORDS in which words `q` apart are equal."""
    same, least = np.flatnonzero(w[:-q] == w[q:]), max(q, MIN_WORDS - q)
    if len(same) < least:
        return []
    cut = np.flatnonzero(np.diff(same) != 1)
    starts, ends = same[np.r_[0, cut + 1]], same[np.r_[cut, len(same) - 1]] + 1
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), (ends[long] + q).tolist(), strict=True))


def _primitive(w: np.ndarray, start: int, q: int) -> bool:
    """False if the first two periods of a stretch have a smaller period that divides q."""
    root = w[start : start + 2 * q]
    left = q
    for r in range(2, q + 1):
        if left % r == 0:
            if (root[q // r :] == root[: -(q // r)]).all():
                return False
            while left % r == 0:
                left //= r
    return True


def _at_boundary(w: np.ndarray, c: int, scale: int, spf: np.ndarray) -> list[tuple[int, int, int]]:
    """Fragments (period, start, end) of the octave [scale, 2 scale) that hold the boundary c."""
    ahead, back = w[c : c + 4 * scale].tolist(), w[max(0, c - 2 * scale) : c][::-1].tolist()
    forward = np.array(z_function(ahead))
    mark = len(back) + 1  # the words before c + q, read backwards, against those before c
    behind = np.array(z_function([*back, -1, *w[max(0, c - 2 * scale) : c + 2 * scale][::-1].tolist()]))
    top = min(c + 2 * scale, len(w)) - c
    q = np.arange(scale, min(2 * scale, len(ahead)))
    q = q[q < top]
    if not len(q):
        return []
    f, b = forward[q], behind[mark + top - q]
    found = f + b >= q
    q, f, b = q[found], f[found], b[found]
    composed, rest = np.zeros(len(q), bool), q.copy()
    while (rest > 1).any():
        r = np.where(rest > 1, spf[rest], 1)
        p = q // r
        composed |= (r > 1) & (forward[p] >= q + f - p) & (behind[mark + top - p] >= b)
        rest //= r
    return [(int(x), int(c - y), int(c + x + z)) for x, y, z, bad in zip(q, b, f, composed, strict=True) if not bad]


def _reached(w: np.ndarray, q: int, start: int, end: int) -> tuple[int, int, int]:
    """A fragment made as long as its period goes on in the tile."""
    step = 4 * q
    while end < len(w):
        m = min(step, len(w) - end)
        bad = np.flatnonzero(w[end : end + m] != w[end - q : end - q + m])
        end += int(bad[0]) if len(bad) else m
        if len(bad):
            break
        step *= 2
    while start > 0:
        m = min(step, start)
        bad = np.flatnonzero(w[start - m : start] != w[start - m + q : start + q])
        start -= m - 1 - int(bad[-1]) if len(bad) else m
        if len(bad):
            break
        step *= 2
    return q, start, end


def _recurring(hashes: np.ndarray, size: int, scale: int, n: int) -> dict[int, set[int]]:
    """Boundaries beside which a run of `size` words stands again at distances of the octave, and these distances."""
    rows = -(-n // scale)
    found: dict[int, set[int]] = {}
    for lead in (0, size):  # the words after a boundary, the words before it
        grid = np.zeros(rows * scale + size, np.uint64)
        grid[lead : lead + len(hashes)] = hashes
        grid = grid[: rows * scale].reshape(rows, scale)
        same = grid[1:] == grid[:-1, :1]
        for row in np.flatnonzero(same.any(axis=1)).tolist():
            found.setdefault(row * scale, set()).update((np.flatnonzero(same[row]) + scale).tolist())
    return found


def solve_tile(w: np.ndarray, low: int, high: int, least: int = SHIFTED) -> list[tuple[int, int, int]]:
    """Fragments (period, start, end) of the octaves low, 2 low, ... high in the words of a tile.

    Each holds two periods and MIN_WORDS at least, and its period is its smallest. A stretch of a boundary's octave has
    half a scale of equal words on one side of the boundary, so hashes of half a scale tell which
    boundaries need their Z-functions. Left out are those whose distances all belong to runs that are known by then,
    and those deep in a run of a smaller octave, where two periods of a longer one can't be anything but multiples of its period.
    """
    n, out = len(w), []
    hashes, size = (w.astype(np.uint64) + np.uint64(1)) * _BASE, 1  # of runs of `size` words
    scale = low
    while scale <= high and 2 * scale <= n:
        if scale < least:
            for q in range(scale, min(2 * scale, n // 2 + 1)):
                out += [(q, a, b) for a, b in _shifted(w, q) if _primitive(w, a, q)]
            scale *= 2
            continue
        while size < scale // 2:
            m = len(hashes) - size
            hashes = (hashes[:m] * _BASE) ^ (hashes[size : size + m] + np.uint64(size)) * np.uint64(0xC2B2AE3D27D4EB4F)
            size *= 2
        known: dict[int, list[tuple[int, int]]] = {}
        deep = [(a, b) for _, a, b in out if b - a >= min(6 * scale, n)]
        for c, distances in sorted(_recurring(hashes, size, scale, n).items()):
            if any(a <= max(0, c - 2 * scale) and b >= min(n, c + 4 * scale) for a, b in deep):
                continue
            if all(any(a <= c < b - q for a, b in known.get(q, ())) for q in distances):
                continue
            for q, a, b in _at_boundary(w, c, scale, _smallest_factor(2 * scale)):
                if not any(x <= a and b <= y for x, y in known.get(q, ())):
                    out.append(_reached(w, q, a, b))
                    known.setdefault(q, []).append(out[-1][1:])
        scale *= 2
    return stitched(out)


def stitched(fragments: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Fragments of one period that overlap by the period, as one."""
    out: list[list[int]] = []
    for q, a, b in sorted(set(fragments)):
        if out and out[-1][0] == q and a <= out[-1][2] - q:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([q, a, b])
    return [tuple(x) for x in out]  # type: ignore[misc]


def tiles_of(n: int, tile: int = TILE) -> Iterator[tuple[int, int, int, int]]:
    """(lowest octave, highest octave, start, end) of every tile of n words."""
    shared = max(1, tile // 8)
    if n <= tile + max(4 * shared, MIN_WORDS):
        yield 1, max(1, n // 2), 0, n
        return
    scales = [(1, shared)]
    while 2 * scales[-1][1] * 2 <= n:
        scales.append((2 * scales[-1][1],) * 2)
    for low, high in scales:
        step, more = max(tile, 8 * high), max(4 * high, MIN_WORDS)
        for start in range(0, max(1, n - more), step):
            yield low, high, start, min(n, start + step + more)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run (start, length, period) repeats."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


KIND = "document long, key binary, sha string, body binary, period int, start int, end int, low int, high int, codes binary"
_NAMES = [part.split()[0] for part in KIND.split(", ")]
_TYPES = [{"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32()}[part.split()[1]] for part in KIND.split(", ")]


def _survey(docs: DataFrame, tile: int, plant: bool) -> DataFrame:
    """One table of three kinds of rows (KIND), the others' columns null.

    Documents: id, key, SHA-256 of all words, and the text if it may hold a run. Fragments: key, period, start, end.
    Tiles of longer documents: key, start, octaves and the words as numbers.
    """
    held = 256  # rows that are handed on at once

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, held):
                rows: list[tuple] = []
                part = batch.slice(at, held)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("body"), strict=True):
                    body = text.as_py()
                    words = body.split()  # bytes: exactly the contract's white space
                    words = planted(words, doc_id) if plant else words
                    key = hashlib.md5(f"{doc_id} ".encode() + body).digest()
                    all_tiles = list(tiles_of(len(words), tile))
                    codes = numbered(words) if len(words) >= MIN_WORDS else np.array([], np.int32)
                    alone = len(all_tiles) == 1
                    found = solve_tile(codes, *all_tiles[0][:2]) if alone else []
                    rows.append((doc_id, key, hashlib.sha256(b" ".join(words)).hexdigest(), body if found or not alone else None, *[None] * 6))
                    rows += [(None, key, None, None, q, a, b, None, None, None) for q, a, b in found]
                    if not alone:
                        rows += [(None, key, None, None, None, a, b, low, high, codes[a:b].tobytes()) for low, high, a, b in all_tiles]
                columns = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    body = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body).mapInArrow(scan, KIND)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, found = [], []
        for row in batch.to_pylist():
            for q, a, b in solve_tile(np.frombuffer(row["codes"], np.int32), row["low"], row["high"]):
                keys.append(row["key"])
                found.append((q, a + row["start"], b + row["start"]))
        columns = zip(*found, strict=True) if found else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *[pa.array(c, pa.int32()) for c in columns]], ["key", "period", "start", "end"])


def stitch(fragments: DataFrame) -> DataFrame:
    """(key, start, period, length) of the runs that fragments (key, period, start, end) form. Fragments may repeat."""
    own = W.partitionBy("key", "period").orderBy("start", "end")
    reach = F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1))
    opened = fragments.distinct().withColumn("new", F.when(F.col("start") <= reach - F.col("period"), 0).otherwise(1))
    grouped = opened.withColumn("run", F.sum("new").over(own.rowsBetween(W.unboundedPreceding, 0)))
    runs = grouped.groupBy("key", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.select("key", "start", "period", (F.col("end") - F.col("start")).alias("length"))


def _kept(rows: DataFrame, plant: bool) -> DataFrame:
    """rows with `runs` and `body`: the SHA-256 of the words that no run repeats."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, body, runs in zip(batch.column("doc_id").to_pylist(), batch.column("body"), batch.column("runs"), strict=True):
                words = body.as_py().split()
                words = planted(words, doc_id) if plant else words
                kept = collapsed(words, [(r["start"], r["length"], r["period"]) for r in runs.as_py()])
                out.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("runs"), pa.array(out, pa.string())], ["doc_id", "runs", "sha"])

    return rows.mapInArrow(scan, "doc_id long, runs array<struct<start: int, period: int, length: int>>, sha string")


def find_runs(docs: DataFrame, tile: int = TILE, plant: bool = False) -> DataFrame:
    """(doc_id, runs, kept_sha256) per row of `docs`: its runs (start, period, length) by start, then period.

    A run is a stretch of at least MIN_WORDS words and two of its smallest period, which can't be made
    longer at either end. kept_sha256 is of the words, joined by one blank, without those that a run
    repeats. A null or empty text has no runs. Rows that repeat an id and a text have the same runs and
    are told once where they are stitched; other texts with one id are told apart. A null id stays null.
    Ties in start go to the smaller period. Long texts are read whole. An empty table gives an empty result. Other
    columns aren't read. plant: judge the words that the query's contract makes of each document.
    """
    known = durable(_survey(docs, tile, plant))
    fragments = known.where("period is not null").select("key", "period", "start", "end")
    cut = known.where("codes is not null").select("key", "start", "low", "high", "codes")
    dealt = cut.repartition("key", "low", "start").mapInArrow(_solve, "key binary, period int, start int, end int")
    runs = stitch(fragments.unionByName(dealt))
    per_text = runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))  # at most a text's words
    rows = known.where("sha is not null")
    none = F.array().cast("array<struct<start: int, period: int, length: int>>")
    clean = rows.where("body is null").select(F.col("document").alias("doc_id"), none.alias("runs"), "sha")
    maybe = join_spread(rows.where("body is not null").select(F.col("document").alias("doc_id"), "key", "body"), per_text, ["key"], "left")
    judged = _kept(maybe.select("doc_id", "body", F.coalesce("runs", none).alias("runs")), plant)
    return clean.unionByName(judged).withColumnRenamed("sha", "kept_sha256")


def run_report(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """The contract's columns per row of `docs`, over the words with the planted tails."""
    found = find_runs(docs, tile, plant=True)

    def longest(runs: Column) -> Column:
        ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("by_length"), r["start"].alias("start"), r["period"].alias("period")))
        return F.array_min(ranked)

    top = found.withColumn("top", longest(F.col("runs")))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    length, period = (-F.col("top.by_length")).cast("long"), F.col("top.period").cast("long")
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").cast("long").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.col("kept_sha256").alias("collapsed_sha256"),
    )
