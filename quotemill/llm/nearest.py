"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes by learned rotations: the signs of principal components of a bounded sample, turned so that
they lose least (iterative quantisation). A code is split into substrings, and each block of the index keeps one table
per substring. Codes within a radius R of a query differ from it by little in one substring at least
(pigeonhole), so probing every table's near buckets meets all of them; their distances are then
verified, and the vectors themselves ranked by their inner products.

The radius is measured, not guessed: for some rows the true neighbours among all rows are found by one pass, and
R is what holds nearly all of them. Equal vectors are searched once.

Largest inner products among vectors of any length are smallest angles after one more component is
added, so that all have the length of the longest; a query gets a zero there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.llm.common import durable, join_spread

TOP = 20


@dataclass(frozen=True)
class Settings:
    """bits of a code; bits of a substring; different vectors that the rotations are fitted on; rows whose true neighbours set
    the radius, and the share of these that it has to hold; rows of a block of the index and of the queries."""

    bits: int = 128
    substring: int = 16
    sample: int = 4096
    tried: int = 64
    share: float = 0.97
    index_block: int = 8192
    query_block: int = 1024


@dataclass(frozen=True)
class Coder:
    """planes: one column per bit; longest: the length of the longest vector; width: components of a vector."""

    planes: np.ndarray
    longest: float
    width: int

    def codes(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Codes as rows of substrings."""
        more = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0))
        signs = np.c_[vectors, more] @ self.planes > 0
        return np.packbits(signs, axis=1)


def learn(sample: np.ndarray, longest: float, bits: int, rounds: int = 20) -> Coder:
    """Rotations of the sample's principal components until there are `bits` of them, each from a start of its own."""
    x = np.c_[sample, np.sqrt(np.maximum(longest**2 - (sample**2).sum(axis=1), 0))] / longest
    _, vectors = np.linalg.eigh(x.T @ x)
    rng, planes = np.random.default_rng(0), []
    while sum(p.shape[1] for p in planes) < bits:
        basis = vectors[:, ::-1][:, : min(bits, sample.shape[1])]
        v = x @ basis
        r = np.linalg.qr(rng.normal(size=(basis.shape[1],) * 2))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (left @ right).T
        planes.append(basis @ r)
    return Coder(np.concatenate(planes, axis=1)[:, :bits], longest, sample.shape[1])


def different_vectors(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with an id and key, vectors): vectors have a key, their components and the TOP + 1 smallest of their ids.

    Vectors that are null, empty or all zero, or hold a null or non-finite component, are left out.
    """
    # NaN is larger than infinity in Spark
    fine = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))
    usable = F.forall("vec", fine) & F.exists("vec", lambda x: x != 0)
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(usable)
    own = own.select("id", F.struct(F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(1), "vec").alias("b")).alias("key"), "vec")
    place = F.row_number().over(W.partitionBy("key").orderBy(F.col("id").asc_nulls_last()))
    first = own.withColumn("place", place).where(F.col("place") <= TOP + 1)  # cut off before the shuffle, too
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"])
    vectors = first.groupBy("key").agg(F.first("vec").alias("vec"), listed.alias("ids"))
    return own.select("id", "key"), vectors


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of doubles; a missing component at the end is zero."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


BLOCK = "n int, keys binary, codes binary, vectors binary, ids array<array<long>>"


def _packed(vectors: DataFrame, coder: Coder, rows: int, query: bool) -> DataFrame:
    """Blocks of at most `rows` vectors: keys (16 bytes each), codes and components as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            x = _matrix(t.column("vec").combine_chunks(), coder.width)
            keys = np.stack([t.column(c).to_numpy() for c in ("a", "b")], axis=1)
            columns = [pa.array([len(x)], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (keys, coder.codes(x, query), x)], pa.array([t.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64())))]
            return pa.RecordBatch.from_arrays(columns, ["n", "keys", "codes", "vectors", "ids"])

        n = 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, rows - n))
                n += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if n == rows:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    ids = "ids" if not query else F.array().cast("array<long>").alias("ids")
    return vectors.select("key.a", "key.b", "vec", ids).mapInArrow(pack, BLOCK)


def radii(radius: int, parts: int) -> list[int]:
    """Largest distances per substring, such that a code within `radius` is within one of them: their sum and `parts` are radius + 1."""
    each, more = divmod(radius + 1, parts)
    return [each - 1 + (i < more) for i in range(parts)]


class Tables:
    """One table per substring of a block's codes: its occupied buckets, and the rows of each."""

    def __init__(self, codes: np.ndarray, size: int) -> None:
        self.codes, self.size = codes.view(np.uint64), size
        self.parts = codes.view(f">u{size // 8}")
        self.tables = []
        for part in self.parts.T:
            order = np.argsort(part, kind="stable")
            values, starts = np.unique(part[order], return_index=True)
            self.tables.append((values.astype(f"u{size // 8}"), np.r_[starts, len(order)], order))

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, int]:
        """Rows whose codes differ from `code` (bytes) in `radius` bits at most, and how many were met by probing."""
        met = np.zeros(len(self.codes), bool)
        for (values, starts, order), part, near in zip(self.tables, code.view(f">u{self.size // 8}"), radii(radius, len(self.tables)), strict=True):
            if near < 0:
                continue
            probed = np.flatnonzero(np.bitwise_count(values ^ values.dtype.type(part)) <= near)
            if len(values) == len(order):  # a row in each bucket
                met[order[probed]] = True
            elif len(probed):
                sizes = starts[probed + 1] - starts[probed]
                met[order[np.repeat(starts[probed] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]] = True
        rows = np.flatnonzero(met)
        far = np.bitwise_count(self.codes[rows] ^ code.view(np.uint64)).sum(axis=1)
        return rows[far <= radius], len(rows)


def _best(scores: np.ndarray, smallest: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` largest scores, ties to the smallest id."""
    if len(scores) > 4 * top:
        least = np.partition(scores, len(scores) - top)[len(scores) - top]
        near = np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(least)))
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((smallest[near], -scores[near]))][:top]


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the rows of x with y, added in the same order for any number of rows."""
    return (x * y).cumsum(axis=1)[:, -1]


FOUND = "a long, b long, score double, own boolean, ids array<long>"
_FOUND = ["a", "b", "score", "own", "ids"]


def _search(pairs: DataFrame, settings: Settings, coder: Coder, radius: int) -> DataFrame:
    """For each pair of a block of queries and one of the index: the TOP + 1 nearest vectors of the block for each query (FOUND)."""
    last = (1 << 63) - 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at] for c in batch.schema.names}
                read = lambda c, kind, n: np.frombuffer(row[c].as_buffer(), kind).reshape(n, -1)  # noqa: E731, B023
                n, m = row["n"].as_py(), row["q_n"].as_py()
                tables, vectors, keys = Tables(np.ascontiguousarray(read("codes", np.uint8, n)), settings.substring), read("vectors", float, n), read("keys", np.int64, n)
                ids = row["ids"].values
                smallest = pc.fill_null(pc.list_element(ids, 0), last).to_numpy(zero_copy_only=False)
                taken, scores, who, own = [], [], [], []
                q_keys, q_codes = read("q_keys", np.int64, m), np.ascontiguousarray(read("q_codes", np.uint8, m))
                for q, vec in enumerate(read("q_vectors", float, m)):
                    near, _ = tables.within(q_codes[q], radius)
                    if not len(near):
                        continue
                    rough = vectors[near] @ vec
                    keep = near[_best(rough, smallest[near], 2 * TOP)]
                    exact = inner_products(vectors[keep], vec)
                    best = _best(exact, smallest[keep], TOP + 1)
                    taken.append(keep[best])
                    scores.append(exact[best])
                    who.append(np.full(len(best), q))
                    own.append((keys[keep[best]] == q_keys[q]).all(axis=1))
                if taken:
                    at_query = np.concatenate(who)
                    columns = [pa.array(q_keys[at_query, 0]), pa.array(q_keys[at_query, 1]), pa.array(np.concatenate(scores)), pa.array(np.concatenate(own)), ids.take(pa.array(np.concatenate(taken)))]
                    yield pa.RecordBatch.from_arrays(columns, _FOUND)

    return pairs.mapInArrow(scan, FOUND)


def _ranked(found: DataFrame) -> DataFrame:
    """(key, near): of the vectors found for a query, the TOP + 1 nearest rows; they hold the TOP others, whichever row is the query's own."""
    place = F.row_number().over(W.partitionBy("a", "b").orderBy(F.desc("score"), F.get("ids", F.lit(0)).asc_nulls_last()))
    top = found.withColumn("place", place).where(F.col("place") <= TOP + 1)
    each = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("by"), i.isNull().alias("last"), i.alias("id"), F.col("own").alias("own")))
    ranked = top.groupBy("a", "b").agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, TOP + 1).alias("near"))
    return ranked.select(F.struct("a", "b").alias("key"), "near")


def measured_radius(vectors: DataFrame, tried: np.ndarray, coder: Coder, share: float) -> int:
    """The code distance that holds a share of the true TOP neighbours of the vectors `tried` among all vectors."""
    queries = vectors.sparkSession.sparkContext.broadcast((tried, coder.codes(tried, query=True)))  # a bounded number

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, codes = queries.value
        scores, far = np.empty((len(mine), 0)), np.empty((len(mine), 0), int)
        for batch in batches:
            x = _matrix(batch.column("vec"), coder.width)
            own = coder.codes(x, query=False)
            for at in range(0, len(x), 4096):
                s = mine @ x[at : at + 4096].T
                d = np.bitwise_count(codes[:, None, :] ^ own[None, at : at + 4096, :]).sum(axis=2, dtype=int)
                same = (x[None, at : at + 4096] == mine[:, None]).all(axis=2)
                s[same] = -np.inf
                scores, far = np.c_[scores, s], np.c_[far, d]
                keep = np.argsort(-scores, axis=1)[:, :TOP]
                scores, far = np.take_along_axis(scores, keep, 1), np.take_along_axis(far, keep, 1)
        q, k = np.nonzero(np.isfinite(scores))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(scores[q, k]), pa.array(far[q, k], pa.int32())], ["q", "score", "far"])

    found = vectors.select("vec").mapInArrow(scan, "q int, score double, far int")
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))
    far = [r.far for r in found.withColumn("place", place).where(F.col("place") <= TOP).select("far").collect()]
    return int(np.ceil(np.quantile(far, share))) if far else 0


def nearest(rows: DataFrame, queries: Column | str, settings: Settings = Settings(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the TOP nearest rows found for each row where `queries` (of `id`) holds.

    Nearest is the largest inner product in doubles, ties go to the smaller id; a row isn't its own neighbour, but
    another row with the same id or vector is one. Rows that repeat are rows of their own. A null id is no
    query and comes last among ties. Vectors null, empty, zero or with a null or non-finite component take no part; one
    that is shorter than the longest counts as ending in zeros. With fewer rows, all are returned. An
    empty table gives an empty result. Other columns aren't read.
    """
    own, vectors = different_vectors(rows, id_col, vec_col)
    vectors = durable(vectors)
    n, width, longest = vectors.agg(F.count("*"), F.max(F.size("vec")), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    sample = vectors.orderBy("key").limit(settings.sample).select("vec").toArrow().column("vec").combine_chunks()  # bounded
    sample = _matrix(sample, width)
    coder = learn(sample, longest, settings.bits)
    radius = measured_radius(vectors, sample[: settings.tried], coder, settings.share) if n > TOP else settings.bits
    asked = own.where(queries)
    index = durable(_packed(vectors.repartition(-(-n // settings.index_block)), coder, settings.index_block, query=False))
    wanted = durable(vectors.select("key", "vec").join(asked.select("key").distinct(), "key", "left_semi"))
    blocks = -(-max(wanted.count(), 1) // settings.query_block)
    searched = durable(_packed(wanted.repartition(blocks), coder, settings.query_block, query=True))
    searched = searched.select(*[F.col(c).alias(f"q_{c}") for c in ("n", "keys", "codes", "vectors")])
    answers = _ranked(_search(index.crossJoin(searched), settings, coder, radius))
    if radius < settings.bits:
        answers = durable(answers)
        lonely = durable(wanted.join(answers.where(F.size("near") > TOP).select("key"), "key", "left_anti"))
        if not lonely.isEmpty():  # fewer than TOP others within the radius: the whole index is searched for them
            again = durable(_packed(lonely, coder, settings.query_block, query=True))
            again = again.select(*[F.col(c).alias(f"q_{c}") for c in ("n", "keys", "codes", "vectors")])
            rest = _ranked(_search(index.crossJoin(again), settings, coder, settings.bits))
            answers = answers.where(F.size("near") > TOP).unionByName(rest)
    joined = join_spread(asked, answers, ["key"])
    mine = F.array_position(F.transform("near", lambda x: x["own"] & (x["id"] == F.col("id"))), F.lit(True))
    drop = F.when(mine > 0, mine - 1).otherwise(F.lit(TOP))
    others = F.slice(F.filter("near", lambda x, i: i != drop), 1, TOP)
    out = joined.select(F.col("id").alias("query_id"), F.posexplode(others).alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.by")).alias("score"))
