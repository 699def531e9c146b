"""Multi-index hashing against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from quotemill.llm import nearest
from tests.sqlcheck import DATA

TWENTIETH = "id % 20 = 0"


def usable(v) -> bool:
    return v is not None and any(v) and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, top: int = 20) -> list[tuple]:
    """(query_id, rank, vec_id, score) of every query; rows: (id, vector)."""
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if usable(v)]
    out = []
    for at, (q, v) in enumerate(rows):
        if q is None or q % 20:
            continue
        near = [(-sum(a * b for a, b in zip(v, w)), i is None, i) for k, (i, w) in enumerate(rows) if k != at]
        out += [(q, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(near)[:top], 1)]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], "vec_id long, embedding array<float>, id string, key string, vec string, a string")


def found(spark, rows, **kw) -> list[tuple]:
    return sorted((tuple(r) for r in nearest.nearest(frame(spark, rows), TWENTIETH, **kw).collect()), key=str)


def whole(rng: random.Random, n: int = 8) -> list[float]:
    """Small whole numbers, whose products are exact and often tie."""
    return [float(rng.randrange(-3, 4)) for _ in range(n)]


def odd_rows() -> list[tuple]:
    rng = random.Random(1)
    rows = [(i, whole(rng)) for i in range(200)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0, -1.0, 2.0]) for i in range(100)]  # copies, five of them queries
    rows += [(20, whole(rng)), (20, whole(rng)), (40, rows[40][1]), (None, whole(rng)), (None, rows[60][1]), (300, None), (320, []), (340, [0.0] * 8)]
    rows += [(360, [1.0, None] + [0.0] * 6), (380, [float("nan")] * 8), (400, [float("inf")] + [1.0] * 7), (420, [2.0, 1.0]), (440, [9.0] * 8)]
    return rows


def test_with_the_widest_radius_all_is_exact(spark, monkeypatch):
    monkeypatch.setattr(nearest, "measured_radius", lambda *_: 64)
    rows = odd_rows()
    want = brute([(i, v + [0.0] * (8 - len(v)) if v else v) for i, v in rows])
    settings = nearest.Settings(bits=64, substring=8, sample=50, index_block=64, query_block=16)
    assert found(spark, rows, settings=settings) == want and len(want) > 300


def test_queries_that_find_too_few_search_on(spark, monkeypatch):
    monkeypatch.setattr(nearest, "measured_radius", lambda *_: 0)
    settings = nearest.Settings(bits=64, sample=50, index_block=64, query_block=16)
    rows = odd_rows()
    got = found(spark, rows, settings=settings)
    queries = [i for i, v in rows if usable(v) and i is not None and i % 20 == 0]
    assert len(got) == 20 * len(queries)
    padded = [(i, v + [0.0] * (8 - len(v)) if v else v) for i, v in rows if i is None or i < 1000]
    others = {r for r in brute(padded) if r[0] == 440}
    assert others == {r for r in found(spark, [r for r in rows if r[0] is None or r[0] < 1000], settings=settings) if r[0] == 440}


def test_few_rows_and_an_empty_table(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (7, [1.0, 0.0]), (8, [0.0, 0.0])]
    assert found(spark, rows) == brute(rows) and len(brute(rows)) == 4
    assert found(spark, [(0, [1.0])]) == []
    assert nearest.nearest(frame(spark, []), TWENTIETH).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="the given tables aren't here")
def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in nearest.nearest(rows, TWENTIETH).collect()}
    want = {(r[0], r[2]) for r in brute([tuple(r) for r in rows.select("vec_id", "embedding").collect()])}
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("size", [8, 16])
def test_probing_meets_every_code_within_the_radius(size):
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (500, 16), np.uint8)
    codes[250:] = codes[:250] ^ (rng.random((250, 16)) < 0.2).astype(np.uint8)  # near ones, and equal substrings
    tables = nearest.Tables(codes, size)
    for radius in (0, 1, 7, 40, 61, 128):
        for q in range(0, 500, 50):
            far = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
            near, met = tables.within(codes[q], radius)
            assert near.tolist() == np.flatnonzero(far <= radius).tolist() and met >= len(near)
    assert nearest.radii(5, 4) == [1, 1, 0, 0] and nearest.radii(1, 4) == [0, 0, -1, -1]


def test_far_codes_are_not_met():
    codes = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 16, axis=1)
    assert nearest.Tables(codes, 16).within(codes[0], 7)[1] == 1  # a bucket of each table
