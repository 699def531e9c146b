from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from quotemill.llm import sharding
from tests.llm import plain
from tests.llm.edges import TEXTS, documents, empty


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 10, 97, 100, 101, 1000, 4096, 5003])
def test_it_is_a_permutation(spark, n):
    moved = spark.range(n).select(sharding.permute(F.col("id"), n).alias("p"))
    assert sorted(r.p for r in moved.collect()) == list(range(n))


def test_large_numbers_stay_inside(spark):
    n = 10**12 + 39
    got = [r.p for r in spark.range(n - 2000, n).select(sharding.permute(F.col("id"), n).alias("p")).collect()]
    assert all(0 <= p < n for p in got) and len(set(got)) == 2000


def test_report(spark):
    rows = sharding.shard_report(documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in TEXTS)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    counts = [len(by_shard.get(s, [])) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    assert sharding.shard_report(empty(spark)).count() == 0


def test_partitions_do_not_matter(spark):
    docs = documents(spark)
    key = lambda df: sorted(str((r.doc_id, r.text_crc32, r.shard, r.slot)) for r in sharding.shard_report(df).collect())
    assert key(docs) == key(docs.repartition(7, "text")) == key(docs.coalesce(1))


def test_documents_keep_their_columns(spark):
    docs = documents(spark)
    out = sharding.shard_documents(docs)
    assert out.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert out.count() == docs.count()
    with pytest.raises(ValueError, match="positive"):
        sharding.shard_rows(docs, ["doc_id"], 0)


def test_shards_and_slots_equal_plain_python(spark):
    texts = [(i * 7 - 3 if i % 11 else None, f"text {i % 17}" * (i % 5) if i % 13 else None, "en", "s") for i in range(230)]
    rows = sorted(str((r.doc_id, r.text_crc32, r["size"], r.shard, r.slot)) for r in sharding.shard_report(documents(spark, texts)).collect())
    data = [(t[1] or "").encode() for t in texts]
    keys = [(t[0], zlib.crc32(d), len(d) + 1) for t, d in zip(texts, data, strict=True)]
    found = plain.sharded(keys, sharding.SHARDS, sharding.SEED, sharding.ROUNDS, sharding.MIN_BUCKETS)
    assert rows == sorted(str((*k, *f)) for k, f in zip(keys, found, strict=True))
