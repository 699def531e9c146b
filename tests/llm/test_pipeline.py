from __future__ import annotations

import random

import corpus_pipeline
from quotemill.llm import near_copies, quality, sharding, simhash, tiling
from tests.llm import plain
from tests.llm.edges import documents

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def text(i: int, extra: str = "") -> str:
    return " ".join(f"the word{i} of{(i * 7 + k) % 101} and{k} in{(k * k + i) % 53}" for k in range(20)) + " " + extra


def rows() -> list[tuple]:
    out = [(i, text(i), ["en", "de", "fr"][i % 3], f"src{i % 5}") for i in range(60)]
    out += [(100 + i, text(i), "en", "src0") for i in range(10)]  # exact copies
    out += [(200, text(300, ITEM), "en", "src1"), (201, "too short", "en", "src1"), (202, None, None, None), (None, text(400), "en", "src2")]
    return out


def test_every_stage_on_what_the_one_before_kept(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark, rows())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    assert 201 not in seen["quality_rules"] and 202 not in seen["quality_rules"] and 200 in seen["quality_rules"]
    assert not {*range(100, 110)} & {*seen["near_dedup"]} and len(seen["near_dedup"]) == 62
    assert 200 not in seen["decontaminate"] and None in seen["decontaminate"] and len(seen["decontaminate"]) == 61
    assert {*seen["mix"]} < {*seen["decontaminate"]} and len(seen["mix"]) > 30
    assert sorted(map(str, seen["mix"])) == sorted(map(str, seen["shard"]))
    final = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted((str(r.doc_id), r.shard, r.slot) for r in df.collect())
    assert key(final) == key(docs)


def test_the_pipeline_equals_plain_python(spark, tmp_path):
    """All stages again, one row at a time: same documents, shards and slots."""
    rng = random.Random(8)
    items = [(k, " ".join(f"q{k}x{rng.randint(0, 40)}" for _ in range(12))) for k in range(6)]
    docs = []
    for i in range(170):
        words = text(i).split()[: rng.choice((30, 70, 80, 100))]
        if i % 9 == 0 and docs:
            words = (rng.choice(docs)[1] or "").split()
            for at in rng.sample(range(len(words)), min(len(words), rng.randint(0, 4))):
                words[at] = f"new{i}"
        if i % 10 == 3:
            words += rng.choice(items)[1].split()
        if i % 23 == 5:
            words = ["###"] * 20 + words
        docs.append((i, " ".join(words) if i % 31 else None, rng.choice(("en", "de", None)), rng.choice(("src1", "src2", "src7", None))))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    documents(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    stages = [docs]
    stages.append([d for d in stages[-1] if plain.good(d[1], quality.THRESHOLDS, quality.STOP_WORDS)])
    stages.append([stages[-1][i] for i in plain.firsts(stages[-1], near_copies.SIMILARITY)])
    leaked = {d for d, *_ in plain.leaks(stages[-1], items, tiling.THRESHOLD)}
    stages.append([d for d in stages[-1] if d[0] not in leaked])
    copies = plain.mixed(stages[-1], corpus_pipeline.PIPELINE_MIX)
    stages.append([d for i, d in enumerate(stages[-1]) for _ in range(copies.get(i, 0))])
    assert all(len(a) > len(b) > 60 for a, b in zip(stages, stages[1:], strict=False))
    keys = [(d[0], plain.text_hash(d[1])) for d in stages[-1]]
    found = plain.sharded(keys, sharding.SHARDS, sharding.SEED, sharding.ROUNDS, sharding.MIN_BUCKETS)
    want = sorted((k[0], *f) for k, f in zip(keys, found, strict=True))
    assert sorted((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    documents(spark).where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_call_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "mix", "shard"]
    assert quality.THRESHOLDS and simhash.THRESHOLD == 3 and tiling.THRESHOLD == 0.8
