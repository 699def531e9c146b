from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from quotemill.llm import near_copies, simhash
from tests.llm.edges import TEXTS, documents, empty


def grams(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard(a: str, b: str) -> float:
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def copy_at(name: int, similarity: float, shingles: int = 180) -> tuple[str, str]:
    """Two texts of exactly this similarity: the second one's last words differ."""
    same = round(similarity * 2 * shingles / (1 + similarity))
    words = [f"w{name}x{k}" for k in range(shingles + 4)]
    return " ".join(words), " ".join(words[: same + 4] + [f"v{name}x{k}" for k in range(shingles - same)])


@pytest.mark.parametrize("similarity", [0.8, 0.9, 0.95])
def test_copies_at_and_above_the_limit_go(spark, similarity):
    rows = []
    for i in range(30):
        a, b = copy_at(i, similarity)
        b = b if jaccard(a, b) >= similarity else copy_at(i, similarity + 0.004)[1]
        assert similarity <= jaccard(a, b) < similarity + 0.02
        rows += [(2 * i, a, "en", "s"), (2 * i + 1, b, "en", "s")]
    kept = corpus_pipeline.near_dedup(spark, documents(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 60, 2))


def test_less_similar_texts_stay(spark):
    rows = [(10 * i + k, t, "en", "s") for i in range(20) for k, t in enumerate(copy_at(i, 0.79))]
    assert corpus_pipeline.near_dedup(spark, documents(spark, rows), "").count() == 40


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for base in range(6):  # chains: each copy changes some words of the one before
        words = [f"b{base}x{k}" for k in range(150)]
        for step in range(12):
            texts.append(" ".join(words))
            for at in rng.choice(150, int(rng.integers(1, 6)), replace=False):
                words[int(at)] = f"s{step}x{at}"
    roots = list(range(len(texts)))
    for _ in texts:
        for i, j in combinations(range(len(texts)), 2):
            if jaccard(texts[i], texts[j]) >= 0.8:
                roots[i] = roots[j] = min(roots[i], roots[j])
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert got == dict(enumerate(roots)) and 6 < len(set(roots)) < len(texts)


def test_chunks_do_not_change_the_components(spark, monkeypatch):
    """Copies that differ from a base in too many places to link with each other, and chains, in chunks of a few rows."""
    rng = np.random.default_rng(4)
    base, texts = [f"w{k}" for k in range(160)], []
    for _ in range(60):
        words = list(base)
        for at in rng.choice(160, int(rng.integers(1, 7)), replace=False):
            words[int(at)] = f"v{rng.integers(1000)}"
        texts.append(" ".join(words))
    roots = list(range(len(texts)))
    for _ in texts:
        for i, j in combinations(range(len(texts)), 2):
            if jaccard(texts[i], texts[j]) >= 0.8:
                roots[i] = roots[j] = min(roots[i], roots[j])
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    for chunk, chunk_bytes, per_leader in ((512, 1 << 24, 1000), (7, 1 << 24, 5), (512, 8000, 1000)):
        monkeypatch.setattr(near_copies, "CHUNK", chunk)
        monkeypatch.setattr(near_copies, "CHUNK_BYTES", chunk_bytes)
        monkeypatch.setattr(near_copies, "PER_LEADER", per_leader)
        assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == dict(enumerate(roots))
    assert 5 < len(set(roots)) < 55


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 300)).astype(np.uint64)) for _ in range(70)] + [np.array([], np.uint64)]
    got = near_copies.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i, j in combinations(range(len(sets)), 2)) and (got == got.T).all()


def test_edges(spark):
    got = near_copies.near_copies(documents(spark)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(t[0]) for t in TEXTS)
    assert near_copies.near_copies(empty(spark)).count() == 0


def test_simhash_links_are_found_verified_and_contracted(spark, monkeypatch):
    """Copies with few changed words are connected by the pivot table alone; texts of another set with the same SimHash are not."""
    rows = []
    for i in range(20):
        words = [f"w{i}x{k}" for k in range(400)]
        rows += [(3 * i, " ".join(words), "en", "s"), (3 * i + 1, " ".join([*words[:-1], "other"]), "en", "s"), (3 * i + 2, f"alone{i}", "en", "s")]
    docs = documents(spark, rows)
    wanted = {i: 3 * (i // 3) if i % 3 == 1 else i for i in range(60)}
    monkeypatch.setattr(near_copies, "band_keys", lambda found, hashers: [])
    close = {3 * i + 1 for i in range(20) if (simhash.fingerprint(rows[3 * i][1].encode()) ^ simhash.fingerprint(rows[3 * i + 1][1].encode())).bit_count() <= 3}
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == {i: wanted[i] if i in close else i for i in range(60)} and len(close) > 10
    monkeypatch.setattr(near_copies, "fingerprint", lambda text: 7)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert all(got[i] == i for i in got if i % 3 != 1)
