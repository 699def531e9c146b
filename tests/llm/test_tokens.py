from __future__ import annotations

import math
import random

import pytest
import regex

from quotemill.llm import token_trie
from tests.llm.edges import TEXTS, documents, empty


@pytest.fixture(scope="module")
def scores():
    return token_trie.load_scores()


def brute(token: bytes, scores) -> int:
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(token)
    for end in range(1, len(token) + 1):
        for start in range(end):
            s = scores.get(token[start:end])
            if s is not None:
                here = (s + best[start][0], best[start][1] + 1)
                if here[0] > best[end][0] or (here[0] == best[end][0] and here[1] < best[end][1]):
                    best[end] = here
    return best[-1][1]


def test_trie_equals_brute_force(scores):
    walk, rng = token_trie.TrieWalk(scores), random.Random(1)
    tokens = ["".join(rng.choice("abcdeinst äß1 ") for _ in range(rng.randint(1, 30))).encode() for _ in range(300)]
    tokens += [b"", b"x" * 500, "日本語".encode() * 40, b"\x00\xff", b"the", b"then", b"the", b"th"]
    ordered = sorted(tokens)
    assert walk.tokens(ordered) == [brute(t, scores) for t in ordered]


def test_a_full_memory_changes_nothing(spark, scores, monkeypatch):
    docs = documents(spark).coalesce(1)
    want = sorted(map(str, token_trie.count_tokens(docs, scores).collect()))
    monkeypatch.setattr(token_trie, "REMEMBERED", 3)
    monkeypatch.setattr(token_trie, "WALKED_DOCS", 2)
    assert sorted(map(str, token_trie.count_tokens(docs, scores).collect())) == want


def test_counts_of_edge_rows(spark, scores):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_pretokens, r.n_tokens) for r in token_trie.count_tokens(documents(spark), scores).collect())
    memo: dict[str, int] = {}
    want = []
    for doc, text, *_ in TEXTS:
        parts = regex.findall(token_trie.PRE_TOKEN, text or "")
        assert "".join(parts) == (text or "")
        for p in set(parts) - memo.keys():
            memo[p] = brute(p.encode(), scores)
        want.append((str(doc), len((text or "").encode()), len(parts), sum(memo[p] for p in parts)))
    assert got == sorted(want)
    assert token_trie.count_tokens(empty(spark), scores).count() == 0


def test_vocabulary_must_hold_every_byte(tmp_path):
    (tmp_path / "v").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="every byte"):
        token_trie.load_scores(str(tmp_path / "v"))


def test_slices_are_bounded_in_rows_and_bytes(spark, scores, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_trie, "WALKED_BYTES", 100)
    monkeypatch.setattr(token_trie, "WALKED_DOCS", 4)
    texts = ["a" * n for n in (10, 50, 60, 500, 1, 1, 1, 1, 1, 100, 0, 99, 99)]
    parts = [p.column("text").to_pylist() for p in token_trie._slices(pa.record_batch({"text": texts}))]
    assert [t for p in parts for t in p] == texts and all(len(p) <= 4 and (len(p) == 1 or sum(map(len, p)) <= 100) for p in parts)
    rows = [(i, f"some words {i} and more " * (i % 4), "en", "s") for i in range(40)]
    got = {r.doc_id: r.n_tokens for r in token_trie.count_tokens(documents(spark, rows), scores).collect()}
    assert got == {i: sum(brute(m.encode(), scores) for m in regex.findall(token_trie.PRE_TOKEN, t)) for i, t, *_ in rows}


def test_very_long_texts(spark, scores):
    long = " ".join(f"wort{i % 5000} und" for i in range(1_000_000))  # some 13 MB each
    rows = [(i, long, "en", "s") for i in range(4)] + [(9, "x" * 200_000, "en", "s")]
    got = {r.doc_id: r.n_bytes for r in token_trie.count_tokens(documents(spark, rows), scores).collect()}
    assert got == {0: len(long), 1: len(long), 2: len(long), 3: len(long), 9: 200_000}
