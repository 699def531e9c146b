"""Periodic runs against a plain search that compares every word with every distance."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quotemill.llm import periodic_runs
from tests.llm.edges import TEXTS, documents, empty


def runs_of(w: list) -> list[tuple[int, int, int]]:
    """(start, period, length) of all runs."""
    found, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j - i >= q and length >= 12 and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, q, length))
            i = max(j, i + 1)
    return sorted(found)


def report_of(doc_id, text) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_of(words)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = [x for i, x in enumerate(words) if not any(s + q <= i < s + length for s, q, length in runs)]
    s, q, length = min(runs, key=lambda r: (-r[2], r[0], r[1])) if runs else (None, None, None)
    listed = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
    return doc_id, len(runs), s, length, q, 1000 * length // q if runs else None, sha(listed), sha(" ".join(kept))


def odd_words(rng: random.Random, n: int) -> list[int]:
    """Few words, with repeated pieces in repeated pieces."""
    w: list[int] = []
    while len(w) < n:
        piece = [rng.randrange(rng.choice((1, 2, 3, 50))) for _ in range(rng.choice((1, 2, 3, 5, 17, 40, 70)))]
        piece = piece * rng.choice((1, 1, 2, 3, 9)) + piece[: rng.randrange(len(piece) + 1)]
        w += piece * rng.choice((1, 1, 1, 2))
    return w[:n]


def pieced(w: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    parts = [(q, a + start, b + start) for low, high, start, end in periodic_runs.tiles_of(len(w), tile) for q, a, b in periodic_runs.solve_tile(w[start:end], low, high)]
    return sorted((a, q, b - a) for q, a, b in periodic_runs.stitched(parts))


@pytest.mark.parametrize("seed", range(40))
def test_tiles_of_any_size_give_all_runs(seed):
    rng = random.Random(seed)
    w = odd_words(rng, rng.choice((0, 1, 11, 12, 30, 100, 260, 400)))
    want = runs_of(w)
    for tile in (1, 8, 32, 64, 1 << 14):
        assert pieced(np.array(w, np.int32), tile) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90))
def test_small_alphabets(w):
    assert pieced(np.array(w, np.int32), 16) == runs_of(w)


@pytest.mark.parametrize("least", [1, 2, 16, 64])
def test_boundaries_and_shifts_agree(least):
    """The two ways to solve an octave give the same; boundaries need two words of scale."""
    for seed in range(8):
        w = np.array(odd_words(random.Random(seed), 300), np.int32)
        found = [r for r in periodic_runs.solve_tile(w, 1, 150, max(least, 2)) if r[2] - r[1] >= 12]
        assert sorted((a, q, b - a) for q, a, b in found) == runs_of(w.tolist())


def test_the_z_function():
    assert periodic_runs.z_function(list("aabaab")) == [6, 1, 0, 3, 1, 0] and periodic_runs.z_function([]) == []


def test_a_long_repeated_word_is_solved_in_linear_time():
    w = np.zeros(60_000, np.int32)
    assert pieced(w, 1 << 12) == [(0, 1, 60_000)]


@pytest.mark.parametrize("tile", [32, periodic_runs.TILE])
def test_the_report(spark, tile):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{x}" for x in odd_words(rng, rng.choice((5, 20, 90, 300)))), "en", "s") for i in range(80)]
    rows += [r for r in TEXTS if r[0] != 7] + [(3, "x y \x1c " * 12, "en", "s"), (None, "a b " * 9, "en", "s"), (None, "a b " * 9, "en", "s"), (4, "q" * 50_000 + " z" * 20, "en", "s")]
    got = sorted(map(str, periodic_runs.run_report(documents(spark, rows), tile).toLocalIterator()))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    from pyspark.sql import Row

    assert got == sorted(str(Row(**dict(zip(names, report_of(i, text), strict=True)))) for i, text, _, _ in rows)


def test_the_runs_of_plain_words_and_an_empty_table(spark):
    rows = [(1, "one two three four " * 4 + "five", "en", "s"), (2, "no runs here", "en", "s")]
    found = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.find_runs(documents(spark, rows)).collect()}
    assert found == {1: [(0, 4, 16)], 2: []}
    assert periodic_runs.run_report(empty(spark)).count() == 0
