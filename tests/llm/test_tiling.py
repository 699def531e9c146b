from __future__ import annotations

import random

import numpy as np
import pytest

from quotemill.llm import tiling
from tests.llm import plain
from tests.llm.edges import documents, empty


def brute_tiles(doc: list[str], item: list[str], size: int = 5) -> list[tuple[int, int, int]]:
    free_d, free_i, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and free_d[d + n] and free_i[i + n] and doc[d + n] == item[i + n]:
                    n += 1
                if n >= size and (best is None or n > best[2]):
                    best = (d, i, n)
        if best is None:
            return tiles
        tiles.append(best)
        for k in range(best[2]):
            free_d[best[0] + k] = free_i[best[1] + k] = False


def seeds(doc: list[str], item: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    pairs = [(d, i) for d in range(len(doc) - size + 1) for i in range(len(item) - size + 1) if doc[d : d + size] == item[i : i + size]]
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


def test_tiles_equal_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        item = [rng.choice("abcdefg") for _ in range(rng.randint(5, 40))]
        doc = [rng.choice("abcdefg") for _ in range(rng.randint(5, 20))]
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(len(item))
            doc += item[a : a + rng.randint(3, 15)]
        d, i = seeds(doc, item)
        assert tiling.greedy_tiles(d, i) == brute_tiles(doc, item) if len(d) else not brute_tiles(doc, item)


def test_words():
    for text in ("One, two-three; ÄÖ x9!", "", None, "a b\tc\n.d"):
        assert [w.decode() for w in tiling.words_of(text.encode() if text is not None else None)] == tiling.brute_force_words(text)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks_whole_reordered_and_partial(spark):
    words = [f"w{i}" for i in range(30)]
    item = " ".join(words)
    swapped = " ".join(words[15:] + ["filler", "words"] + words[:15])
    docs = [
        (1, f"before it {item} after", "en", "s"),
        (2, f"X {swapped.upper()}!", "en", "s"),
        (3, " ".join(words[:20]), "en", "s"),
        (4, "nothing of that sort is in here at all", "en", "s"),
        (5, None, "en", "s"),
        (None, item, "en", "s"),
        (1, f"before it {item} after", "en", "s"),
        (6, "w1 w2", "en", "s"),
    ]
    frame = documents(spark, docs)
    tests = bench(spark, [(7, item), (8, "w1 w2"), (9, None), (None, item), (10, "")])
    got = sorted((str(r.doc_id), r.item_id, r.coverage, r.n_tiles) for r in tiling.find_leaks(frame, tests).collect())
    assert got == [("1", 7, 1.0, 1), ("2", 7, 1.0, 2), ("6", 8, 1.0, 1), ("None", 7, 1.0, 1)]  # 6 is just the short item
    by_join = tiling.find_leaks(frame, tests, max_sent=3).collect()  # no hashes sent: a join alone
    assert sorted((str(r.doc_id), r.item_id, r.coverage, r.n_tiles) for r in by_join) == got
    kept = tiling.drop_leaks(frame, tests)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]


def test_empty_tables(spark):
    one = bench(spark, [(1, "a b c d e f")])
    assert tiling.find_leaks(empty(spark), one).count() == 0
    assert tiling.find_leaks(documents(spark), one.where("false")).count() == 0
    assert tiling.drop_leaks(documents(spark), one.where("false")).count() == documents(spark).count()


@pytest.mark.parametrize("sent", [tiling.MAX_SENT_SEEDS, 3])
def test_report_equals_brute_force(spark, sent):
    """Items share an opening that many documents have too; passages are whole, reordered, cut short, repeated and mixed."""
    rng = random.Random(11)
    opening = "which of the following is true of the".split()
    items = [(k, opening[: rng.randint(0, 8)] + [f"w{rng.randint(0, 25)}" for _ in range(rng.randint(1, 30))]) for k in range(14)]
    docs = []
    for i in range(90):
        words = [f"w{rng.randint(0, 25)}" for _ in range(rng.randint(0, 20))] + opening * rng.randint(0, 2)
        for _, item in rng.sample(items, rng.randint(0, 2)):
            cut = rng.randint(0, len(item))
            passage = rng.choice([item, item[cut:] + item[:cut], item[: cut + 3], item[1:], item + item])
            at = rng.randint(0, len(words))
            words = words[:at] + passage + words[at:]
        docs.append((i % 80, " ".join(words).replace(" w1 ", " W1, "), "en", "s"))
    docs += [(200 + k, " ".join(w).upper(), "en", "s") for k, w in items] + [(300, None, "en", "s"), (301, "", "en", "s"), docs[0]]
    tests = [(k, " ".join(w)) for k, w in items] + [(50, "w1 w2"), (51, None), (52, ""), (53, "w3")]
    docs += [(400, "W1 -- w2!", "en", "s"), (401, "w3 w3", "en", "s"), (402, "w3", "en", "s")]
    found = tiling.find_leaks(documents(spark, docs), bench(spark, tests), max_sent=sent).collect()
    got = [(r.doc_id, r.item_id, round(r.coverage, 9), r.n_tiles, r.longest) for r in found]
    want = plain.leaks(docs, tests, tiling.THRESHOLD)
    assert set(got) == want and len(want) > 40 and {(400, 50), (402, 53)} <= {(g[0], g[1]) for g in got}
