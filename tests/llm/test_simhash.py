from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quotemill.llm import simhash
from quotemill.llm.components import connected_components
from tests.llm.edges import TEXTS, documents, empty


def brute_print(text: str | None) -> int:
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids: list, prints: list[int]) -> list:
    roots = list(range(len(prints)))

    def find(x: int) -> int:
        while roots[x] != x:
            x = roots[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                roots[max(a, b)] = min(a, b)
    found = [find(i) for i in range(len(prints))]
    least = {r: min((ids[i] for i in range(len(ids)) if found[i] == r and ids[i] is not None), default=None) for r in set(found)}
    return [least[r] for r in found]


def test_fingerprints_are_the_contracts(spark):
    texts = ["", "one", "One two", "one two three", "a b c d e", "Ä b ä c É d", "x y z x y z x y z", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.with_fingerprints(frame).collect()}
    assert got == {i: brute_print(t) for i, t in enumerate(texts)}
    one = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got[3] == one & (1 << 64) - 1


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40, np.int64)]
    prints = []
    for b in base:  # chains and stars around each base
        x = b
        for _ in range(int(rng.integers(1, 12))):
            prints.append(x)
            for bit in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                x ^= 1 << int(bit)
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in (p & (1 << 64) - 1 for p in prints)})
    frame = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(5)
    for chunk in (512, 3):  # 3: every bucket is dealt over pairs of chunks
        groups = {r.node: r.component for r in connected_components(simhash.fingerprint_links(frame, chunk)).collect()}
        unsigned = [p & (1 << 64) - 1 for p in signed]
        want = brute_components(list(range(len(signed))), unsigned)
        for i, p in enumerate(signed):
            assert groups.get(p, p) == signed[want[i]]


def test_edges(spark):
    got = simhash.near_duplicates(documents(spark)).collect()
    ids, prints = [r[0] for r in TEXTS], [brute_print(r[1]) for r in TEXTS]
    want = sorted(map(str, zip(ids, prints, brute_components(ids, prints), strict=True)))
    assert sorted(str((r.doc_id, r.fp & (1 << 64) - 1, r.component_id)) for r in got) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(None) == 2
    assert 3 in ids and 4 not in ids and 5 not in ids  # wordless texts are one group


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a b c d", "en", "s"), (1, "a b c d", "en", "s"), (2, "totally other words here", "en", "s")]
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(documents(spark, rows)).collect()) == [1, 2]


def test_a_dense_group_makes_few_links(spark):
    prints = [(sum(1 << b for b in range(20) if i >> b & 1),) for i in range(3000)]
    links = simhash.fingerprint_links(spark.createDataFrame(prints, "fp long"))
    assert links.distinct().count() < 20 * 3000
    assert connected_components(links).select("component").distinct().count() == 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
