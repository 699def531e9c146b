"""The filter audit against plain Python, order by order and document by document."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

from quotemill.llm import filter_audit
from tests.llm.edges import documents, empty
from tests.llm.test_against_sql import plain, sql_rows


def by_hand(rows, labels) -> dict:
    smallest = {}
    for i, text, _, _ in rows:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    out = {}
    for i, text, _, part in rows:
        text, part = text or "", part or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(set(text) & set("#$%&*|")),
            "E": i is not None and i > smallest[text],
        }
        for order in permutations("ABCDE"):
            gone = False
            for step, x in enumerate(order, 1):
                c = out.setdefault((part, "".join(order), step), Counter())
                now = fails[x] and not gone
                c["kept"] += not gone and not fails[x]
                c["removed"] += now
                c["redundant"] += fails[x] and gone
                c["unique_fails"] += fails[x] and sum(fails.values()) == 1
                c["good_lost"] += now and i in good
                c["toxic_lost"] += now and i in toxic
                gone |= fails[x]
    total = Counter()
    for (part, order, step), c in out.items():
        total[part, order[step - 1]] += c["removed"]
    return {k: tuple(c[x] for x in filter_audit.COUNTS) + (total[k[0], k[1][k[2] - 1]],) for k, c in out.items()}


def test_every_order_and_step(spark):
    rng = random.Random(1)
    texts = ["Alpha $ beta", "x " * 250, " ".join(f"w{i}" for i in range(210)), "", None, "WORDS " * 300 + "#", " ".join(f"v{i}" for i in range(400)) + " é|"]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), "en", rng.choice(["s1", "s2", "", None])) for _ in range(120)]
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [None, *range(0, 40, 2), 4, 6, 99]]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(*m, "x", "x") for m in marks], "doc_id long, quality int, toxic int, part string, n string")
    got = filter_audit.filter_audit(docs, labels)
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*filter_audit.COUNTS, "shapley")) for r in got.collect()}
    assert found == by_hand(rows, marks) and len(found) == 3 * 600
    assert plain(got.collect()) == plain(sql_rows(filter_audit.ORACLE_SQL, got.columns, documents=docs.select("doc_id", "text", "source"), labels=labels))


def test_edges_and_empty_tables(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs, labels)
    assert plain(got.collect()) == plain(sql_rows(filter_audit.ORACLE_SQL, got.columns, documents=docs.select("doc_id", "text", "source"), labels=labels))
    assert filter_audit.filter_audit(empty(spark), labels).count() == 0
