"""Operators whose result SQL states: equal on rows that are null, empty, long, repeated or odd."""

from __future__ import annotations

import random

import duckdb
import pytest

from quotemill.llm import license_scan, line_dedup, mixing, quality, url_filter
from tests.llm import plain as brute
from tests.llm.edges import documents, empty

URLS = [
    (1, "http://example.net/en/a"),
    (2, "https://Sub.EXAMPLE.net/EN/a?x=/en/"),
    (3, "http://other.net"),
    (4, "http://other.net/"),
    (5, "ftp://example.com/de/x/y#z"),
    (6, "http://badexample.com/de/"),
    (7, "http://a.b.org/fr/"),
    (8, "http://org/fr"),
    (9, None),
    (10, "no scheme here /net/"),
    (11, "://net/x"),
    (12, "http://net?x"),
    (13, "http://" + "a." * 300 + "net/" + "b/" * 3000),
    (None, "http://x.org/fr/a://b.net/"),
    (14, "http://example.net:80/en/"),
    (14, "http://example.net:80/en/"),
    (15, "http://ÄÖ.net/\n/x"),
    (16, ""),
]


def plain(rows) -> list[str]:
    return sorted(str([None if v is None else (round(v, 9) if isinstance(v, float) else v) for v in r]) for r in rows)


def sql_rows(sql: str, columns: list[str], **tables) -> list:
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toArrow())
    found = con.sql(sql)
    at = [found.columns.index(c) for c in columns]
    return [tuple(r[i] for i in at) for r in found.fetchall()]


@pytest.mark.parametrize(
    ("report", "sql"),
    [
        (license_scan.license_report, license_scan.ORACLE_SQL),
        (quality.quality_report, quality.ORACLE_SQL),
        (line_dedup.line_dedup_report, line_dedup.ORACLE_SQL),
        (mixing.mix_sources, mixing.ORACLE_SQL),
    ],
)
def test_documents(spark, report, sql):
    docs = documents(spark)
    got = report(docs)
    tables = docs.select("doc_id", "text", "lang", "source")
    assert plain(got.collect()) == plain(sql_rows(sql, got.columns, documents=tables))
    assert report(empty(spark)).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(*r, "x", "x") for r in URLS], "page_id long, url string, host string, rule string")
    got = url_filter.judge_urls(pages, url_filter.rule_table(spark))
    assert plain(got.collect()) == plain(sql_rows(url_filter.ORACLE_SQL, got.columns, pages=pages))
    assert url_filter.judge_urls(pages.where("false"), url_filter.rule_table(spark)).count() == 0
    none = url_filter.judge_urls(pages, url_filter.rule_table(spark).where("false"), "block").collect()
    assert {r.verdict for r in none} == {"block"} and len(none) == len(URLS)


def test_rules_are_joined_when_there_are_many(spark, monkeypatch):
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    want = plain(url_filter.judge_urls(pages, url_filter.rule_table(spark)).collect())
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", 1)
    assert plain(url_filter.judge_urls(pages, url_filter.rule_table(spark)).collect()) == want
    with pytest.raises(ValueError, match="slash"):
        url_filter.judge_urls(pages, url_filter.rule_table(spark, [("net", "/x", "block")]))


def test_kept_rows_have_the_columns_of_docs(spark):
    docs = documents(spark)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    judged = {str(r.doc_id): r.kept for r in quality.quality_report(docs).collect() if r.doc_id is not None}
    assert {str(r.doc_id) for r in kept.collect() if r.doc_id is not None} == {k for k, v in judged.items() if v}


def test_license_words_may_be_missing_or_added(spark):
    rows = [
        (1, "permission is hereby granted free of charge to any other person obtaining a copy of this software and documentation files", "en", "s"),
        (2, "permission is granted", "en", "s"),
        (3, "apache license apache license", "en", "s"),
        (4, "Licensed under CC BY-NC 4.0.", "en", "s"),
        (5, "Licensed under the Apache License, Version 2.0.", "fr", "s"),
    ]
    got = {r.doc_id: r for r in license_scan.scan_licenses(documents(spark, rows)).collect()}
    assert got[1].labels == "mit" and got[1].n_base == 0 and 0.82 <= got[1].score < 1
    assert got[2].labels == "" and got[2].score == 0
    assert (got[3].n_base, got[3].first_word, got[3].last_word) == (2, 0, 2)
    assert (got[4].labels, got[4].n_base, got[4].score) == ("cc-by-nc", 0, 1)
    assert (got[5].labels, got[5].base_labels, got[5].n_base, got[5].first_word) == ("apache", "apache", 1, 3)


def test_shortages_go_to_siblings_first(spark):
    rows = [(i, "w " * 100, lang, source) for i, (lang, source) in enumerate([("en", "s0"), ("en", "s4"), ("en", "s4"), ("en", "s4"), ("de", "s0"), ("de", "s0")])]
    mix = mixing.Mix(budget_percent=50, max_epochs=1, weights=({"web": 1}, {"en": 2, "de": 1}, {}))
    docs = documents(spark, rows)
    from quotemill.llm.mixing import LEVELS, _rows, leaf_budgets

    parts = {(r[LEVELS[1]], r[LEVELS[2]]): int(r.part) for r in leaf_budgets(docs.select(*_rows(docs, "doc_id", "text", "lang", "source")), mix).collect()}
    assert parts == {("en", "s0"): 100, ("en", "s4"): 100, ("de", "s0"): 100}
    mix = mixing.Mix(budget_percent=75, max_epochs=1, weights=({"web": 1}, {"en": 2, "de": 1}, {}))
    parts = {(r[LEVELS[1]], r[LEVELS[2]]): int(r.part) for r in leaf_budgets(docs.select(*_rows(docs, "doc_id", "text", "lang", "source")), mix).collect()}
    assert parts == {("en", "s0"): 100, ("en", "s4"): 200, ("de", "s0"): 150}  # s0 is full, its rest goes to s4


def test_taken_rows_repeat_and_keep_their_columns(spark):
    docs = documents(spark)
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns
    copies = {}
    for r in mixing.mix_sources(docs).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    found = {}
    for r in taken.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == copies


def test_scattered_words_are_no_license(spark):
    rows = [
        (1, "all rights x " * 100 + "rights reserved", "en", "s"),
        (2, "mozilla public a b public license a b license version 2 a b version 2 0", "en", "s"),
        (3, "reserved rights all. version 2 0 license public mozilla", "en", "s"),
        (4, "x y Mozilla Public License, Version 2.0 and all rights are reserved", "en", "s"),
        (5, "reserved all rights " * 50, "en", "s"),
    ]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert [got[i].labels for i in (1, 2, 3)] == ["", "", ""]
    assert got[4].labels == "mpl" and [tuple(s) for s in got[4].spans] == [("mpl", 2, 7, 1.0)]
    assert got[5].labels == "all-rights-reserved" and all(s.last_word - s.first_word == 2 for s in got[5].spans)
    report = license_scan.license_report(docs)
    assert plain(report.collect()) == plain(sql_rows(license_scan.ORACLE_SQL, report.columns, documents=docs.select("doc_id", "text")))


def test_lines_of_rows_without_an_id(spark):
    """Each text is a document of its own; of two, the one with the smaller hash keeps the line."""
    shared = "a line that is shared by all of them"
    rows = [(None, f"{shared}\nown {i % 7}", "en", "s") for i in range(30)] + [(5, f"first\n{shared}", "en", "s"), (9, shared, "en", "s"), (9, f"x\n{shared}", "en", "s")]
    docs = documents(spark, rows)
    kept = line_dedup.drop_duplicate_lines(docs).collect()
    assert sorted(r.text for r in kept if r.doc_id is None) == sorted(f"own {i % 7}" for i in range(30))
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None) == [(5, f"first\n{shared}"), (9, ""), (9, "x")]
    alone = docs.where("doc_id is null")
    assert sum(shared in r.text for r in line_dedup.drop_duplicate_lines(alone).collect()) in (4, 5)  # the rows of one text
    report = line_dedup.line_dedup_report(alone)
    assert plain(report.collect()) == plain(sql_rows(line_dedup.ORACLE_SQL, report.columns, documents=alone.select("doc_id", "text")))


@pytest.mark.parametrize("mix", [mixing.Mix(), mixing.Mix(budget_percent=60, max_epochs=1), mixing.Mix(budget_percent=150, weights=({"web": 0, "news": 3}, {"en": 7}, {"src3": 50}), default=2, seed=3)])
def test_the_mix_equals_iterative_water_filling(spark, mix):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice((0, 1, 5, 40, 300)), rng.choice(("en", "en", "de", "xx", None)), rng.choice(("src1", "src2", "src3", "src6", "odd", None))) for i in range(150)]
    got = {r.doc_id: r.copies for r in mixing.mix_sources(documents(spark, rows), mix).collect()}
    assert got == brute.mixed(rows, mix) and len(got) > 40
