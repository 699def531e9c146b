"""License scan by diagonal voting.

All rolling two-word grams of every text are joined to the positions of the same grams in the
templates. A hit votes for the diagonal (text position minus template position). Votes are counted
per diagonal, and each diagonal is merged with its neighbours further on (words inserted or left out) up
to GAP or a third of the template's grams, so a band is as long as its template and GAP words at most. A band with enough
different template positions is verified by its span: the longest run of hits that rises in the text
and in the template has to cover the share. The short phrases of the contract are templates too: such
a phrase stands where one exact diagonal holds all of its grams.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRAM, GAP, COVER = 2, 3, 0.82
#: The phrases and labels of the contract.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Openings of well-known licenses and notices, and their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("mozilla public license version 2 0", "mpl"),
    ("all rights reserved", "all-rights-reserved"),
)
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the lower-cased text.

    lower() maps letters to letters, so word boundaries are those of a text with A-Z lower-cased.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _grams(words: Column) -> Column:
    """The hash of each run of GRAM words; empty if there are fewer words."""
    at = F.sequence(F.lit(0), F.size(words) - GRAM)
    hashes = F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(GRAM))))
    return F.when(F.size(words) >= GRAM, hashes).otherwise(F.array().cast("array<bigint>"))


def template_positions(spark: SparkSession, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(template, label, is_phrase, n_grams, t_pos, gram, t_hash). Its size is that of the parameters."""
    rows = []
    for number, (text, label) in enumerate([*phrases, *templates]):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        grams = [words[i : i + GRAM] for i in range(len(words) - GRAM + 1)]
        rows += [(number, label, number < len(phrases), len(grams), i, g[0], g[1]) for i, g in enumerate(grams)]
    schema = "template int, label string, is_phrase boolean, n_grams int, t_pos int, w0 string, w1 string"
    return spark.createDataFrame(rows, schema).withColumn("t_hash", F.xxhash64("w0", "w1"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Works on whole texts. A null, empty or one-word text has no hit: counts 0, positions null,
    labels '' and score 0. `score` is the largest share of a template that a span covers, 1 where a
    phrase stands. `spans` lists (label, first word, last word, cover) of every verified band; spans may overlap. Repeated rows
    are judged each on their own. An empty table gives an empty result. Other columns of `docs` are
    not read.
    """
    positions = F.broadcast(template_positions(docs.sparkSession, templates, phrases))  # as many rows as the parameters have grams
    split = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words")
    )
    grams = split.select("row", "doc_id", "words", _grams(F.col("words")).alias("grams"))
    rolled = grams.select("row", "doc_id", "words", F.posexplode_outer("grams").alias("pos", "hash"))
    real = (F.get("words", F.col("pos")) == F.col("w0")) & (F.get("words", F.col("pos") + 1) == F.col("w1"))
    hits = rolled.join(positions, rolled["hash"] == positions["t_hash"], "left").where(
        "template is not null or pos = 0 or pos is null"
    )
    votes = hits.select(
        "row",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.when(real, F.col("template")).alias("template"),
        "label",
        "is_phrase",
        "n_grams",
        "pos",
        "t_pos",
        (F.col("pos") - F.col("t_pos")).alias("diagonal"),
    )
    key = ["row", "doc_id", "n_words", "template", "label", "is_phrase", "n_grams"]
    diagonals = votes.groupBy(*key, "diagonal").agg(F.collect_set("t_pos").alias("met"))
    ahead = W.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, GAP)
    drift = F.when(F.col("is_phrase"), 0).otherwise(F.least(F.lit(GAP), F.expr("n_grams div 3")))
    bands = diagonals.withColumn("ahead", F.collect_list(F.struct("diagonal", "met")).over(ahead)).withColumn("drift", drift)
    bands = bands.withColumn("band", F.filter("ahead", lambda b: b["diagonal"] <= F.col("diagonal") + F.col("drift")))
    enough = F.when(F.col("is_phrase"), F.col("n_grams")).otherwise(F.ceil(F.col("n_grams") * COVER - 1e-9))
    met = F.size(F.array_distinct(F.flatten(F.transform("band", lambda b: b["met"]))))
    run = F.when(F.col("template").isNotNull() & (met >= enough), rising_run(F.col("band")))
    judged = bands.select(*key, "diagonal", run.alias("run"), enough.alias("enough")).withColumn("true", F.coalesce(F.col("run.n") >= F.col("enough"), F.lit(False)))
    cover = F.col("run.n") / F.col("n_grams")
    base = F.col("true") & F.col("is_phrase")
    span = F.struct("label", F.col("run.first").alias("first_word"), (F.col("run.last") + GRAM - 1).alias("last_word"), cover.alias("cover"))
    return (
        judged.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count_if(base).cast("long").alias("n_base"),
            F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("true"), F.col("label")))), ",").alias("labels"),
            F.coalesce(F.max(F.when(F.col("true"), cover)), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_set(F.when(F.col("true"), span))).alias("spans"),
        )
        .drop("row")
    )


def rising_run(band: Column) -> Column:
    """(n, first, last) of the longest run of hits that rises in text and template; of equally long ones the one that starts last.

    band: (diagonal, met) of some neighbouring diagonals; a hit stands at diagonal + template position.
    """
    hits = F.flatten(F.transform(band, lambda b: F.transform(b["met"], lambda t: F.struct((b["diagonal"] + t).alias("pos"), t.alias("t")))))
    chain = lambda n, first, last, t: F.struct(n.cast("int").alias("n"), first.cast("int").alias("first"), last.cast("int").alias("last"), t.cast("int").alias("t"))

    def step(acc: Column, h: Column) -> Column:
        before = F.array_max(F.filter(acc, lambda c: (c["last"] < h["pos"]) & (c["t"] < h["t"])))
        longer = chain(F.coalesce(before["n"], F.lit(0)) + 1, F.coalesce(before["first"], h["pos"]), h["pos"], h["t"])
        return F.concat(acc, F.array(longer))

    none = F.array().cast("array<struct<n:int,first:int,last:int,t:int>>")
    return F.aggregate(F.array_sort(hits), none, step, lambda acc: F.array_max(acc))


def license_report(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs).drop("spans")


def _sql_list(items) -> str:
    rows = []
    for number, (text, label) in enumerate([*PHRASES, *TEMPLATES]):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        n = len(words) - GRAM + 1
        rows += [f"({number}, '{label}', {str(number < len(PHRASES)).lower()}, {n}, {i}, '{words[i]} {words[i + 1]}')" for i in range(n)]
    return ", ".join(rows)


ORACLE_SQL = rf"""
WITH RECURSIVE t(template, label, is_phrase, n_grams, t_pos, gram) AS (VALUES {_sql_list(None)}),
base AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
g AS (SELECT r, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM base)),
h AS (SELECT r, template, label, is_phrase, n_grams, pos, t_pos, pos - t_pos AS diagonal FROM g JOIN t USING (gram)),
d AS (SELECT DISTINCT r, template, label, is_phrase, n_grams, diagonal FROM h),
near AS (
  SELECT d.r, d.template, d.label, d.is_phrase, d.n_grams, d.diagonal AS start, h.pos, h.t_pos
  FROM d JOIN h ON h.r = d.r AND h.template = d.template AND h.diagonal BETWEEN d.diagonal AND d.diagonal + CASE WHEN d.is_phrase THEN 0 ELSE least({GAP}, d.n_grams // 3) END
),
likely AS (
  SELECT r, template, start FROM near GROUP BY r, template, start, is_phrase, n_grams
  HAVING count(DISTINCT t_pos) >= CASE WHEN is_phrase THEN n_grams ELSE ceil(n_grams * {COVER} - 1e-9) END
),
hit AS (SELECT near.* FROM near JOIN likely USING (r, template, start)),
chain AS (
  SELECT r, template, start, pos, t_pos, 1 AS n FROM hit
  UNION
  SELECT c.r, c.template, c.start, x.pos, x.t_pos, c.n + 1 FROM chain c JOIN hit x ON x.r = c.r AND x.template = c.template AND x.start = c.start AND x.pos > c.pos AND x.t_pos > c.t_pos
),
longest AS (SELECT r, template, start, max(n) AS met FROM chain GROUP BY 1, 2, 3),
v AS (
  SELECT d.r, label, is_phrase, start, CAST(met AS DOUBLE) / n_grams AS cover FROM longest JOIN d ON d.r = longest.r AND d.template = longest.template AND d.diagonal = longest.start
  WHERE met >= CASE WHEN is_phrase THEN n_grams ELSE ceil(n_grams * {COVER} - 1e-9) END
),
s AS (
  SELECT r, count(*) FILTER (WHERE is_phrase) AS n_base, min(start) FILTER (WHERE is_phrase) AS first_word, max(start) FILTER (WHERE is_phrase) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         max(cover) AS score
  FROM v GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM base LEFT JOIN s ON base.r = s.r
"""
