"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import SPACE, let, split_words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with is in it for on as was this are by "
    "der die und das ist nicht den von zu mit ein eine für auf dem sich "
    "le la les et de des un une est que en dans pour sur du qui "
    "el los las y se por con del al lo como para no su"
).split()
#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3


@dataclass(frozen=True)
class Threshold:
    """A document fails the rule when `metric` lies outside [low, high]; None leaves an end open."""

    rule: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are a share of the words or, for lines, of the lines with a word.
THRESHOLDS = (
    Threshold("too_short", "n_words", low=50),
    Threshold("too_repetitive", "repeat_ratio", high=0.5),
    Threshold("odd_word_length", "mean_word_chars", low=2, high=12),
    Threshold("too_many_symbols", "symbol_ratio", high=0.1),
    Threshold("too_many_repeated_lines", "dup_line_ratio", high=0.5),
    Threshold("no_stop_words", "stop_word_ratio", low=0.02),
)


def _repeat_words(words: Column) -> Column:
    """Words in windows of three words that stand twice or more in the text."""

    def covered(grams: Column) -> Column:
        placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(rows: Column) -> Column:
            def twice(x: Column, i: Column) -> Column:
                same = lambda j: F.coalesce(F.get(rows, j)["g"] == x["g"], F.lit(False))
                return same(i - 1) | same(i + 1)

            return F.array_sort(F.transform(F.filter(rows, twice), lambda x: x["i"]))

        def add(acc: Column, i: Column) -> Column:
            end = i + WINDOW
            return F.struct((acc["n"] + end - F.greatest(i, acc["end"])).cast("long").alias("n"), end.cast("int").alias("end"))

        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return let(placed, lambda rows: F.aggregate(starts(rows), none, add, lambda acc: acc["n"]))

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    zero = F.lit(0).cast("long")
    found = lambda w: let(windows(w), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), zero).otherwise(covered(g)))
    return let(words, lambda w: F.when(F.size(w) < WINDOW, zero).otherwise(found(w)))


def metrics_of(text: Column) -> Column:
    """A struct of the contract's counts and the table's ratios, as one expression.

    Words, lines and counts are bound once and used by name inside it. So nothing is counted twice,
    also where the optimizer moves a filter on the result below the projection that made it.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    is_stop = lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(STOP_WORDS)

    def counts(w: Column, ln: Column) -> Column:
        found = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
            "n_lines": F.size(ln),
            "n_dup_lines": F.size(ln) - F.size(F.array_distinct(ln)),
            "n_repeat_words": _repeat_words(w),
            "n_stop_words": F.size(F.filter(w, is_stop)),
        }
        return F.struct(*[c.cast("long").alias(k) for k, c in found.items()])

    def with_ratios(n: Column) -> Column:
        names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
        per_word, per_line = F.greatest(n["n_words"], F.lit(1)), F.greatest(n["n_lines"], F.lit(1))
        ratios = {
            "repeat_ratio": n["n_repeat_words"] / per_word,
            "mean_word_chars": n["word_chars"] / per_word,
            "symbol_ratio": n["n_symbols"] / per_word,
            "dup_line_ratio": n["n_dup_lines"] / per_line,
            "stop_word_ratio": n["n_stop_words"] / per_word,
        }
        return F.struct(*[n[k].alias(k) for k in names], *[c.alias(k) for k, c in ratios.items()])

    return let(split_words(text), lambda w: let(lines, lambda ln: let(counts(w, ln), with_ratios)))


def broken(rule: Threshold, metrics: Column) -> Column:
    """True where the metric lies outside the threshold; equality passes."""
    metric = metrics[rule.metric]
    low = metric < rule.low if rule.low is not None else F.lit(False)
    high = metric > rule.high if rule.high is not None else F.lit(False)
    return low | high


def base_failed(metrics: Column) -> Column:
    return (metrics["n_words"] < 50) | (100 * metrics["n_repeat_words"] > 50 * metrics["n_words"])


def judge(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS, text_col: str = "text") -> DataFrame:
    """`docs` with `__metrics`, `__failed` (names of broken rules), `__base_failed` and `__kept`.

    A null or empty text has no words, fails the length rule and isn't kept. Equality with a
    threshold passes. Repeated rows are judged each on their own, whatever their ids. An empty table
    gives an empty result. Other columns of `docs` pass through. Long texts are judged whole. No row
    is shuffled.
    """
    metrics = F.col("__metrics")
    failed = F.array_compact(F.array(*[F.when(broken(t, metrics), F.lit(t.rule)) for t in thresholds]))
    judged = docs.select("*", metrics_of(F.col(text_col)).alias("__metrics"))
    judged = judged.select("*", failed.alias("__failed"), base_failed(metrics).alias("__base_failed"))
    return judged.withColumn("__kept", ~F.col("__base_failed") & (F.size("__failed") == 0))


def quality_report(docs: DataFrame) -> DataFrame:
    judged = judge(docs.select("doc_id", "text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(
        "doc_id",
        *[F.col(f"__metrics.{c}").alias(c) for c in counts],
        F.col("__base_failed").alias("base_failed"),
        F.col("__kept").alias("kept"),
        F.array_join("__failed", ",").alias("failed_rules"),
    )


def keep_good(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that pass every rule, with their own columns; edge cases as in `judge`."""

    def passes(metrics: Column) -> Column:
        bad = base_failed(metrics)
        for t in thresholds:
            bad |= broken(t, metrics)
        return ~bad

    return docs.where(let(metrics_of(F.col(text_col)), passes))


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
ORACLE_SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
),
grams AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)
),
twice AS (
  SELECT r, unnest([i, i + 1, i + 2]) AS p
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM grams) WHERE n >= 2
),
rep AS (SELECT r, count(DISTINCT p) AS n FROM twice GROUP BY r),
m AS (
  SELECT base.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         len(l) AS n_lines,
         len(list_filter(w, lambda x: lower(regexp_replace(x, '[.,;:!?]+$', '')) IN ({_STOP_SQL}))) AS n_stop
  FROM base LEFT JOIN rep ON base.r = rep.r
),
rules AS (
  SELECT *, greatest(n_words, 1) AS d, greatest(n_lines, 1) AS dl,
         (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
),
named AS (
  SELECT *, array_to_string(list_filter([
    CASE WHEN n_words < 50 THEN 'too_short' END,
    CASE WHEN n_repeat_words / d > 0.5 THEN 'too_repetitive' END,
    CASE WHEN word_chars / d < 2 OR word_chars / d > 12 THEN 'odd_word_length' END,
    CASE WHEN CAST(n_symbols AS DOUBLE) / d > 0.1 THEN 'too_many_symbols' END,
    CASE WHEN CAST(n_dup_lines AS DOUBLE) / dl > 0.5 THEN 'too_many_repeated_lines' END,
    CASE WHEN CAST(n_stop AS DOUBLE) / d < 0.02 THEN 'no_stop_words' END], lambda x: x IS NOT NULL), ',') AS failed_rules FROM rules
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM named
"""
