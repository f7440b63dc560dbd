"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule gives a Boolean column that is true where a document fails, from measures of the text.  Cost and selectivity of
every rule are measured on a bounded sample; the cascade then asks the rules in descending order of rejections per cost,
and a document that one rule rejects is not shown to the rest.  The order changes the work, never the verdict.

``verdicts`` is the cascade alone: a measure is computed inside the rule that asks for it, so a rejected document is spared
the measures of all later rules.  ``quality_rules`` also returns the measures, and computes them for every document.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SEP, documents, let, words

#: Rows at most on which the rules' costs and selectivities are measured.
SAMPLE_ROWS = 2000
#: Timed runs of each rule, and the least cost that they can tell from none.
RUNS, LEAST_SECONDS = 3, 1e-3
WINDOW = 8


def repeat_words(w: Column, n: int = WINDOW) -> Column:
    """Words inside n-word windows that occur at least twice in the array of words, the first ones included."""

    def covered(g: Column) -> Column:
        def positions(s: Column) -> Column:
            same = lambda j: (F.get(s, j - 1)["g"] == F.get(s, j)["g"]) | (F.get(s, j + 1)["g"] == F.get(s, j)["g"])
            at = F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(same(j), F.lit(False))), lambda j: F.get(s, j)["i"])
            start = F.struct(F.lit(-n).alias("last"), F.lit(0).alias("total"))
            step = lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(n), p - a["last"])).alias("total"))
            return F.aggregate(F.sort_array(at), start, step, lambda a: a["total"])

        by_hash = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(by_hash, positions))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))

    counted = let(let(F.transform(w, lambda x: F.xxhash64(x)), windows), covered)
    return F.when(F.size(w) < n, F.lit(0)).otherwise(counted).cast("bigint")


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs`` with the counts that the rules read: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A null text counts as empty and has all counts 0.  Only the columns ``keep`` (doc_id by default) and text are kept.
    """
    d = docs.select(*(keep or ("doc_id",)), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("_w", words(F.col("text"))).withColumn("_lines", worded_lines(F.col("text")))
    of = measures(F.col("text"), F.col("_w"), F.col("_lines"))
    return d.select(*(keep or ("doc_id",)), "text", *[value.alias(name) for name, value in of.items()])


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def measures(text: Column, w: Column, lines: Column) -> dict[str, Column]:
    """What rules read, by name, from a text, its words and its lines with words."""
    found = {
        "n_words": F.size(w), "word_chars": F.char_length(F.regexp_replace(text, WORD_SEP, "")), "n_symbols": F.size(F.split(text, "[#*$%&|<>]")) - 1,
        "n_lines": F.size(lines), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": repeat_words(w),
    }
    return {name: value.cast("bigint") for name, value in found.items()}


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: Gives the column of a measure, or of the text, by name.
Get = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    name: str
    test: Callable[[Get], Column]

    @property
    def fails(self) -> Column:
        """Over what ``measured`` gives."""
        return self.test(F.col)


def base_rules() -> list[Rule]:
    """The two parts of ``base_failed`` as rules."""
    return [Rule("few_words", lambda m: m("n_words") < 20), Rule("repeats", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words"))]


def default_rules() -> list[Rule]:
    """Rules in whole numbers, so that every engine agrees on them."""
    number = lambda text, characters: F.size(F.split(text, characters)) - 1
    return [
        Rule("symbols", lambda m: 100 * m("n_symbols") > 10 * m("n_words")),
        Rule("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
        Rule("long_words", lambda m: m("word_chars") > 20 * m("n_words")),
        Rule("dup_lines", lambda m: 100 * m("n_dup_lines") > 30 * m("n_lines")),
        Rule("upper_case", lambda m: 100 * number(m("text"), "[A-Z]") > 40 * m("word_chars")),
        Rule("exclamations", lambda m: 100 * number(m("text"), "!") > 25 * m("n_words")),
        Rule("digits", lambda m: 100 * number(m("text"), "[0-9]") > 30 * m("word_chars")),
    ]


def inline(text: Column) -> Get:
    """Measures as expressions over the text itself, each computed where a rule asks for it."""
    of = measures(text, words(text), worded_lines(text)) | {"text": text}
    return lambda name: of[name] if name in of else F.col(name)


#: The default rules in SQL.
RULES_SQL = (
    "100 * n_symbols > 10 * n_words",
    "word_chars < 2 * n_words",
    "word_chars > 20 * n_words",
    "100 * n_dup_lines > 30 * n_lines",
    "100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 40 * word_chars",
    "100 * len(regexp_replace(text, '[^!]', '', 'g')) > 25 * n_words",
    "100 * len(regexp_replace(text, '[^0-9]', '', 'g')) > 30 * word_chars",
)


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        """Rejections per cost.  Costs count in powers of two, as timings are no finer: noise seldom changes the order."""
        return self.rejected / 2.0 ** round(math.log2(max(self.seconds, LEAST_SECONDS)))


def estimate(rows: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, get: Get = F.col) -> list[Estimate]:
    """Seconds and share of rejections of each rule on a sample of at most ``sample_rows`` rows of ``rows``.

    A rule's seconds are the least of RUNS runs, taken in turns with an idle one.
    """
    n = rows.count()
    part = rows.sample(fraction=min(1.0, 0.8 * sample_rows / max(1, n)), seed=7).limit(sample_rows).cache()
    try:
        size = max(1, part.count())

        def timed(what: Column) -> tuple[float, int]:
            began = time.perf_counter()
            (found,) = part.agg(what).first()
            return time.perf_counter() - began, found

        asked = {"": F.count(F.lit(1))} | {rule.name: F.count_if(rule.test(get)) for rule in rules}
        runs = [{name: timed(what) for name, what in asked.items()} for _ in range(RUNS)]
        least = {name: min(run[name][0] for run in runs) for name in asked}
        return [Estimate(rule.name, max(LEAST_SECONDS, least[rule.name] - least[""]), runs[0][rule.name][1] / size) for rule in rules]
    finally:
        part.unpersist()


def ordered(rules: list[Rule], estimates: list[Estimate]) -> list[Rule]:
    worth = {e.name: e.worth for e in estimates}
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def rejected_by(rules: list[Rule], get: Get = F.col) -> Column:
    """Name of the first rule, in the given order, that a row fails; null where it passes all.  Later ones aren't asked."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.test(get), F.lit(rule.name)).otherwise(verdict)
    return verdict


def sampled(docs: DataFrame) -> DataFrame:
    n = docs.count()
    return docs.sample(fraction=min(1.0, 0.8 * SAMPLE_ROWS / max(1, n)), seed=7).limit(SAMPLE_ROWS)


def verdicts(docs: DataFrame, rules: list[Rule] | None = None, name: str = "rejected_by") -> DataFrame:
    """``docs`` with the name of the rule that rejects each document, null where it passes the base rules and ``rules``.

    Null and empty texts have too few words; repeated rows are judged one by one; an empty table gives no rows.  A column
    of that name is replaced.  A rule may also read columns of ``docs``.
    """
    rules = [*base_rules(), *(rules or default_rules())]
    docs = docs.drop(name)
    get = inline(F.coalesce("text", F.lit("")))
    order = ordered(rules, estimate(sampled(docs), rules, get=get))
    return docs.withColumn(name, rejected_by(order, get))


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row for each document: the counts, base_failed, kept, and in ``rejected_by`` the rule that rejected it.

    Documents without words fail.  Repeated rows are judged one by one; an empty table gives no rows.
    """
    rules = rules or default_rules()
    order = ordered(rules, estimate(measured(sampled(docs.select("doc_id", "text"))), rules))
    rows = measured(docs).withColumn("base_failed", base_failed())
    verdict = F.when(F.col("base_failed"), F.lit("base")).otherwise(rejected_by(order))
    return rows.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull()).drop("text", "n_lines")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    failing = " OR ".join(f"({r})" for r in RULES_SQL)
    return f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS row_nr, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_nr, doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT row_nr, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT row_nr, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT row_nr, i FROM (SELECT row_nr, i, count(*) OVER (PARTITION BY row_nr, win) AS n FROM g) WHERE n > 1),
c AS (SELECT row_nr, count(DISTINCT j) AS n_repeat_words FROM (SELECT row_nr, unnest(generate_series(i, i + 7)) AS j FROM r) GROUP BY row_nr),
m AS (SELECT doc_id, text, len(ws) AS n_words, len(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
             len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN c USING (row_nr)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR {failing}) AS kept FROM b
"""


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES = {"op6_quality_rules": oracle()}
