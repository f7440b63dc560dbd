"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regular expression follows a Boolean query over trigrams that any match must contain.  The index lists,
for each trigram that some rule asks for, the documents that have it; intersecting these postings gives each rule's
candidate documents, and only those are shown to its expression.  A rule without mandatory trigrams scans all documents.
The index holds lower-cased text, so one query serves expressions of either case; verification is exact.
"""

from __future__ import annotations

import re._constants as C
import re._parser as regex_parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let

Query = tuple  # ("all",) | ("tri", str) | ("and", *queries) | ("or", *queries)
ALL: Query = ("all",)
#: Strings at most that one stretch of an expression is spelled out into.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0
    """Matches whose group is shorter are dropped."""


#: The base kinds.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Further kinds, formats that their issuers document publicly.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + MORE


# ---- from an expression to its trigram query


def both(a: Query, b: Query) -> Query:
    return b if a == ALL else a if b == ALL or a == b else ("and", a, b)


def spelled(strings: set[str]) -> Query:
    """What a text that contains one of the strings must contain."""
    if any(len(s) < 3 for s in strings):
        return ALL
    of = [reduce(both, [("tri", t) for t in sorted({s[i : i + 3] for i in range(len(s) - 2)})]) for s in sorted(strings)]
    return of[0] if len(of) == 1 else ("or", *of)


def letters(items) -> set[str] | None:
    """The lower-cased characters of a small character class; None for large or negated ones."""
    found: set[str] = set()
    for op, x in items:
        if op is C.LITERAL:
            found.add(chr(x).lower())
        elif op is C.RANGE and x[1] - x[0] < 8:
            found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def strings_of(op, x) -> set[str] | None:
    """All lower-cased strings that a part of an expression matches, if they are few."""
    if op is C.LITERAL:
        return {chr(x).lower()}
    if op is C.IN:
        return letters(x)
    if op is C.SUBPATTERN:
        return joined(x[3])
    if op is C.BRANCH:
        parts = [joined(b) for b in x[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and x[1] != C.MAXREPEAT and x[1] <= 8:
        one = joined(x[2])
        if one is None or sum(len(one) ** k for k in range(x[0], x[1] + 1)) > MOST_STRINGS:
            return None
        return {"".join(p) for k in range(x[0], x[1] + 1) for p in product(one, repeat=k)}
    return {""} if op is C.AT else None


def joined(sequence) -> set[str] | None:
    run = {""}
    for op, x in sequence:
        if (part := strings_of(op, x)) is None or len(run) * len(part) > MOST_STRINGS:
            return None
        run = {a + b for a in run for b in part}
    return run


def query_of(sequence) -> Query:
    """The query of a sequence: every spelled-out stretch, and what its other mandatory parts ask for."""
    query, run = ALL, {""}
    for op, x in sequence:
        part = strings_of(op, x)
        if part is not None and len(run) * len(part) <= MOST_STRINGS:
            run = {a + b for a in run for b in part}
            continue
        query, run = both(query, spelled(run)), part if part is not None else {""}
        if part is None:
            if op is C.SUBPATTERN:
                query = both(query, query_of(x[3]))
            elif op is C.BRANCH:
                query = both(query, either([query_of(b) for b in x[1]]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and x[0] > 0:
                query = both(query, query_of(x[2]))
    return both(query, spelled(run))


def either(queries: list[Query]) -> Query:
    return ALL if ALL in queries else ("or", *queries)


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every text with a match of ``pattern`` fulfils; ALL if nothing is mandatory."""
    return query_of(list(regex_parser.parse(pattern)))


def trigrams_of(query: Query) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(set(), *[trigrams_of(q) for q in query[1:]])


# ---- index and search


def keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """doc_id, text, the columns ``keep`` and the key that tells rows apart, also where ids repeat or are null."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), *keep).withColumn("__key", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")))


def build_index(keyed_docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, __key): for each of the trigrams the documents whose lower-cased text has it."""
    lower = F.lower("text")
    has = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("__lower"), t))
    return keyed_docs.withColumn("__lower", lower).select("__key", F.explode(has).alias("trigram"))


def search(postings: DataFrame, asked: dict[str, Query]) -> DataFrame:
    """(__key, __kinds): the documents that fulfil some of the queries, and which.  Postings meet by document."""

    def holds(q: Query) -> Column:
        if q[0] == "tri":
            return F.array_contains("_has", q[1])
        parts = [holds(x) for x in q[1:]]
        return reduce((lambda a, b: a & b) if q[0] == "and" else (lambda a, b: a | b), parts)

    # a document has at most as many postings here as the rules have trigrams
    sets = postings.groupBy("__key").agg(F.collect_set("trigram").alias("_has"))
    kinds = F.array_compact(F.array(*[F.when(holds(q), F.lit(kind)) for kind, q in asked.items()]))
    return sets.select("__key", kinds.alias("__kinds")).filter(F.size("__kinds") > 0)


def located(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start,rank,kind,end>> of a rule's matches, leftmost first, without those that are too short.

    Positions are in code points.  What lies between the matches and the matches themselves give them as running sums.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    found = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"

    def walk(parts: Column) -> Column:
        between, whole, part = parts["between"], parts["whole"], parts["part"]

        def step(a: Column, i: Column) -> Column:
            start = a["at"] + F.char_length(F.get(between, i))
            end = start + F.char_length(F.get(whole, i))
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
            fits = F.char_length(F.get(part, i)) >= rule.at_least
            return F.struct(end.alias("at"), F.when(fits, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(found).alias("out"))
        walked = F.aggregate(F.sequence(F.lit(0), F.size(whole) - 1), zero, step, lambda a: a["out"])
        return F.when(F.size(whole) == 0, F.array().cast(found)).otherwise(walked)

    all_parts = F.struct(F.split(text, rule.pattern, -1).alias("between"), matches.alias("whole"), groups.alias("part"))
    return let(all_parts, walk)


def scan_pattern(rule: Rule) -> Rule:
    """A plain run of one class that must have n characters is sought as such: the same matches, without the short ones."""
    tree = list(regex_parser.parse(rule.pattern))
    single = len(tree) == 1 and tree[0][0] is C.MAX_REPEAT and tree[0][1][0] == 1 and tree[0][1][1] == C.MAXREPEAT and not rule.group
    return Rule(rule.kind, rule.pattern[:-1] + f"{{{rule.at_least},}}", 0, 0) if single and rule.at_least else rule


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Every row of ``docs`` as doc_id, text (null as empty), ``keep`` and ``spans``: sorted structs (start, rank, kind, end).

    Rows with equal ids or texts are told apart or give equal spans; an empty table gives no rows.
    """
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ALL}
    keep = [c for c in keep if c != "spans"]
    rows = keyed(docs, keep)
    if asked:
        postings = build_index(rows, sorted(set().union(*map(trigrams_of, asked.values()))))
        found = search(postings, asked).withColumnRenamed("__key", "__found")
        rows = rows.join(found, rows["__key"].eqNullSafe(found["__found"]), "left")
    else:
        rows = rows.withColumn("__kinds", F.array().cast("array<string>"))
    nothing = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    text = F.col("text")
    spans = []
    for rank, rule in enumerate(rules):
        if rule.kind in asked:
            spans.append(F.when(F.array_contains("__kinds", rule.kind), located(text, rule, rank)).otherwise(nothing))
        else:
            spans.append(F.when(text.rlike(scan_pattern(rule).pattern), located(text, scan_pattern(rule), rank)).otherwise(nothing))
    return rows.select("doc_id", "text", *keep, F.sort_array(F.concat(*spans)).alias("spans"))


def spelled_out(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every maximal stretch covered by sorted spans replaced by ``mark``."""

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        between = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], between, F.lit(mark))).otherwise(a["out"]).alias("out"))

    rest = lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.char_length(text)))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, zero, step, rest))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(documents(spark, sf_dir))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return out.select(
        "doc_id", *[number(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(spelled_out(base), 256).alias("base_sha256"), spelled_out(F.col("spans")).alias("spans")
    )


QUERIES = {"op4_secret_scans": op4_secret_scans}
