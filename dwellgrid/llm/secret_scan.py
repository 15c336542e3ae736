"""Secret scan with a trigram inverted index, in DataFrame functions only.

1. Every rule's pattern is turned into a Boolean query of trigrams that each match must contain: exact strings of the
   pattern give conjunctions, alternatives disjunctions. Case is folded on both sides. A rule without mandatory trigrams
   (such as a run of hexadecimal digits) has no query and scans every text.
2. The index holds the postings (trigram, id) of all trigrams that any query mentions; other postings would never be
   read. Postings of an id are brought together, not those of a trigram, so a frequent trigram is no hot key, and
   intersecting them answers the queries: candidates (id, rules).
3. The rules are verified on the whole texts: a candidate's rules by their patterns, rules without a query on all texts.
   The candidate list is broadcast only if it has at most ``BROADCAST_IDS`` rows, otherwise it is joined by shuffle.

Spans are the leftmost non-overlapping matches per rule, in code points, end exclusive. A span starts where the split
pieces and matches before it end, so no position is searched twice.

Defined results: a null text is empty and has no spans; a match that fails the rule's minimum is dropped after it was
consumed; rows that repeat an id (or have none) may share postings and are then verified each on their own text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.session import cut_lineage

BROADCAST_IDS = 500_000
MAX_STRINGS = 64


@dataclass(frozen=True)
class SecretRule:
    """``group`` of a match must have ``least`` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: access and hex require their length in the pattern: a run that is long enough is matched whole, from its first
#: character, and a shorter one holds no other match, so the spans equal those of the open patterns with a filter.
RULES = (
    SecretRule(
        "assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6
    ),
    SecretRule("access", "AKIA[A-Z0-9]{16,}"),
    SecretRule("hex", "[0-9a-f]{24,}"),
)


# -- Boolean trigram queries ------------------------------------------------------------------------------------------
# A query is None (no condition) or nested tuples: ("tri", t), ("and", ...), ("or", ...).


def _all(parts: list) -> tuple | None:
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list) -> tuple | None:
    if not parts or any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> tuple | None:
    needs = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [n for n in needs if not any(other < n for other in needs)]  # the others follow from these
    return _any([_all([("tri", t) for t in sorted(n)]) for n in sorted(least, key=sorted)])


def _exact(op, arg) -> set[str] | None:
    """The few strings that a pattern part can match, None if not few."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 4:
        return {chr(c).lower() for _, c in arg}
    if op is sre.AT:
        return {""}
    if op is sre.SUBPATTERN:
        return _exact_sequence(arg[-1])
    if op is sre.BRANCH:
        options = [_exact_sequence(o) for o in arg[1]]
        return None if any(o is None for o in options) else set().union(*options)
    if op is sre.MAX_REPEAT and arg[1] <= 2:
        once = _exact_sequence(arg[2])
        if once is None:
            return None
        powers, now = set(), {""}
        for n in range(arg[1] + 1):
            powers |= now if n >= arg[0] else set()
            now = {a + b for a in now for b in once}
        return powers
    return None


def _exact_sequence(items) -> set[str] | None:
    strings = {""}
    for op, arg in items:
        some = _exact(op, arg)
        if some is None or len(strings) * len(some) > MAX_STRINGS:
            return None
        strings = {a + b for a in strings for b in some}
    return strings


def _of_sequence(items) -> tuple | None:
    found, strings = [], {""}
    for op, arg in items:
        some = _exact(op, arg)
        if some is not None and len(strings) * len(some) <= MAX_STRINGS:
            strings = {a + b for a in strings for b in some}
            continue
        found.append(_of_strings(strings))
        strings = some if some is not None and len(some) <= MAX_STRINGS else {""}
        if some is None:
            if op is sre.SUBPATTERN:
                found.append(_of_sequence(arg[-1]))
            elif op is sre.BRANCH:
                found.append(_any([_of_sequence(o) for o in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] >= 1:
                found.append(_of_sequence(arg[2]))
    return _all([*found, _of_strings(strings)])


def trigram_query(pattern: str) -> tuple | None:
    """Case-folded Boolean trigram query that every text with a match fulfils; None if there is none."""
    return _of_sequence(sre_parser.parse(pattern))


def trigrams_of(query: tuple | None) -> set[str]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams_of, query[1:]))


def fulfilled(query: tuple, found: Column) -> Column:
    """The query over an array of found trigrams."""
    if query[0] == "tri":
        return F.array_contains(found, query[1])
    parts = [fulfilled(q, found) for q in query[1:]]
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, parts)


# -- index and scan ---------------------------------------------------------------------------------------------------


def postings(docs: DataFrame, wanted: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """The inverted index (trigram, id) of the wanted trigrams over whole case-folded texts."""
    folded = F.lower(F.col(text_col))
    has = F.filter(F.array(*(F.when(F.contains(F.col("folded"), F.lit(t)), F.lit(t)) for t in wanted)), lambda t: t.isNotNull())
    return docs.select(F.col(id_col).alias("id"), folded.alias("folded")).select("id", F.explode(has).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, tuple]) -> DataFrame:
    """(id, rules): ids whose postings fulfil the queries of these rules."""
    found = index.groupBy("id").agg(F.collect_set("trigram").alias("found"))
    rules = F.array(*(F.when(fulfilled(q, F.col("found")), F.lit(kind)) for kind, q in queries.items()))
    return found.select("id", F.filter(rules, lambda r: r.isNotNull()).alias("rules")).where(F.size("rules") > 0)


def spans_of(text: Column, rule: SecretRule, place: int) -> Column:
    """Array of (start, place, kind, end) of a rule's matches; empty for a null text."""
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")
    pattern = F.lit(rule.pattern)
    parts = F.struct(
        F.split(text, rule.pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"),
        (F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.least else F.lit(None)).alias("values"),
    )

    def fold(p: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(p["gaps"][i])
            end = start + F.length(p["hits"][i])
            span = F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), end.alias("end"))
            fits = F.length(p["values"][i]) >= rule.least if rule.least else F.lit(True)
            kept = F.when(fits, F.array_append(state["spans"], span)).otherwise(state["spans"])
            return F.struct(end.alias("at"), kept.alias("spans"))

        start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(p["hits"]) - 1), start, step, lambda s: s["spans"])

    # the single-element array holds split and matches, so that they are computed once
    once = F.transform(F.array(parts), fold)[0]
    return F.when(text.rlike(rule.pattern), once).otherwise(none)


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[SecretRule] = RULES
) -> DataFrame:
    """Rows (id, found): all spans of every text by start, then by rule order; one row per input row."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if queries:
        wanted = sorted(set().union(*map(trigrams_of, queries.values())))
        listed = cut_lineage(candidates(postings(docs, wanted, id_col, text_col), queries)).withColumnRenamed("id", "c_id")
        small = listed.count() <= BROADCAST_IDS
        rows = rows.join(F.broadcast(listed) if small else listed, F.col("id").eqNullSafe(F.col("c_id")), "left")
    else:
        rows = rows.withColumn("rules", F.lit(None).cast("array<string>"))
    spans = []
    for place, rule in enumerate(rules):
        text = F.col("text")
        if rule.kind in queries:
            text = F.when(F.array_contains("rules", rule.kind), text)
        spans.append(spans_of(text, rule, place))
    return rows.select(F.col("id").alias(id_col), F.array_sort(F.concat(*spans)).alias("found"))


def span_digests(
    found: DataFrame, id_col: str = "doc_id", base: Sequence[SecretRule] = RULES
) -> DataFrame:
    """Rows (id, n_<kind> per base rule, base_sha256, spans) of the rows of ``find_secrets``."""
    kinds = [r.kind for r in base]

    def said(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(kind: str):
        return lambda s: s["kind"] == kind

    of_base = F.filter("found", lambda s: s["kind"].isin(*kinds))
    return found.select(
        id_col,
        *(F.size(F.filter("found", of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds),
        F.sha2(said(of_base), 256).alias("base_sha256"),
        said(F.col("found")).alias("spans"),
    )
