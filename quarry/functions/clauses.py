"""Clauses, negation, polarity, similarity of strings, and packing of salient paragraphs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Where sentences and coordinated clauses part, and what negates or hedges.
SENTENCE = r"(?i)(?<![0-9])(?<!\bInc)(?<!\bCorp)(?<!\bLtd)(?<!\bCo)(?<!\bSt)(?<!\bNo)[.!?]+\s+|;\s*|\r?\n+"
COORDINATION = (
    r"(?i),\s*(?:and|but|while|however|although|whereas|though)\b\s*|\s+\b(?:but|while|however|although|whereas)\b\s+|"
    r"\s+\band\b(?=\s+(?:expanded|expand|signed|terminated|ended|dissolved|entered|acquired|launched|built|reduced|cut|suspended|defaulted|increased|partnered|invested|licensed|avoided|maintained|continued|resumed|cancelled|canceled|grew|won)\b)\s*"
)
NEGATION = r"(?i)\b(?:not|no|never|avoided|avoiding|without|prevented|preventing|neither|nor|denied|unlikely\s+to|no\s+longer|failed\s+to|declined\s+to)\b"
HEDGE = r"(?i)\b(?:may\s+consider|may\s+from\s+time\s+to\s+time\s+consider|might\s+consider|might|evaluating|exploring(?:\s+the\s+possibility)?|preliminary\s+talks|if\s+market\s+conditions\s+warrant|conditional\s+upon|subject\s+to\s+customary\s+closing)\b"
# Triggers by polarity, gravest first.
POLARITY = (
    ("DISRUPTIVE_SHOCK", (r"defaulted", r"bankruptcy", r"chapter 11", r"emergency\s+shutdown", r"export\s+ban", r"trade\s+embargo", r"catastrophic", r"force\s+majeure", r"terminated\s+for\s+cause", r"breach\s+of\s+contract")),
    ("CONTRACTING_BEARISH", (r"cutbacks?", r"reduced\s+orders?", r"margin\s+compression", r"downgraded", r"canceled", r"lawsuit", r"contract\s+termination", r"investigation", r"delayed", r"dropped", r"loss\s+of\s+customer")),
    ("EXPANDING_BULLISH", (r"expand(?:s|ed|ing)?", r"multi-year\s+(?:deal|agreement|contract|partnership)", r"surged?", r"record\s+(?:revenue|volume|orders?|commitment)", r"partnership\s+expansion", r"awarded", r"joint\s+venture", r"strategic\s+(?:collaboration|agreement|partnership)", r"capacity\s+increase", r"sole\s+source\s+win", r"accelerat(?:es?|ed|ing)")),
)


def clauses(text: Column) -> Column:
    """Atomic clauses of a text in order; none of a blank one."""
    parts = F.flatten(F.transform(F.split(F.trim(text), SENTENCE), lambda s: F.split(s, COORDINATION)))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^[\s,;]+|[\s,;]+$", "")), lambda p: p != "")


def has_unnegated(text: Column, pattern: str, window: int = 60) -> Column:
    """Whether a clause holds a hit of the pattern with no negation among the ``window`` characters before that hit.

    Clauses are cut in the JVM; only texts with a hit at all go to Arrow batches, since the
    places of the hits are needed.
    """

    @F.pandas_udf("boolean")
    def free(parts: pd.Series) -> pd.Series:
        hit, negated = re.compile(pattern, re.I), re.compile(NEGATION)
        return pd.Series([p is not None and any(not negated.search(c, max(0, m.start() - window), m.start()) for c in p for m in hit.finditer(c)) for p in parts])

    return F.coalesce(free(F.when(text.rlike(f"(?i){pattern}"), clauses(text))), F.lit(False))


def polarity(text: Column, market: Column | None = None, relation: Column | None = None) -> Column:
    """Stated market view, then terminal relation, then the gravest unnegated trigger, else neutral."""
    out = F.lit("NEUTRAL_STABLE")
    for name, triggers in reversed(POLARITY):
        out = F.when(has_unnegated(text, "|".join(triggers)), name).otherwise(out)
    if relation is not None:
        out = F.when(F.upper(F.trim(relation)).isin("DEFAULTED_ON", "TERMINATED", "CONTRACT_TERMINATION"), "DISRUPTIVE_SHOCK").otherwise(out)
    return out if market is None else F.when(market.isin("NEUTRAL_STABLE", *[n for n, _ in POLARITY]), market).otherwise(out)


def is_hedged(text: Column) -> Column:
    return F.coalesce(text.rlike(HEDGE), F.lit(False))


def naming_clauses(text: Column, entities: Column) -> Column:
    """Clauses that hold an entity of two or more letters, or its first word of four or more letters as a word."""
    known = F.filter(F.transform(entities, lambda e: F.lower(F.trim(e))), lambda e: F.length(e) >= 2)
    head = lambda e: F.regexp_replace(F.split(e, r"\s+")[0], r"^[,.]+|[,.]+$", "")
    word = lambda c, h: F.concat(F.lit(" "), F.regexp_replace(c, r"[^\p{L}\p{N}_]", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.regexp_replace(h, r"[^\p{L}\p{N}_]", " "), F.lit(" ")))
    names = lambda c: F.exists(known, lambda e: c.contains(e) | ((F.length(head(e)) >= 4) & word(c, head(e))))
    return F.filter(clauses(text), lambda c: names(F.lower(c)))


def triple_hedged(prompt: Column, entities: Column, triple: Column) -> Column:
    """Hedged in itself, or in a clause that names an entity, or in the only clause."""
    cs, named = clauses(prompt), naming_clauses(prompt, entities)
    inside = F.when(F.size(named) > 0, F.exists(named, lambda c: c.rlike(HEDGE))).when(F.size(cs) == 1, F.exists(cs, lambda c: c.rlike(HEDGE))).otherwise(False)
    return is_hedged(triple) | F.coalesce(inside, F.lit(False))


def materiality(text: Column, relation: Column, provenance: Column, critical: tuple = ()) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    top = F.upper(F.trim(relation)).isin("SOLE_SOURCE_DEPENDENT_ON", "ACQUIRED_BY", "DEFAULTED_ON") | F.upper(F.coalesce(provenance, F.lit(""))).isin("SEC_EXHIBIT_21", "SEC_8K")
    for term in critical:
        top = top | low.contains(term)
    plain = F.lit(False)
    for term in ("routine supplier", "standard vendor", "off-the-shelf", "minor supply"):
        plain = plain | low.contains(term)
    return F.when(top, "CRITICAL_TIER_1").when(plain, "COMMODITY_TIER_3").otherwise("MATERIAL_TIER_2")


def first_class(text: Column, patterns: tuple) -> Column:
    """Name of the first pattern found, null without one."""
    out = F.lit(None).cast("string")
    for name, p in reversed(patterns):
        out = F.when(text.rlike(p), name).otherwise(out)
    return out


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity with prefix weight 0.1 up to four characters, always boosted; Arrow batches."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else _jw(s, t) for s, t in zip(x, y)])

    return run(a, b)


def _jw(s: str, t: str) -> float:
    if s == t:
        return 1.0
    if not s or not t:
        return 0.0
    reach = max(len(s), len(t)) // 2 - 1
    used = [False] * len(t)
    left = []
    for i, c in enumerate(s):
        for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
            if not used[j] and t[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, u in zip(t, used) if u]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(s) + m / len(t) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(s[:4], t[:4])) if x != y), min(4, len(s), len(t)))
    return jaro + prefix * 0.1 * (1 - jaro)


def salient_paragraphs(rows: DataFrame, key: str, text: str, terms: tuple, budget: int) -> DataFrame:
    """``(key, paragraphs)``: most term hits first, each taken if it still fits into ``budget`` characters, in text order."""
    pattern = "|".join(re.escape(t) for t in terms)
    paras = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != "")
    hits = F.transform(paras, lambda p, i: F.struct((-(F.size(F.split(F.lower(p), pattern)) - 1)).alias("h"), i.alias("i"), F.length(p).alias("n")))
    start = F.struct(F.lit(0).cast("int").alias("used"), F.array().cast("array<int>").alias("ids"))
    fold = F.aggregate(F.array_sort(hits), start, lambda acc, x: F.when(acc["used"] + x["n"] <= budget, F.struct((acc["used"] + x["n"]).cast("int").alias("used"), F.concat(acc["ids"], F.array(x["i"])).alias("ids"))).otherwise(acc))
    x = rows.select(key, paras.alias("p"), F.array_sort(fold["ids"]).alias("ids"))
    return x.select(key, F.transform("ids", lambda i: F.get("p", i)).alias("paragraphs"))
