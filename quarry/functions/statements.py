"""Statements of the graph query language: triples in them, guard, temporal rewrite; and answers of models."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

# What a read-only statement may not hold, and what it may name.
MUTATING = ("CREATE", "MERGE", "SET", "DELETE", "DETACH", "REMOVE", "DROP", "ALTER", "INSERT", "GRANT", "REVOKE", "DENY")
PROCEDURES = ("CALL DBMS", "CALL MG.", "CALL APOC.UTIL", "CALL APOC.CUSTOM")
PROPERTIES = (
    "name", "ticker", "cik", "market_cap", "country", "exchange", "sector", "industry", "description", "id", "polarity", "materiality", "status", "loss_ratio", "revenue_share_pct",
    "confidence", "duration_days", "tier", "channel", "valid_from", "valid_to", "start_date", "end_date", "as_of_date", "filing_date", "period", "source_doc", "form_type", "is_active", "active",
)
# Relations that end, that say nothing, and what a terminated one was.
TERMINAL = ("TERMINATED", "ENDED", "CANCELLED", "CANCELED", "DISSOLVED", "EXPIRED", "SEVERED", "DISCONTINUED", "TERMINATION")
NOISE = ("COMPARES_TO", "RISES_WITH_BENCHMARK", "TRADED_IN", "REACTS_TO", "TRADES_WITH", "PEER_REVIEWED_BY", "BENCHMARKED_AGAINST", "CORRELATES_WITH")
LICENSE = r"(?i)\b(licens\w*|royalt\w*|patent\w*|intellectual\s+property)\b"
PARTNER = r"(?i)\b(joint\s+venture|partnership|partner\w*|alliance|collaborat\w*)\b"
CUSTOMER = r"(?i)\b(customer\w*|purchas\w*|procur\w*|offtake)\b"
SUPPLIER = r"(?i)\b(suppli\w*|vendor\w*|foundry|manufactur\w*)\b"

_LITERAL = r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\""
_TRIPLE = re.compile(
    rf"(?P<s>\((?:{_LITERAL}|[^()'\"])*\))\s*-\s*\[\s*:(?P<rel>[A-Za-z0-9_]+)(?P<props>(?:{_LITERAL}|[^\[\]'\"])*)\]->\s*(?P<t>\((?:{_LITERAL}|[^()'\"])*\))", re.S
)
_NAME = re.compile(r"(?:name|id)\s*:\s*['\"]([^'\"]+)['\"]")


def per_value(f: Callable, kind: str) -> Callable[..., Column]:
    """A column function from a function of one row's values; Arrow batches."""

    @F.pandas_udf(kind)
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([f(*x) for x in zip(*series)])

    return run


def triples_of(text: str | None) -> list[tuple[str, str, str, str]]:
    """``(source, relation, properties, target)`` of each ``(..)-[:REL ..]->(..)``; names of the ends where they have one."""
    out = []
    for m in _TRIPLE.finditer(text or ""):
        s, t = (_NAME.search(m[x]) for x in ("s", "t"))
        out.append((s[1].strip() if s else "", m["rel"].upper(), m["props"].strip(), t[1].strip() if t else ""))
    return out


def parsed_triples(text: Column) -> Column:
    """The triples of a text as an array of structs."""
    names = ("source", "relation", "properties", "target")
    return per_value(lambda t: [dict(zip(names, x)) for x in triples_of(t)], "array<struct<source:string,relation:string,properties:string,target:string>>")(text)


def terminated_relation(context: Column, default: str = "SUPPLIES_TO") -> Column:
    """What a terminated relation was, by the words around it."""
    c = F.coalesce(context, F.lit(""))
    return F.when(c.rlike(LICENSE), "LICENSES_FROM").when(c.rlike(PARTNER), "PARTNERED_WITH").when(c.rlike(CUSTOMER) & ~c.rlike(SUPPLIER), "CUSTOMER_OF").otherwise(default)


def rolled_up(text: Column, parents: dict[str, str]) -> Column:
    """Text with the numbers of subsidiaries replaced by their parents', one after the other, unless the parent's is there."""
    for sub, parent in parents.items():
        text = F.when(text.contains(sub) & ~text.contains(parent), F.replace(text, F.lit(sub), F.lit(parent))).otherwise(text)
    return text


def gated_relation(relation: Column, hedged: Column, evidence: Column, canonical: tuple[str, ...], default: str = "SUPPLIES_TO") -> Column:
    """The relation to keep an edge under, null to drop it: noise and hedged ones go, terminal ones are repaired."""
    pred = F.upper(F.trim(relation))
    ends = pred.isin(*TERMINAL) | (~pred.isin(*canonical) & F.upper(F.coalesce(evidence, F.lit(""))).contains("TERMINATED"))
    fixed = terminated_relation(evidence, default)
    return F.when(pred.isin(*NOISE) | hedged, F.lit(None)).when(ends, F.when(fixed.isin(*canonical), fixed)).when(pred.isin(*canonical), pred)


def masked(statement: Column) -> Column:
    """The statement without comments and with empty literals."""
    s = F.regexp_replace(statement, rf"({_LITERAL})|//[^\n]*|(?s:/\*.*?\*/)", " '' ")
    return F.regexp_replace(s, r"`[^`]*`", " ")


def guard(statement: Column) -> Column:
    """``EMPTY_QUERY``, ``MUTATING_KEYWORD``, ``ADMIN_PROCEDURE``, ``INVALID_START``, ``UNKNOWN_PROPERTY`` or ``OK``: the first rule that a statement breaks."""
    m = masked(statement)
    up = F.upper(m)
    named = F.concat(F.regexp_extract_all(m, F.lit(r"\b[A-Za-z_]\w*\.([A-Za-z_]\w*)\b(?!\s*\()"), 1), F.regexp_extract_all(m, F.lit(r"[{,]\s*([A-Za-z_]\w*)\s*:"), 1))
    foreign = F.exists(named, lambda p: ~F.lower(p).isin(*PROPERTIES))
    return (
        F.when(F.coalesce(F.trim(statement), F.lit("")) == "", "EMPTY_QUERY").when(up.rlike(r"\b(?:" + "|".join(MUTATING) + r")\b"), "MUTATING_KEYWORD")
        .when(F.exists(F.array(*[F.lit(p) for p in PROCEDURES]), lambda p: up.contains(p)), "ADMIN_PROCEDURE").when(~F.upper(F.trim(statement)).rlike(r"^(?:MATCH|WITH|UNWIND|RETURN|CALL)\b"), "INVALID_START")
        .when(foreign, "UNKNOWN_PROPERTY").otherwise("OK")
    )


def as_of(statement: Column, day: str | None = None, variable: str = "r") -> Column:
    """The statement bound to relations active at ``day`` (or ``$as_of_date``): an anonymous relation gets a variable, the condition goes first into ``WHERE``.

    Statements without a relation, or with a condition on its status, come back as they are.
    """
    s = F.trim(statement)
    named = F.regexp_extract(s, r"\[([A-Za-z_]\w*):[\w|*.]+", 1)
    loose = (named == "") & s.rlike(r"-\[:[\w|*.]+(?:\s*\{[^}]*\})?\]->")
    bound = F.when(loose, F.concat(F.substring_index(s, "-[:", 1), F.lit(f"-[{variable}:"), F.substring(s, F.length(F.substring_index(s, "-[:", 1)) + 4, F.length(s)))).otherwise(s)
    var = F.when(loose, F.lit(variable)).otherwise(named)
    at = f"'{day}'" if day else "$as_of_date"
    test = F.concat(F.lit("coalesce("), var, F.lit(".status, 'ACTIVE_CURRENT') = 'ACTIVE_CURRENT' AND ("), var, F.lit(".valid_from IS NULL OR "), var, F.lit(f".valid_from <= {at}) AND ("), var, F.lit(".valid_to IS NULL OR "), var, F.lit(f".valid_to >= {at})"))
    where, clause = r"(?i)^(.*?\bWHERE\b)(.*)$", r"(?is)^(.*?)\s*\b((?:RETURN|WITH)\b.*)$"
    with_where = F.concat(F.regexp_extract(bound, where.replace("(?i)", "(?is)"), 1), F.lit(" ("), test, F.lit(") AND"), F.regexp_extract(bound, where.replace("(?i)", "(?is)"), 2))
    before = F.concat(F.regexp_extract(bound, clause, 1), F.lit(" WHERE "), test, F.lit(" "), F.regexp_extract(bound, clause, 2))
    done = bound.contains(".status, 'ACTIVE_CURRENT')") | bound.contains(".status = 'ACTIVE_CURRENT'")
    new = F.when(bound.rlike(r"(?i)\bWHERE\b"), with_where).when(bound.rlike(r"(?i)\b(?:RETURN|WITH)\b"), before).otherwise(F.concat(bound, F.lit(" WHERE "), test))
    return F.when((s == "") | (F.lower(s) == "(none)") | ((named == "") & ~loose), s).when(done, bound).otherwise(new)


def demuxed(text: Column, reasoning: Column) -> Column:
    """``{thought, answer}``: what stands before and after the end of the thought; an unended thought has no answer."""
    t = F.trim(text, F.lit(" \t\r\n"))
    clean = lambda c: F.trim(F.replace(c, F.lit("<think>"), F.lit("")), F.lit(" \t\r\n"))
    opened, closed = t.contains("<think>"), t.contains("</think>")
    head = F.substring_index(t, "</think>", 1)
    rest = F.substring(t, F.length(head) + 9, F.length(t))
    thought = F.when(reasoning & opened, clean(head))
    return F.struct(thought.alias("thought"), F.when(reasoning & opened & closed, F.trim(rest, F.lit(" \t\r\n"))).when(reasoning & opened, "(unclosed reasoning)").otherwise(t).alias("answer"))


def cited(answer: Column, title: Column, url: Column, articles: Column) -> Column:
    """Whether an article with a URL is cited: named by URL or title, or one of three or fewer."""
    return (F.coalesce(url, F.lit("")) != "") & (answer.contains(url) | F.coalesce(answer.contains(title), F.lit(False)) | (articles <= 3))


def uncited_figures(prose: Column, contraction: Column, downtime: Column) -> Column:
    """Which of ``contraction`` and ``downtime`` a text does not give in a usual rounding."""
    low = F.lower(F.coalesce(prose, F.lit("")))
    any_in = lambda forms: F.exists(F.array(*forms), lambda f: low.contains(f))
    pct = [F.concat(F.format_string(f"%.{n}f", contraction.cast("double")), F.lit("%")) for n in (1, 2, 0)]
    days = [F.format_string("%.1f", downtime.cast("double")), downtime.cast("long").cast("string")]
    missing = F.array(F.when(~any_in(pct), F.lit("contraction")), F.when(~any_in(days), F.lit("downtime")))
    return F.filter(missing, lambda x: x.isNotNull())
