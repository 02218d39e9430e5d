"""Filters over graph edges, names and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions import text as T

# Names that stand for no particular entity.
PLACEHOLDERS = (
    "the company", "the customer", "the customers", "our customer", "our customers", "the supplier", "the suppliers", "our supplier",
    "our suppliers", "management", "the registrant", "registrant", "the vendor", "the vendors", "third party", "third parties",
    "third-party supplier", "third-party vendor", "certain customers", "certain suppliers", "certain vendors", "the manufacturer",
    "the manufacturers", "our manufacturer", "our subsidiaries", "its subsidiaries", "certain subsidiaries", "unnamed counterparty",
    "competitors", "our competitors", "the industry", "the market", "foreign governments", "regulatory bodies", "various clients",
    "all customers", "key suppliers", "major customer", "sole source", "its affiliates", "our affiliates", "this company",
)
PRONOUNS = ("it", "they", "them", "their", "theirs", "we", "us", "its", "our", "ours")
COUNTERPARTY = r"(?i)^(?:customer|supplier|vendor|client|partner|manufacturer|distributor|counterparty|oem|buyer|seller|competitor)\s+(?:#|no\.?\s*)?(?:[a-z]|\d{1,2}|[a-z]\d|\d[a-z])$"
ROLE = r"^(?:a|an|the|our|one|one\s+of\s+our|several|various|certain|unnamed|multiple|other|leading|major|primary|principal|sole|key|largest|significant|external|third[- ]party)\s+.*\b(?:supplier|customer|vendor|partner|manufacturer|foundry|distributor|client|competitor|counterparty)s?$"
ROLE_FIRM = r"\b(?:inc|corp|corporation|co|company|ltd|limited|llc|lp|llp|plc|gmbh|ag|sa|nv|bv|holdings|group)\b"
IDENTIFIED = r"\([A-Z]{1,5}\)|\bCIK\s*[:#]?\s*\d{6,10}\b"
# Sources of promotional articles, and publishers.
CLICKBAIT = (
    "motley fool", "the motley fool", "fool", "foolcom", "fool.com", "seeking alpha", "seekingalpha", "zacks", "zacks investment research",
    "benzinga", "investorplace", "thestreet", "tipranks", "insider monkey", "24/7 wall st", "alpha spreading", "fxstreet",
)
PUBLISHERS = CLICKBAIT + (
    "cnbc", "bloomberg", "reuters", "associated press", "ap news", "dow jones", "pr newswire", "businesswire", "globe newswire", "accesswire",
    "marketwired", "yahoo finance", "barrons", "wall street journal", "wsj", "financial times", "ft.com", "forbes", "morningstar",
    "investopedia", "marketwatch", "investing.com",
)


def valid_at(as_of: str | Column, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    """Whether an edge holds at a date; both ends count, an open or empty end always holds."""
    t = F.lit(as_of) if isinstance(as_of, str) else as_of
    f, u = T.normal_date(F.col(valid_from)), T.normal_date(F.col(valid_to))
    return (f.isNull() | (f <= t)) & (u.isNull() | (u >= t))


def edges_at(edges: DataFrame, as_of: str | None = None, status: str | None = None, rel_types: tuple = ()) -> DataFrame:
    """Edges of the given types and status that hold at a date; an absent condition passes all."""
    if rel_types:
        edges = edges.where(F.col("rel_type").isin(*rel_types))
    if status is not None:
        edges = edges.where(F.col("status") == status)
    return edges if as_of is None else edges.where(valid_at(as_of))


def bounds_in_order(valid_from: Column, valid_to: Column) -> Column:
    """False only where both bounds are dates and the first is later."""
    f, t = F.try_to_date(T.normal_date(valid_from), "yyyy-MM-dd"), F.try_to_date(T.normal_date(valid_to), "yyyy-MM-dd")
    return F.coalesce(f <= t, F.lit(True))


def is_placeholder(name: Column) -> Column:
    """Whether a name is a pronoun, a stock phrase, an anonymised party or a role without a firm."""
    raw = F.trim(name)
    norm = F.lower(raw)
    clean = F.trim(F.regexp_replace(F.regexp_replace(norm, r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))
    short_upper = (F.length(raw) <= 3) & (raw == F.upper(raw))
    hit = (
        clean.isin(*PLACEHOLDERS) | norm.isin(*PLACEHOLDERS) | (clean.isin(*PRONOUNS) & ~short_upper)
        | clean.rlike("^(certain|various|unnamed) ") | clean.rlike(COUNTERPARTY) | raw.rlike(COUNTERPARTY)
        | (clean.rlike(ROLE) & ~clean.rlike(ROLE_FIRM) & ~raw.rlike(IDENTIFIED))
    )
    return F.coalesce(hit & (clean != ""), F.lit(False))


def is_listed(name: Column, entries: tuple) -> Column:
    """Equal to an entry, or holding one of six characters or more."""
    norm = F.trim(F.lower(name))
    clean = F.trim(F.regexp_replace(norm, r"[^\p{L}\p{N}\s]", ""))
    hit = clean.isin(*entries) | norm.isin(*entries)
    for e in entries:
        if len(e) >= 6:
            hit = hit | clean.contains(e)
    return F.coalesce(hit, F.lit(False))


def share_of(columns: list[str]) -> Column:
    """Edge share in [0, 1] from the columns there are: share, exposure_pct, revenue_share_pct, revenue_share, loss_ratio; else 1."""
    c = {x: F.col(x) for x in columns}
    if_over_one = lambda x: F.when(x > 1, x / 100).otherwise(x)
    options = [c[n] if n == "share" else c[n] / 100 if n.endswith("_pct") else if_over_one(c[n]) for n in ("share", "exposure_pct", "revenue_share_pct", "revenue_share", "loss_ratio") if n in c]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(*options, F.lit(1.0))))


def not_blacklisted(rows: DataFrame, domains: DataFrame, domain: str, at: str, cool_minutes: int = 60) -> DataFrame:
    """Rows whose domain is not blacklisted, or whose cool-down is over at the row's time."""
    d = domains.where("status = 'blacklisted'").select(F.col("domain").alias("_d"), F.col("updated_at").alias("_u"))
    over = F.col(at) > F.col("_u") + F.expr(f"interval {int(cool_minutes)} minutes")
    return rows.join(F.broadcast(d), F.col(domain) == F.col("_d"), "left").where(F.col("_d").isNull() | over).drop("_d", "_u")


def cohort_filter(rows: DataFrame, equal: dict, contains: dict, either: tuple | None = None) -> DataFrame:
    """Case-insensitive equalities, substrings, and one value in either of two columns."""
    for k, v in equal.items():
        rows = rows.where(F.upper(k) == v.upper())
    for k, v in contains.items():
        rows = rows.where(F.lower(k).contains(v.lower()))
    if either:
        a, b, v = either
        rows = rows.where((F.upper(a) == v.upper()) | (F.upper(b) == v.upper()))
    return rows
