"""Scalar text functions as column expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Suffix tokens set aside in entity names.
ENTITY_SUFFIXES = (
    "inc", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "plc", "nv", "ag", "sa", "gmbh", "bv",
    "group", "holding", "holdings", "technology", "technologies", "tech", "system", "systems", "solution", "solutions",
    "semiconductor", "semiconductors", "international", "intl", "enterprises", "enterprise", "industries", "industry",
)
# Legal forms set aside in company names.
COMPANY_SUFFIXES = r"\b(?:incorporated|inc|corporation|corp|ltd|limited|co|company|plc|holdings|holding|group|sa|ag|gmbh|nv|the|class|cl|series|common stock|ordinary shares)\b"
# Words that give no initial.
INITIAL_STOPWORDS = ("of", "and", "the", "for", "in", "to", "a", "an", "at", "by", "on")
# Phrases of pages behind a barrier.
PAYWALL_PHRASES = (
    "subscribe to continue reading", "this article is exclusive to subscribers", "sign in for full access", "subscribe for unlimited access",
    "already a subscriber", "you have reached your limit of free articles", "to read the full story", "subscriber-only content", "join now to read",
)
# Disclosures cut off with all that follows.
TAIL_PATTERNS = (
    r"(?is)(?:the\s+)?motley\s+fool\s+(?:has\s+positions\s+in|owns\s+shares\s+of|recommends|transacts).*",
    r"(?is)disclosure:\s*(?:the\s+author|the\s+motley\s+fool|seeking\s+alpha|zacks|investorplace|fool\.com).*",
    r"(?is)disclaimer:\s*(?:past\s+performance\s+is\s+no\s+guarantee|the\s+opinions\s+expressed\s+herein|this\s+article\s+represents\s+the\s+opinion).*",
    r"(?is)seeking\s+alpha\s+contributor.*",
    r"(?is)zacks\s+investment\s+research\s+disclaimer.*",
    r"(?is)the\s+views\s+and\s+opinions\s+expressed\s+herein\s+are\s+the\s+views\s+and\s+opinions\s+of\s+the\s+author.*",
)


def words(text: Column) -> Column:
    """White-space separated words, none for blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def entity_key(name: Column) -> Column:
    """Lower case, letters and digits only, suffix tokens dropped anywhere (all kept if none is left)."""
    clean = F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}\s]", "")
    kept = F.filter(words(clean), lambda w: ~w.isin(*ENTITY_SUFFIXES))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(clean)


def company_key(name: Column) -> Column:
    """Lower case, punctuation and legal forms to spaces, spaces collapsed."""
    t = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, COMPANY_SUFFIXES, " "), r"\s+", " "))


def initialism(name: Column) -> Column:
    """First letters of two or more words beside stopwords, else empty."""
    ws = F.filter(words(F.regexp_replace(name, r"[,.()\-&]", " ")), lambda w: ~F.lower(w).isin(*INITIAL_STOPWORDS))
    return F.when(F.size(ws) >= 2, F.array_join(F.transform(ws, lambda w: F.upper(F.substring(w, 1, 1))), "")).otherwise("")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of lower-case words, each padded by two blanks before and one after."""
    ws = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    grams = F.transform(ws, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(0.0)).otherwise(both / total)


def url_domain(url: Column) -> Column:
    """Host in lower case without port and leading ``www.``; empty where there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1), r"^www\.", "")


def source_hash(url: Column, payload: Column, length: int = 32) -> Column:
    """Hash of the trimmed URL, of the payload where there is no URL."""
    return F.substring(F.sha2(F.when(F.coalesce(url, F.lit("")) != "", F.trim(url)).otherwise(F.coalesce(payload, F.lit(""))), 256), 1, length)


def strip_html(html: Column) -> Column:
    """Text of a page: scripts and styles out, tags to blanks, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"\s+", " "))


def strip_tail(text: Column) -> Column:
    for p in TAIL_PATTERNS:
        text = F.regexp_replace(text, p, "")
    return F.trim(text)


def is_stub(text: Column, min_words: int = 40) -> Column:
    """Too few words, or a phrase of a page behind a barrier; null counts as stub."""
    low = F.lower(text)
    barrier = F.lit(False)
    for p in PAYWALL_PHRASES:
        barrier = barrier | low.contains(p)
    return F.coalesce((F.size(words(text)) < min_words) | barrier, F.lit(True))


def token_estimate(text: Column) -> Column:
    """floor(max(1.35 words, characters / 3.7) + 1); 0 for the empty text."""
    est = F.floor(F.greatest(F.size(words(text)) * 1.35, F.length(text) / 3.7) + 1).cast("int")
    return F.when(text == "", F.lit(0)).otherwise(est)


def metadata_header(*parts: Column) -> Column:
    """Parts that are there, joined in brackets."""
    return F.concat(F.lit("["), F.concat_ws(" | ", *parts), F.lit("]"))


def normal_date(text: Column) -> Column:
    """First ten characters; blank, 'none', 'null' and 'nan' are null."""
    t = F.trim(text)
    return F.when(~F.lower(t).isin("", "none", "null", "nan"), F.substring(t, 1, 10))


def padded_cik(cik: Column) -> Column:
    """Left-padded to ten digits; longer values stay."""
    c = F.trim(cik)
    return F.when(F.length(c) < 10, F.lpad(c, 10, "0")).otherwise(c)


def exchange_name(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return F.when(t.contains("NASDAQ"), "NASDAQ").when(t.contains("AMEX") | t.contains("AMERICAN"), "AMEX").when(t.contains("NYSE") | t.contains("NEW YORK"), "NYSE").otherwise("UNKNOWN")
