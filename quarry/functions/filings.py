"""Texts of filings: sections, chunks, items by precedence, boilerplate and disruption."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Items of current reports by tier, in order of precedence.
ITEM_TIERS = {
    1: ("1.05", "1.04", "1.03", "1.02", "2.05", "2.06", "2.04"),
    2: ("1.01", "8.01"),
    3: ("2.01", "2.02", "2.03", "7.01"),
    4: ("3.01", "3.02", "3.03", "4.01", "4.02", "5.01", "5.02", "5.03", "5.04", "5.05", "5.06", "5.07", "5.08", "6.01", "6.02", "6.03", "6.04", "6.05", "9.01"),
}
# What a tier 1 item stands for without words that say more.
ITEM_CATEGORY = {
    "1.05": "RANSOMWARE_CYBER_INFRASTRUCTURE_HALT", "1.03": "COMMERCIAL_INSOLVENCY_BANKRUPTCY", "1.04": "EQUIPMENT_BREAKDOWN_FAB_HALT",
    "2.04": "DEBT_COVENANT_DEFAULT_CREDIT_FREEZE", "2.05": "PERMANENT_FACILITY_CLOSURE_EXIT", "2.06": "PERMANENT_FACILITY_CLOSURE_EXIT",
}
# Words that tell a disruption, first match wins.
DISRUPTIONS = (
    ("FACILITY_FIRE_OR_EXPLOSION", r"\b(?:fire|fires|explosion|explosions|blast)\b"),
    ("NATURAL_DISASTER_FORCE_MAJEURE", r"\b(?:flood|flooding|earthquake|hurricane|typhoon|tornado|force\s+majeure)\b"),
    ("UTILITY_POWER_GRID_FAILURE", r"\b(?:power\s+(?:outage|failure|loss|grid|shortage)|grid\s+failure|blackout|utility\s+outage)\b"),
    ("RANSOMWARE_CYBER_INFRASTRUCTURE_HALT", r"\b(?:ransomware|cyberattack|cyber\s+incident|cybersecurity\s+incident|network\s+intrusion|unauthorized\s+access)\b"),
    ("EQUIPMENT_BREAKDOWN_FAB_HALT", r"\b(?:equipment\s+breakdown|machinery\s+failure|fab(?:rication)?\s+(?:halt|shutdown)|emergency\s+(?:halt|shutdown)|operational\s+halt|production\s+(?:halt|stoppage|curtailment)|plant\s+shutdown|facility\s+(?:shutdown|disruption)|cleanroom\s+(?:halt|contamination|outage))\b"),
    ("PRIMARY_SUPPLY_CONTRACT_TERMINATED", r"\b(?:supply\s+(?:agreement|contract)\s+(?:terminated|termination)|terminat(?:ed|ion)\s+of\s+(?:the\s+)?(?:supply|manufacturing|foundry)\s+(?:agreement|contract)|contract\s+severance)\b"),
    ("MARITIME_CANAL_PORT_LOGISTICS_CHOKEPOINT", r"\b(?:port\s+(?:closure|congestion|blockage|strike|halt)|canal\s+blockage|maritime\s+(?:disruption|blockade|chokepoint)|shipping\s+suspension)\b"),
    ("REGULATORY_SAFETY_RECALL_OR_FDA_HOLD", r"\b(?:product\s+recall|safety\s+recall|fda\s+(?:hold|warning|suspension)|clinical\s+hold|regulatory\s+halt)\b"),
    ("LABOR_UNION_STRIKE_WALKOUT", r"\b(?:labor\s+strike|union\s+strike|work\s+stoppage|walkout)\b"),
    ("PERMANENT_FACILITY_CLOSURE_EXIT", r"\b(?:plant\s+closure|facility\s+closure|cease\s+operations\s+at\s+(?:its|the)\s+(?:plant|facility|fab))\b"),
)
# Supply context, and what marks boilerplate.
SUPPLY = r"(?i)\b(?:supplier|supply|vendor|manufacturing|foundry|wafer|procurement|component|fab)\b"
SIGNATURE = r"(?is)\bpursuant\s+to\s+the\s+requirements\s+of\s+the\s+securities\s+exchange\s+act\s+of\s+1934\b.*"
HEADER_LINE = r"(?i)\r?\n(?=\s*(?:item\s+\d+\.\d{2}\b|forward-looking\s+statements|cautionary\s+(?:note|statement)\b|safe\s+harbor\b|signatures?\b))"
HARBOR = r"(?i)(?=\b(?:cautionary\s+(?:note|statement)\s+(?:regarding|concerning)\s+forward-looking\s+statements|forward-looking\s+statements\s*:|safe\s+harbor\s+statement\s*:))"
COVER = (
    "check the appropriate box", "commission file number", "emerging growth company", "indicate by check mark whether", "securities registered pursuant to section 12",
    "exact name of registrant as specified in its charter", "state or other jurisdiction of incorporation", "irs employer identification no", "registrant's telephone number",
)
HARBOR_PHRASES = (
    "private securities litigation reform act", "cautionary statement regarding forward-looking", "cautionary note regarding forward-looking", "cautionary statement concerning forward-looking",
    "forward-looking statements within the meaning", "actual results may differ materially", "safe harbor statement",
)
HARBOR_QUALIFIERS = ("differ materially", "risks and uncertainties", "no obligation", "undertake no obligation", "as of the date")
BOILERPLATE_START = r"(?i)^\s*(?:signatures?\s*$|item\s+9\.01\b|exhibits\s+and\s+financial\s+statement\s+schedules\b|exhibit\s+no\.?\b|(?:cautionary\s+(?:note|statement)\s+(?:regarding|concerning)\s+)?(?:forward-looking\s+statements|safe\s+harbor)\b)"
# Headings of sections.
SECTIONS = (
    ("Item 1 - Business", r"ITEM\s+1[.\s–—\-]+BUSINESS\b"),
    ("Item 1A - Risk Factors", r"ITEM\s+1A[.\s–—\-]+RISK\s+FACTORS\b"),
    ("Item 1B - Unresolved Staff Comments", r"ITEM\s+1B[.\s–—\-]+UNRESOLVED\s+STAFF\s+COMMENTS\b"),
    ("Item 2 - Properties", r"ITEM\s+2[.\s–—\-]+PROPERTIES\b"),
    ("Item 3 - Legal Proceedings", r"ITEM\s+3[.\s–—\-]+LEGAL\s+PROCEEDINGS\b"),
    ("Item 7 - Management Discussion and Analysis", r"ITEM\s+7[.\s–—\-]+MANAGEMENT(?:'S)?\s+DISCUSSION\s+AND\s+ANALYSIS\b"),
    ("Item 7A - Quantitative and Qualitative Disclosures", r"ITEM\s+7A[.\s–—\-]+QUANTITATIVE\s+AND\s+QUALITATIVE\s+DISCLOSURES\b"),
    ("Item 8 - Financial Statements", r"ITEM\s+8[.\s–—\-]+FINANCIAL\s+STATEMENTS\b"),
    ("Item 1.01 - Entry into Material Agreement", r"ITEM\s+1\.01[.\s–—\-]+ENTRY\s+INTO\s+A\s+MATERIAL\s+DEFINITIVE\s+AGREEMENT\b"),
    ("Item 1.02 - Termination of Material Agreement", r"ITEM\s+1\.02[.\s–—\-]+TERMINATION\s+OF\s+A\s+MATERIAL\s+DEFINITIVE\s+AGREEMENT\b"),
    ("Item 2.01 - Completion of Acquisition or Disposition", r"ITEM\s+2\.01[.\s–—\-]+COMPLETION\s+OF\s+ACQUISITION\s+OR\s+DISPOSITION\b"),
    ("Item 8.01 - Other Events", r"ITEM\s+8\.01[.\s–—\-]+OTHER\s+EVENTS\b"),
    ("Exhibit 21 - Subsidiaries", r"EXHIBIT\s+21(?:\.1)?[.\s–—\-]+SUBSIDIARIES\b"),
)

_RANK = {code: (tier, rank) for tier, codes in ITEM_TIERS.items() for rank, code in enumerate(codes)}


def item_code(item: Column) -> Column:
    """The code in an item's name, if it is one of the known; else null."""
    code = F.regexp_extract(F.coalesce(item, F.lit("")), r"(?i)\b(?:item\s+)?(\d+\.\d{2})\b", 1)
    return F.when(code.isin(*_RANK), code)


def _placed(code: Column) -> Column:
    place = F.create_map(*[x for c, (t, r) in _RANK.items() for x in (F.lit(c), F.lit(t * 100 + r))])
    return place[code]


def item_tier(item: Column) -> Column:
    """Tier 1 (acute) to 4 (procedural); 4 for an unreadable item with 9.01, else 2."""
    return F.coalesce(F.floor(_placed(item_code(item)) / 100).cast("int"), F.when(F.coalesce(item, F.lit("")).contains("9.01"), 4).otherwise(2))


def primary_item(items: Column) -> Column:
    """The known item of highest precedence as ``Item n.nn``; ``Item 8.01`` where there is none."""
    known = F.filter(F.transform(items, item_code), lambda c: c.isNotNull())
    first = F.array_min(F.transform(known, lambda c: F.struct(_placed(c).alias("p"), c.alias("c"))))
    return F.concat(F.lit("Item "), F.coalesce(first["c"], F.lit("8.01")))


def sanitized(text: Column) -> Column:
    """``{text, stripped}``: signatures and what follows cut off, blocks of cover page, exhibits and safe harbour left out.

    Blocks part at blank lines, before known headings and before an inline safe harbour.
    Null gives the empty text.  Texts are read whole.
    """
    t = F.coalesce(text, F.lit(""))
    signed = t.rlike(SIGNATURE)
    blocks = F.flatten(F.transform(F.split(F.regexp_replace(F.regexp_replace(t, SIGNATURE, ""), HEADER_LINE, "\n\n"), r"\r?\n\s*\r?\n"), lambda b: F.split(b, HARBOR)))
    blocks = F.filter(F.transform(blocks, lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")

    def boilerplate(b: Column) -> Column:
        low = F.lower(b)
        has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))
        return has(COVER) | has(HARBOR_PHRASES) | b.rlike(BOILERPLATE_START) | (low.contains("exhibit no") & low.contains("description")) | (low.contains("forward-looking statements") & has(HARBOR_QUALIFIERS))

    kept = F.filter(blocks, lambda b: ~boilerplate(b))
    return F.struct(F.array_join(kept, "\n\n").alias("text"), (F.size(blocks) - F.size(kept) + signed.cast("int")).alias("stripped"))


def disruption_class(text: Column) -> Column:
    """First disruption that the words tell; null without one."""
    out = F.lit(None).cast("string")
    for name, p in reversed(DISRUPTIONS):
        out = F.when(text.rlike(f"(?i){p}"), name).otherwise(out)
    return out


def assessed(rows: DataFrame, items: str, headline: str, content: str, magnitude: str, duration: str) -> DataFrame:
    """Adds ``primary_item, tier, disruption, category, magnitude_pct, duration_days, stripped, reason``.

    Words of the sanitised texts come first, then what a tier 1 item stands for (1.02 only
    in a supply context or with stated figures), then stated figures.  Defaults: 100 %, 60 days.
    """
    x = rows.withColumn("_h", sanitized(F.col(headline))).withColumn("_c", sanitized(F.col(content))).withColumn("primary_item", primary_item(F.col(items)))
    x = x.withColumn("tier", item_tier(F.col("primary_item"))).withColumn("_t", F.concat_ws("\n", F.nullif(F.col("_h.text"), F.lit("")), F.nullif(F.col("_c.text"), F.lit("")))).withColumn("_l", disruption_class(F.col("_t")))
    mag, dur = (F.when(F.col(c).cast("double") > 0, F.col(c).cast("double")) for c in (magnitude, duration))
    code, stated = F.substring("primary_item", 6, 4), mag.isNotNull() | dur.isNotNull()
    supply = F.col("_t").rlike(SUPPLY) | stated
    anchor = F.create_map(*[F.lit(v) for kv in ITEM_CATEGORY.items() for v in kv])
    acute = F.col("tier") == 1
    reason = (
        F.when(F.col("_l").isNotNull(), "SANITIZED_LEXICAL_DISRUPTION_MATCH").when(acute & (code == "1.02") & supply, "TIER_1_SUPPLY_CONTRACT_TERMINATION").when(acute & (code == "1.02"), "TIER_1_ITEM_1_02_NON_SUPPLY_NEGATIVE_CONTROL")
        .when(acute, F.concat(F.lit("TIER_1_STATUTORY_ANCHOR_Item_"), F.replace(code, F.lit("."), F.lit("_")))).when(stated, "EXPLICIT_METADATA_SHOCK_OVERRIDE").otherwise("NON_DISRUPTIVE_NEGATIVE_CONTROL")
    )
    x = x.withColumn("reason", reason).withColumn("disruption", ~F.col("reason").isin("TIER_1_ITEM_1_02_NON_SUPPLY_NEGATIVE_CONTROL", "NON_DISRUPTIVE_NEGATIVE_CONTROL"))
    category = F.coalesce("_l", F.when(F.col("reason") == "TIER_1_SUPPLY_CONTRACT_TERMINATION", "PRIMARY_SUPPLY_CONTRACT_TERMINATED").when(acute & F.col("disruption"), anchor[code]), F.lit("OTHER_UNCLASSIFIED_MATERIAL_HALT"))
    figure = lambda v, default: F.when(F.col("disruption"), F.coalesce(v, F.lit(default))).otherwise(0.0)
    x = x.withColumn("category", category).withColumn("magnitude_pct", figure(mag, 100.0)).withColumn("duration_days", figure(dur, 60.0))
    return x.withColumn("stripped", F.col("_h.stripped") + F.col("_c.stripped")).drop("_h", "_c", "_t", "_l")


def estimate(text: str) -> int:
    """Tokens of a text by words and characters; 0 for the empty text."""
    return int(max(len(text.split()) * 1.35, len(text) / 3.7) + 1) if text else 0


def sections_of(text: str, patterns: tuple = SECTIONS) -> list[tuple[str, int, int]]:
    """``(name, start, end)`` from each heading at a line's start to the next; one section without headings."""
    any_of = re.compile("|".join(rf"(?P<s{i}>(?:\n|^)\s*(?:{p}))" for i, (_, p) in enumerate(patterns)), re.I)
    starts = [(m.start(), patterns[int(m.lastgroup[1:])][0]) for m in any_of.finditer(text)]
    if not starts:
        return [("General Disclosure", 0, len(text))]
    ends = [s for s, _ in starts[1:]] + [len(text)]
    return [(name, s, e) for (s, name), e in zip(starts, ends) if text[s:e].strip()]


def paragraphs_of(text: str, budget: int) -> list[str]:
    """Paragraphs of a section; those over the budget as runs of sentences that fit (a longer sentence stays whole)."""
    out: list[str] = []
    for p in filter(None, (x.strip() for x in re.split(r"\n\s*\n", text))):
        if estimate(p) <= budget:
            out.append(p)
            continue
        run: list[str] = []
        used = 0
        for s in filter(None, (x.strip() for x in re.split(r"(?<=[.!?])\s+", p))):
            n = estimate(s)
            if run and used + n > budget:
                out.append(" ".join(run))
                run, used = [], 0
            run.append(s)
            used += n
        out += [" ".join(run)] if run else []
    return out


def packed(paragraphs: list[str], budget: int, overlap: int) -> list[str]:
    """Chunks of whole paragraphs under the budget, each beginning with the last paragraphs of the one before that fit the overlap."""
    sizes = [estimate(p) for p in paragraphs]
    chunks, lo, used = [], 0, 0
    for i, n in enumerate(sizes):
        if i > lo and used + n > budget:
            chunks.append("\n\n".join(paragraphs[lo:i]))
            back, kept = i, 0
            while back > lo and kept + sizes[back - 1] <= overlap:
                back -= 1
                kept += sizes[back]
            lo, used = back, kept
        elif i == lo and n > budget:  # alone over the budget: a chunk of its own, nothing carried over
            chunks.append(paragraphs[i])
            lo, used = i + 1, 0
            continue
        used += n
    return chunks + (["\n\n".join(paragraphs[lo:])] if lo < len(paragraphs) else [])


def segmented(rows: DataFrame, key: str, text: str, header: str, limit: int = 1500, overlap: int = 120, patterns: tuple = SECTIONS) -> DataFrame:
    """``(key, ordinal, section, text, tokens)``: chunks of each text by sections, numbered through the whole text.

    ``header`` stands before each chunk with the section's name and counts toward the limit.
    Null and blank texts give no chunk.
    """

    def of(body: str, head: str) -> Iterator[tuple]:
        for name, a, b in sections_of(body, patterns):
            top = f"[{head} | {name}]"
            budget = max(200, limit - estimate(top) - 10)
            section = body[a:b].strip()
            for piece in [section] if estimate(section) <= budget else packed(paragraphs_of(section, budget), budget, overlap):
                yield name, piece.strip(), estimate(f"{top}\n\n{piece.strip()}")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in it:
            out = [(k, i, *c) for k, body, head in zip(x["k"], x["t"], x["h"]) if body and body.strip() for i, c in enumerate(of(body, head or ""), 1)]
            yield pd.DataFrame(out, columns=["k", "ordinal", "section", "text", "tokens"])

    kind = rows.schema[key].dataType.simpleString()
    x = rows.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(header).alias("h"))
    return x.mapInPandas(run, f"k {kind}, ordinal int, section string, text string, tokens int").withColumnRenamed("k", key)
