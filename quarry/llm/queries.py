"""Queries of the problems for language-model corpora, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.core.runtime import cut, table
from quarry.llm import boilerplate_lines, main_content, mixing, names, near_duplicates, packing, pair_defects, sentences, sizes, split_overlap, splitting


def _news(spark, d):
    return table(spark, d, "financial_news_queue")


def p1_all(spark, d):
    """Every triggered defect with its rank."""
    sft = pair_defects.find_defects(_sft(spark, d), "sft_records", ["target_completion"])
    return sft.unionByName(pair_defects.find_defects(table(spark, d, "dpo_records"), "dpo_records", ["chosen", "rejected"]))


def p1_found(spark, d):
    return p1_all(spark, d).where("rank = 1").drop("rank")


def p2_found(spark, d):
    return boilerplate_lines.repeated_line_positions(_news(spark, d), table(spark, d, "domain_status"))


def p2_cleaned(spark, d):
    out = boilerplate_lines.strip_repeated_lines(_news(spark, d), table(spark, d, "domain_status"))
    return out.select("id", "removed", F.length("clean_text").alias("clean_chars"))


def p2_significance(spark, d):
    """Per site: its lines over the floors, how many of them are in excess beyond chance, and where they stand."""
    x = boilerplate_lines.excessive_lines(_news(spark, d), table(spark, d, "domain_status"))
    return x.groupBy("site").agg(
        F.count("*").alias("lines"), F.sum(F.col("significant").cast("long")).alias("significant"), F.sum("rows").alias("rows"), F.sum("outside_rows").cast("long").alias("outside_rows"), F.round(F.max("llr"), 2).alias("top_llr")
    )


def p3_pieces(spark, d):
    return splitting.split_texts(table(spark, d, "filing_chunks")).drop("piece")


def p3_found(spark, d):
    """Chunks that came out in several pieces, which are those over the limit."""
    return p3_pieces(spark, d).where("piece_no = 1").select("chunk_id").distinct()


def p4_entities(spark, d):
    """Every name with its entity."""
    return names.link_names(*names.names_from(table(spark, d, "annotated_triples"), table(spark, d, "sp500_constituents")))


def p4_found(spark, d):
    return names.pairs_of(cut(p4_entities(spark, d)))


def p5_links(spark, d):
    rows = _news(spark, d)
    sets = cut(main_content.body_sets(rows, main_content.fit_from(rows)))
    return sets, near_duplicates.similar_classes(sets, 0.7)


def p5_found(spark, d):
    sets, linked = p5_links(spark, d)
    return near_duplicates.expand_pairs(sets, linked).select(F.col("a").alias("id_a"), F.col("b").alias("id_b")).distinct()


def p5_groups(spark, d):
    """One row per article with a main body: its class, the class's group and its number of linked classes."""
    from quarry.core.components import connected_components

    sets, linked = p5_links(spark, d)
    linked = cut(linked)
    comp = connected_components(linked, "a", "b").select(F.col("node").alias("cls"), "component")
    degree = linked.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    x = near_duplicates.class_members(sets).join(comp, "cls", "left").join(degree, "cls", "left")
    return x.select(F.col("key").alias("id"), "cls", F.coalesce("component", "cls").alias("story"), F.coalesce("links", F.lit(0)).alias("links"))


def p6_found(spark, d):
    rows = _news(spark, d)
    return main_content.main_body_lines(rows, main_content.fit_from(rows)).select("id", "line_no")


def _sft(spark, d):
    return table(spark, d, "sft_records")


def p7_found(spark, d):
    return split_overlap.overlaps(_sft(spark, d))


def p7_exact(spark, d):
    """Exact overlaps per split and source, the plain hash join."""
    rows = _sft(spark, d)
    x = rows.select(F.col("record_no").alias("e"), "split", F.col("metadata.provenance").alias("source")).join(split_overlap.exact_counts(rows), "e")
    return x.groupBy("split", "source").agg(F.count("*").alias("overlapping"), F.sum("k").alias("pairs"))


def p7_report(spark, d):
    rows = _sft(spark, d)
    return split_overlap.overlap_report(rows, split_overlap.overlaps(rows))


def _doc_sizes(spark, d):
    return sizes.token_sizes(table(spark, d, "documents"), "doc_id", "text", ("source",))


def p8_containers(spark, d):
    return packing.pack_documents(_doc_sizes(spark, d))


def p8_found(spark, d):
    return p8_containers(spark, d).where("piece = 1").select("doc_id")


def p8_report(spark, d):
    """Containers, pieces and the share of unused space."""
    x = p8_containers(spark, d).groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("pieces"))
    return x.agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.round(1 - F.sum("used") / (F.count("*") * packing.CAPACITY), 5).alias("unused"))


def p9_mix(spark, d):
    """The selected documents and how often each is used."""
    return mixing.mix_sources(_doc_sizes(spark, d), table(spark, d, "mix_targets"))[0]


def p9_shares(spark, d):
    return mixing.mix_sources(_doc_sizes(spark, d), table(spark, d, "mix_targets"))[1]


def p9_found(spark, d):
    return p9_shares(spark, d).where("short").select("source")


def p10_found(spark, d):
    return sentences.sentences(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_all, p2_found, p2_cleaned, p2_significance, p3_found, p3_pieces, p4_found, p4_entities, p5_found, p5_groups, p6_found, p7_found, p7_exact, p7_report,
    p8_found, p8_containers, p8_report, p9_found, p9_mix, p9_shares, p10_found,
)}

_SITE = r"""
WITH h AS (SELECT id, raw_text, provider, nullif(regexp_extract(lower(trim(source_url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host FROM financial_news_queue),
s AS (SELECT h.id, h.raw_text, coalesce(max(d.domain), CASE WHEN h.host IS NULL THEN max(p.domain) END) AS site
      FROM h LEFT JOIN domain_status d ON h.host = d.domain OR ends_with(h.host, '.' || d.domain)
             LEFT JOIN domain_status p ON h.host IS NULL AND p.provider = h.provider
      GROUP BY h.id, h.raw_text, h.host),
l AS (SELECT id, site, unnest(string_split(raw_text, chr(10))) AS ln, generate_subscripts(string_split(raw_text, chr(10)), 1) AS line_no FROM s WHERE site IS NOT NULL),
n AS (SELECT id, site, line_no, regexp_replace(trim(regexp_replace(lower(ln), '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' ', 'g')), '\d+', '#', 'g') AS k FROM l),
t AS (SELECT site, count(*) AS total FROM s WHERE site IS NOT NULL GROUP BY site),
c AS (SELECT site, k, count(DISTINCT id) AS c FROM n WHERE k <> '' GROUP BY site, k),
hot AS (SELECT c.site, c.k FROM c JOIN t USING (site) WHERE c.c >= 5 AND c.c >= 0.1 * t.total)
"""

_CANON = r"""
WITH x AS (SELECT record_no, split, metadata.provenance AS source, trim(regexp_replace(lower(prompt), '[^\p{L}\p{N}]+', ' ', 'g')) AS c, prompt FROM sft_records WHERE prompt IS NOT NULL),
y AS (SELECT *, CASE WHEN c = '' THEN trim(prompt) ELSE c END AS k FROM x),
e AS (SELECT y.record_no, y.split, y.source, count(*) AS k FROM y JOIN y t ON t.k = y.k AND t.split = 'train' WHERE y.split <> 'train' GROUP BY ALL)
"""

_SIGNIFICANCE = """
, q AS (SELECT c.site, c.k, c.c::DOUBLE AS k1, t.total::DOUBLE AS n1, (sum(c.c) OVER (PARTITION BY c.k) - c.c)::DOUBLE AS k2, ((SELECT sum(total) FROM t) - t.total)::DOUBLE AS n2 FROM c JOIN t USING (site)),
g AS (SELECT *, 2 * (coalesce(k1 * ln(nullif(k1, 0)), 0) + coalesce((n1 - k1) * ln(nullif(n1 - k1, 0)), 0) + coalesce(k2 * ln(nullif(k2, 0)), 0) + coalesce((n2 - k2) * ln(nullif(n2 - k2, 0)), 0) + (n1 + n2) * ln(n1 + n2) - n1 * ln(n1) - n2 * ln(n2)
      - coalesce((k1 + k2) * ln(nullif(k1 + k2, 0)), 0) - coalesce((n1 + n2 - k1 - k2) * ln(nullif(n1 + n2 - k1 - k2, 0)), 0)) AS llr FROM q),
z AS (SELECT *, CASE WHEN k1 * n2 >= k2 * n1 THEN least(floor(llr * 8), 12000) ELSE -1 END AS step FROM g),
b AS (SELECT step, sum(count(*)) OVER (ORDER BY step DESC) AS above, sum(count(*)) OVER () AS tests FROM z GROUP BY step),
m AS (SELECT min(step) AS least FROM b WHERE step >= 0 AND exp(-step / 16) <= above * 0.01 / tests)
SELECT site, count(*) AS lines, sum(CASE WHEN step >= m.least THEN 1 ELSE 0 END)::BIGINT AS significant, sum(k1)::BIGINT AS rows, sum(k2)::BIGINT AS outside_rows, round(max(round(llr, 4)), 2) AS top_llr
FROM z, m WHERE k1 >= 5 AND k1 >= 0.1 * n1 GROUP BY site
"""

SQL = {
    "p3_found": r"""SELECT DISTINCT chunk_id FROM filing_chunks
WHERE floor(greatest(1.35 * len(regexp_extract_all(text, '[^\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')), length(text) / 3.7) + 1) > 1500""",
    "p2_found": _SITE + "SELECT n.id, n.line_no::BIGINT AS line_no FROM n JOIN hot USING (site, k)",
    "p2_significance": _SITE + _SIGNIFICANCE,
    "p7_exact": _CANON + "SELECT split, source, count(*) AS overlapping, sum(k)::BIGINT AS pairs FROM e GROUP BY split, source",
}
