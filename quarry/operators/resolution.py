"""Entity resolution: nodes that name one entity, by identifiers and by seven rules on names.

No rule compares all pairs of a label.  Nodes with a ticker or number in common are linked to
the least of them; equal normal names collapse to one node for each set of identifiers before
they are paired; the other rules meet in joins on what any pair they accept must share:

* containment: the rarest word of the smaller name;
* up to two edits: one of three segments of the shorter name, at a place at most two off;
* Jaro-Winkler: the first letter and a length at most five off, in cells of bounded size
  where letter counts rule out nearly all pairs before any is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.core.components import connected_components
from quarry.core.runtime import cut, small_side
from quarry.functions import text as T
from quarry.functions.clauses import _jw

# Aliases with name, number, ticker and exchange.
ALIASES = {
    "tsmc": ("Taiwan Semiconductor Manufacturing Company", "0001045810", "TSM", "NYSE"),
    "taiwan semiconductor": ("Taiwan Semiconductor Manufacturing Company", "0001045810", "TSM", "NYSE"),
    "foxconn": ("Hon Hai Precision Industry Co., Ltd.", "0001844510", "HNHPF", "OTC"),
    "google": ("Alphabet Inc.", "0001652044", "GOOGL", "NASDAQ"),
    "facebook": ("Meta Platforms, Inc.", "0001326801", "META", "NASDAQ"),
    "bofa": ("Bank of America Corporation", "0000070858", "BAC", "NYSE"),
    "apple": ("Apple Inc.", "0000320193", "AAPL", "NASDAQ"),
    "microsoft": ("Microsoft Corporation", "0000789019", "MSFT", "NASDAQ"),
    "nvidia": ("NVIDIA Corporation", "0001045810", "NVDA", "NASDAQ"),
    "broadcom": ("Broadcom Inc.", "0001730168", "AVGO", "NASDAQ"),
    "cisco": ("Cisco Systems, Inc.", "0000858877", "CSCO", "NASDAQ"),
}
# Tickers that are words.
WORD_TICKERS = (
    "A", "ALL", "ARE", "BE", "BEST", "BIG", "CAN", "CAT", "FAST", "FOR", "GAP", "HAS", "IT", "KEY", "LOW", "MAN", "NET", "NEW", "NOW", "ON", "ONE", "OUT", "SEE", "SO", "STAY", "TRUE", "TWO", "WELL",
)
# What makes a name a description.
DESCRIPTIVE = r"(?i)^(the|our|this)\b|\b(giant|maker|supplier|customer|counterparty|firm)\b"
#: Names of one side of a cell.
CELL = 2000


def is_word(ticker: Column) -> Column:
    t = F.upper(F.trim(ticker))
    return F.coalesce((F.length(t) == 1) | t.isin(*WORD_TICKERS), F.lit(False))


def prepared(nodes: DataFrame) -> DataFrame:
    """``(id, label, ticker, cik, norm)``; one row an id, blank identifiers null, label ``Entity`` where there is none."""
    blank = lambda c: F.when(~F.upper(F.trim(c)).isin("", "NONE", "NULL"), F.upper(F.trim(c)))
    x = nodes.where("id is not null").select("id", F.coalesce("label", F.lit("Entity")).alias("label"), blank(F.col("ticker")).alias("ticker"), blank(F.col("cik")).alias("cik"))
    x = x.groupBy("id").agg(F.min("label").alias("label"), F.min("ticker").alias("ticker"), F.min("cik").alias("cik"))
    return x.withColumn("norm", T.entity_key(F.col("id")))


def _ends(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"{c}_{side}") for c in ("id", "label", "ticker", "cik", "norm")])


def _star(nodes: DataFrame, key: str, rule: str, same_number: bool = False) -> DataFrame:
    """Links of each node to the least node with its identifier, none among the others."""
    x = nodes.where(F.col(key).isNotNull())
    first = x.groupBy(F.col(key).alias("k")).agg(F.min("id").alias("id_a"))
    a = first.join(_ends(nodes, "a"), "id_a")
    return _allowed(_ends(x, "b").join(a, F.col(f"{key}_b") == F.col("k")).where("id_a <> id_b"), rule, same_number)


def _same_name(nodes: DataFrame) -> DataFrame:
    """Links of nodes of one label and normal name: each to the least of its identifiers, and those to each other."""
    x = nodes.where("norm <> ''")
    x = cut(x.withColumn("rep", F.min("id").over(W.partitionBy("norm", "label", "ticker", "cik"))))
    own = x.where("id <> rep").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b"), F.lit("name").alias("rule"))
    reps = x.where("id = rep")
    on = (F.col("norm_a") == F.col("norm_b")) & (F.col("label_a") == F.col("label_b")) & (F.col("id_a") < F.col("id_b"))
    return own.unionByName(_allowed(_ends(reps, "a").join(_ends(reps, "b"), on), "name"))


def _allowed(pairs: DataFrame, rule: str, same_number: bool = False) -> DataFrame:
    """Pairs whose identifiers do not speak against them."""
    clash = F.coalesce(F.col("cik_a") != F.col("cik_b"), F.lit(False))
    tickers = F.coalesce(F.col("ticker_a") != F.col("ticker_b"), F.lit(False))
    if same_number:
        tickers = tickers & ~F.coalesce(F.col("cik_a") == F.col("cik_b"), F.lit(False))
    return pairs.where(~clash & ~tickers).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), F.lit(rule).alias("rule"))


def _alias_links(nodes: DataFrame) -> DataFrame:
    spark = nodes.sparkSession
    known = spark.createDataFrame([(k, v[0], v[2]) for k, v in ALIASES.items()], "alias string, full string, tick string").withColumn("full_norm", T.entity_key(F.col("full")))
    a = _ends(nodes, "a").join(F.broadcast(known), (F.lower(F.trim("id_a")) == F.col("alias")) | (F.col("norm_a") == F.col("alias")))  # eleven aliases
    b = _ends(nodes, "b")
    full, other = F.lower("full"), F.lower("id_b")
    fits = other.contains(full) | full.contains(other) | (F.col("full_norm") == F.col("norm_b")) | (F.col("ticker_b") == F.col("tick"))
    return _allowed(b.join(small_side(a), (F.col("label_a") == F.col("label_b")) & (F.col("id_a") != F.col("id_b")) & fits), "alias")


def _initial_links(nodes: DataFrame) -> DataFrame:
    short = nodes.where((F.length("id") >= 2) & (F.length("id") <= 5) & (F.upper("id") == F.col("id")) & (F.lower("id") != F.col("id")) & ~is_word(F.col("id")))
    long = nodes.withColumn("init", T.initialism(F.col("id"))).where("init <> ''")
    b = long.select("init", *[F.col(c).alias(f"{c}_b") for c in ("id", "label", "ticker", "cik", "norm")])
    a = _ends(short, "a")
    return _allowed(a.join(b, (F.col("id_a") == F.col("init")) & (F.col("label_a") == F.col("label_b")) & (F.col("id_a") != F.col("id_b"))), "initials")


def _ticker_links(nodes: DataFrame) -> DataFrame:
    a = _ends(nodes.where(F.col("ticker").isNotNull() & ~is_word(F.col("ticker"))), "a")
    return _allowed(a.join(_ends(nodes, "b"), (F.col("ticker_a") == F.upper("id_b")) & (F.col("label_a") == F.col("label_b")) & (F.col("id_a") != F.col("id_b"))), "ticker_name")


def _containment_links(nodes: DataFrame) -> DataFrame:
    """Names of six or more letters, alike in the first four, whose words are among the other's."""
    x = nodes.where("length(norm) >= 6").withColumn("ws", F.array_distinct(T.words(F.col("norm"))))
    words = x.select("label", F.explode("ws").alias("w")).groupBy("label", "w").agg(F.count("*").alias("df"))
    every = x.select("id", "label", F.explode("ws").alias("w"))
    rare = every.join(words, ["label", "w"]).groupBy("id").agg(F.min_by("w", F.struct("df", "w")).alias("w"))
    a = x.join(rare, "id").select(*[F.col(c).alias(f"{c}_a") for c in ("id", "label", "ticker", "cik", "norm", "ws")], "w", F.substring("norm", 1, 4).alias("head"))
    b = x.select(*[F.col(c).alias(f"{c}_b") for c in ("id", "label", "ticker", "cik", "norm", "ws")], F.explode("ws").alias("w"), F.substring("norm", 1, 4).alias("head"))
    on = (a["w"] == b["w"]) & (a["head"] == b["head"]) & (a["label_a"] == b["label_b"]) & (a["id_a"] != b["id_b"])
    return _allowed(a.join(b, on).where(F.size(F.array_except("ws_a", "ws_b")) == 0), "containment").distinct()


def _edit_links(nodes: DataFrame) -> DataFrame:
    """Names of four or more letters at most one edit apart, of six or more at most two."""
    x = nodes.where("length(norm) >= 4").withColumn("n", F.length("norm"))
    starts = lambda n, k: F.floor(n * k / 3).cast("int")
    seg = F.array(*[F.struct(F.lit(k).alias("k"), F.col("norm").substr(starts(F.col("n"), k) + 1, starts(F.col("n"), k + 1) - starts(F.col("n"), k)).alias("s")) for k in range(3)])
    a = x.select(*[F.col(c).alias(f"{c}_a") for c in ("id", "label", "ticker", "cik", "norm")], F.col("n").alias("len"), F.explode(seg).alias("g")).select("*", "g.k", "g.s").drop("g")
    probes = []
    for less in range(3):
        n = F.col("n") - less
        for k in range(3):
            size = starts(n, k + 1) - starts(n, k)
            for shift in range(-2, 3):
                at = starts(n, k) + 1 + shift
                probes.append(F.when((n >= 4) & (at >= 1) & (at + size - 1 <= F.col("n")), F.struct(n.alias("len"), F.lit(k).alias("k"), F.col("norm").substr(at, size).alias("s"))))
    b = x.select(*[F.col(c).alias(f"{c}_b") for c in ("id", "label", "ticker", "cik", "norm")], F.explode(F.array_distinct(F.filter(F.array(*probes), lambda p: p.isNotNull()))).alias("g")).select("*", F.col("g.len").alias("len"), "g.k", "g.s").drop("g")
    p = a.join(b, ["len", "k", "s"]).where("label_a = label_b and id_a <> id_b").drop("len", "k", "s").distinct()
    d, least = F.levenshtein("norm_a", "norm_b", 2), F.least(F.length("norm_a"), F.length("norm_b"))
    return _allowed(p.where((d >= 0) & ((d <= 1) | (least >= 6))), "edits").distinct()


def _winkler_links(nodes: DataFrame, least: float = 0.88) -> DataFrame:
    """Names alike to Jaro-Winkler ``least`` with one first letter and lengths at most five apart.

    A pair at ``least`` has a Jaro similarity of ``(least - 0.4) / 0.6`` or more, so its
    common letters ``m`` obey ``m/a + m/b >= 3 j - 1``; only such pairs are scored.
    """
    x = nodes.where("norm <> ''").withColumn("first", F.substring("norm", 1, 1)).withColumn("band", F.floor(F.length("norm") / 6).cast("int"))
    n = x.groupBy("label", "first", "band").agg(F.count("*").alias("c"))
    wide = n.alias("n").join(n.select("label", "first", (F.col("band") - 1).alias("band"), F.col("c").alias("up")), ["label", "first", "band"], "left")
    shards = wide.select("label", "first", "band", F.ceil((F.col("c") + F.coalesce("up", F.lit(0))) / CELL).alias("s"))
    # A name is in the cells of its own length band and of the one below; each cell of a band pairs two shards.
    both = x.withColumn("at", F.explode(F.array("band", F.col("band") - 1)))
    y = both.join(shards.withColumnRenamed("band", "at"), ["label", "first", "at"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("s")))
    y = y.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s").cast("int") - 1)))
    y = y.select("label", "first", "at", F.least("shard", "other").alias("i"), F.greatest("shard", "other").alias("j"), "shard", "id", "norm", "ticker", "cik")
    jaro = (least - 0.4) / 0.6

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf["norm"].tolist()
        size = np.array([len(s) for s in names])
        letters = {c: i for i, c in enumerate(sorted(set("".join(names))))}
        count = np.zeros((len(names), len(letters)), np.int16)
        for r, s in enumerate(names):
            for c in s:
                count[r, letters[c]] += 1
        ids = pdf["id"].to_numpy()
        got = []
        for r in range(len(names) - 1):
            m = np.minimum(count[r], count[r + 1 :]).sum(1)
            n, o = size[r], size[r + 1 :]
            ok = np.flatnonzero((np.abs(n - o) <= 5) & (m / n + m / o >= 3 * jaro - 1 - 1e-9)) + r + 1
            got += [(r, s) for s in ok if _jw(names[r], names[s]) >= least]
        col = lambda c, side: [pdf[c].iloc[g[side]] for g in got]
        return pd.DataFrame({f"{c}_{e}": pd.Series(col(c, k), dtype=object) for e, k in (("a", 0), ("b", 1)) for c in ("id", "ticker", "cik")})

    found = y.groupBy("label", "first", "at", "i", "j").applyInPandas(cell, "id_a string, ticker_a string, cik_a string, id_b string, ticker_b string, cik_b string")
    return _allowed(found, "winkler").distinct()


def links(nodes: DataFrame) -> DataFrame:
    """``(a, b, rule)``, ``a < b``: accepted links of nodes ``(id, label, ticker, cik)``, each rule's own.

    Identifiers that differ forbid a link.  Null ids are left out.
    """
    n = cut(prepared(nodes))
    parts = [
        _star(n, "ticker", "ticker"), _star(n, "cik", "cik", True), _same_name(n),
        _alias_links(n), _initial_links(n), _ticker_links(n), _containment_links(n), _edit_links(n), _winkler_links(n),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("a <> b").distinct()


def canonical_score(name: Column, subsidiary: Column | None = None) -> Column:
    """Order of names of one entity, least first: no subsidiary, no description, with a corporate suffix, long (a description: short), then by value."""
    descriptive = name.rlike(DESCRIPTIVE)
    suffix = F.arrays_overlap(F.regexp_extract_all(F.lower(name), F.lit(r"\b[a-z]+\b"), 0), F.array(*[F.lit(s) for s in T.ENTITY_SUFFIXES]))
    sub = F.lit(0) if subsidiary is None else subsidiary.cast("int")
    return F.struct(sub, descriptive.cast("int"), (~suffix).cast("int"), F.when(descriptive, F.length(name)).otherwise(-F.length(name)), name)


def resolved(nodes: DataFrame, accepted: DataFrame, subsidiaries: DataFrame | None = None) -> DataFrame:
    """``(id, canonical, ticker, cik, mention_count)``: each node with the best name of its component and the first identifiers known in that order.

    ``subsidiaries``: ids whose names stand for a component only where there is no other.
    """
    comp = connected_components(accepted, "a", "b")
    n = prepared(nodes).join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    if subsidiaries is not None:
        n = n.join(subsidiaries.select(F.col(subsidiaries.columns[0]).alias("id"), F.lit(True).alias("sub")).distinct(), "id", "left")
    score = canonical_score(F.col("id"), F.coalesce("sub", F.lit(False)) if subsidiaries is not None else None)
    best = n.withColumn("o", score).groupBy("component").agg(
        F.min_by("id", "o").alias("canonical"), F.min_by("ticker", F.when(F.col("ticker").isNotNull(), F.col("o"))).alias("ticker"), F.min_by("cik", F.when(F.col("cik").isNotNull(), F.col("o"))).alias("cik"), F.count("*").alias("mention_count")
    )
    return n.select("id", "component").join(best, "component").select("id", "canonical", "ticker", "cik", "mention_count")


def rewired(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between canonical names; ends without a mapping stay, loops go, symmetric relations come ordered."""
    m = mapping.select("id", "canonical")
    x = edges.join(m.withColumnsRenamed({"id": "source", "canonical": "_s"}), "source", "left").join(m.withColumnsRenamed({"id": "target", "canonical": "_t"}), "target", "left")
    x = x.withColumn("_s", F.coalesce("_s", "source")).withColumn("_t", F.coalesce("_t", "target")).where("_s <> _t")
    flip = F.col("rel_type").isin("COMPETES_WITH", "PARTNERED_WITH", "CO_INVESTS_WITH", "PEER_OF", "COLLABORATES_WITH") & (F.col("_s") > F.col("_t"))
    keep = [c for c in edges.columns if c not in ("source", "target")]
    return x.select(F.when(flip, F.col("_t")).otherwise(F.col("_s")).alias("source"), F.when(flip, F.col("_s")).otherwise(F.col("_t")).alias("target"), *keep)
