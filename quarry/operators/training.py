"""Building training sets: triage of rejections, mined and templated negatives, swaps, splits that do not leak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.core.ranks import ranked
from quarry.operators import curation as C
from quarry.operators.graph import ALIASES, ONTOLOGY

# Relations that say nothing, and reasons of placeholders.
NOISE = ("COMPARES_TO", "RISES_WITH_BENCHMARK", "TRADED_IN", "REACTS_TO", "TRADES_WITH", "PEER_REVIEWED_BY", "BENCHMARKED_AGAINST", "CORRELATES_WITH")
PLACEHOLDER = ("GENERIC_PLACEHOLDER_NODE", "GENERIC_PLACEHOLDER_EDGE")


def triage(predicate: Column, canonical: Column, reason: Column, df: Column, least: int = 3) -> Column:
    """Bucket of a rejected relation: placeholder, known noise, a typing error of a known one, an alias, rare, or to be reviewed."""
    return (
        F.when(reason.isin(*PLACEHOLDER), "PLACEHOLDER_NOISE").when(predicate.isin(*NOISE), "KNOWN_NOISE").when(predicate.isin(*ONTOLOGY) | F.coalesce(canonical.isin(*ONTOLOGY), F.lit(False)), "TYPING_ERROR")
        .when(predicate.isin(*ALIASES), "ALIASED").when(df < least, "LOW_SUPPORT").otherwise("CANDIDATE_FOR_REVIEW")
    )


def preference_target(stage: Column, properties: Column) -> Column:
    """The answer that a rejected one should have been, by the stage that rejected it."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(properties, F.array().cast("array<string>")), lambda p: F.concat(F.lit("'"), p, F.lit("'"))), ", "), F.lit("]"))
    return F.when(stage == "SCHEMA_AST_VIOLATION", F.concat(F.lit("(none) // REFUSED: properties "), listed, F.lit(" do not exist in graph schema"))).when(stage == "SYNTAX_MALFORMED", "(none) // REFUSED: malformed Cypher syntax").otherwise("(none)")


def hard_negatives(texts: DataFrame, names: DataFrame, known: DataFrame, least_words: int = 30, most: int = 4) -> DataFrame:
    """``(id, entities)``: texts of enough words that name two or more entities without a known pair among them.

    ``names``: ``(name, entity)``; a name is found where its words stand in a row, by a join on
    its first word.  ``known``: ``(a, b)`` in either order.  The first ``most`` entities by value.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    t = texts.select("id", words.alias("ws")).where(F.size("ws") >= least_words)
    n = names.select("entity", F.filter(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("nw")).where("size(nw) > 0").distinct()
    x = t.select("id", "ws", F.posexplode("ws").alias("i", "w")).join(n.withColumn("w", F.get("nw", F.lit(0))), "w")
    hit = x.where(F.slice("ws", F.col("i") + 1, F.size("nw")) == F.col("nw")).select("id", "entity").distinct()
    sets = hit.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("entity")), 1, most).alias("entities")).where("size(entities) >= 2")
    pairs = sets.select("id", F.explode("entities").alias("a")).alias("l").join(sets.select("id", F.explode("entities").alias("b")).alias("r"), "id").where("a < b")
    k = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return sets.join(pairs.join(k, ["a", "b"], "left_semi").select("id").distinct(), "id", "left_anti")


def swapped(rows: DataFrame, key: str, text: str, entity: str, peers: DataFrame, group: str, times: int = 1, seed: str = "42") -> DataFrame:
    """``(key, copy, text, entity)``: texts with their entity replaced by others of its group, each new text once.

    The peer of a copy is found by its place in the group, the text's hash and the copy's
    number, so no peers are paired with all texts.  ``peers``: ``(entity, group)``.
    """
    p = ranked(peers.select(F.col("entity").alias("_peer"), F.col(group).alias("_g")).distinct(), ["_g"], ["_peer"]).withColumnsRenamed({"_rank": "_i", "_size": "_n"})
    sizes = p.groupBy("_g").agg(F.max("_n").alias("_n"))
    x = rows.join(sizes, F.col(group) == F.col("_g")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    x = x.withColumn("_i", F.pmod(F.xxhash64(F.col(key), "copy", F.lit(seed)), F.col("_n")))
    y = x.join(p.select("_g", "_i", "_peer"), ["_g", "_i"]).where(F.col("_peer") != F.col(entity))
    y = y.select(key, "copy", F.replace(F.col(text), F.col(entity), F.col("_peer")).alias("text"), F.col("_peer").alias("entity"))
    return y.groupBy("text").agg(F.min(F.struct(key, "copy", "entity")).alias("x")).select(f"x.{key}", "x.copy", "text", "x.entity")


def template_negatives(entities: DataFrame, known: DataFrame, template: str, n: int, seed: str = "42") -> DataFrame:
    """``(a, b, text)``: about ``n`` pairs of entities without a known relation in either direction, as texts; each text once.

    Partners are drawn by hashed places in the ranked entities, two draws a wanted pair.
    """
    e = ranked(entities.select("entity").distinct(), [], ["entity"])
    size = e.agg(F.max("_size")).first()[0] or 0
    if size < 2:
        return entities.sparkSession.createDataFrame([], "a string, b string, text string")
    draws = entities.sparkSession.range(2 * n).select("id", *[F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(size)).alias(c) for i, c in enumerate(("i", "j"))]).where("i <> j")
    x = draws.join(e.select(F.col("_rank").alias("i"), F.col("entity").alias("a")), "i").join(e.select(F.col("_rank").alias("j"), F.col("entity").alias("b")), "j")
    k = known.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")).distinct()
    x = x.join(k, (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")), "left_anti")
    text = F.replace(F.replace(F.lit(template), F.lit("{a}"), F.col("a")), F.lit("{b}"), F.col("b"))
    y = x.withColumn("text", text).groupBy("text").agg(F.min("id").alias("id"), F.first("a").alias("a"), F.first("b").alias("b"))
    return y.orderBy("id").limit(n).select("a", "b", "text")


def steered(config: dict[str, int], short: dict[str, bool], factor: float = 1.5, default: int = 200) -> dict[str, int]:
    """Floors of classes: those that fell short are raised by ``factor``, unknown ones start at ``default``."""
    return {k: int(config.get(k, default) * factor) if low else config.get(k, default) for k, low in short.items()}


def checked_splits(rows: DataFrame, key: str, group: str, train: float = 0.8, validation: float = 0.1, seed: str = "42") -> DataFrame:
    """``rows`` with ``split`` by their ``group``, so that a group lies in one split; raises if any lies in two."""
    x = C.split(rows.withColumn("_g", F.coalesce(F.col(group), F.col(key).cast("string"))), "_g", train, validation, seed)
    leaks = x.groupBy("_g").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").limit(1).count()
    if leaks:
        raise ValueError("a group lies in two splits")
    return x.drop("_g")


def slow_learners(steps: DataFrame, key: str, step: str, prob: str, at: tuple[int, int] = (50, 100), below: float = 0.70) -> DataFrame:
    """``(key, first, second, slow)``: mean probability at two steps, and whether both lie below the bound (a missing one counts as 0)."""
    x = steps.groupBy(key).agg(*[F.avg(F.when(F.col(step) == s, F.col(prob))).alias(n) for s, n in zip(at, ("first", "second"))])
    low = lambda c: F.coalesce(F.col(c), F.lit(0.0)) < below
    return x.withColumn("slow", low("first") & low("second"))


def filtered_samples(samples: DataFrame, quarantined: DataFrame, retained: DataFrame, key: str) -> DataFrame:
    """Samples that are not quarantined and, unless nothing is retained, are retained."""
    x = samples.join(quarantined.select(key).distinct(), key, "left_anti")
    return x if retained.isEmpty() else x.join(retained.select(key).distinct(), key, "left_semi")


def subsidiary_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, name, jurisdiction)`` of the lines of a list of subsidiaries: parted by tabs or two blanks, headers left out."""
    boiler = r"(?i)(exhibit\s*21|subsidiaries\s+of|following\s+is\s+a\s+list|omitting\s+subsidiaries|considered\s+in\s+the\s+aggregate|significant\s+subsidiary|jurisdiction\s+of|state\s+or\s+other|percent\s+owned|all\s+100%|item\s+\d+|table\s+of\s+contents|^\s*owned\)?\s*$)"
    header = r"(?i)\b(name|state|jurisdiction|country|incorporation|subsidiary)\b"
    line = F.trim(F.col("line"), F.lit(" \t\r"))
    x = rows.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("line", line).where(F.col("line") != "")
    x = x.where(~F.col("line").rlike(boiler) & ~(F.col("line").rlike(header) & (F.length("line") < 60)))
    parts = F.split("line", r"\t+|\s{2,}")
    clean = lambda c: F.trim(c, F.lit(" -:;,"))
    y = x.select(key, F.size(parts).alias("n"), clean(parts[0]).alias("name"), F.when(F.size(parts) > 1, F.nullif(clean(F.get(parts, F.lit(1))), F.lit(""))).alias("place"))
    many = (F.col("n") >= 2) & (F.length("name") >= 3) & (F.length("name") < 120)
    single = (F.col("n") == 1) & (F.length("name") >= 4) & (F.length("name") < 100) & F.col("name").contains(" ")
    return y.where((many | single) & ~F.col("name").rlike(boiler)).select(key, "name", F.coalesce("place", F.lit("Unknown")).alias("jurisdiction"))


def truncated_runaway(text: Column, most: int = 7, least: int = 4, repeats: int = 4) -> Column:
    """The text up to the first repeat of the shortest n-gram that stands ``repeats`` times in a row; the text where none does."""
    out = text
    for n in range(most, least - 1, -1):
        loop = rf"(?is)^(.*?(?:^|\s)((?:\S+\s+){{{n - 1}}}\S+))(?:\s+\2){{{repeats - 1},}}(?:\s.*)?$"
        out = F.when(text.rlike(loop), F.regexp_extract(text, loop, 1)).otherwise(out)
    return out
