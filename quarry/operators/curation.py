"""Curation of training records: shingles, MinHash classes, embedding deduplication, coresets, splits, balance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.core.components import connected_components
from quarry.core.ranks import ranked
from quarry.core.runtime import cut


def shingles(text: Column, width: int = 5) -> Column:
    """Distinct word shingles of lower-case text; fewer words give one shingle of them all, none gives none."""
    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.array_join(F.slice(w, i + 1, width), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < width, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(many))

    # The words are bound once as a lambda variable; written in place they would be found anew for every shingle.
    return F.get(F.transform(F.array(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)), of), 0)


def shingle_hashes(text: Column, width: int = 5) -> Column:
    """32-bit hashes: the first eight hexadecimal digits of the shingle's md5."""
    return F.array_distinct(F.transform(shingles(text, width), lambda s: F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")))


def minhash(permutations: int = 128, seed: int = 42):
    """Arrow function from hash arrays to signatures: least of (a x + b) mod (2**31 - 1) per permutation."""
    p = (1 << 31) - 1
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1, p, permutations), rng.integers(0, p, permutations)

    @F.pandas_udf("array<long>")
    def run(h: pd.Series) -> pd.Series:
        return pd.Series([((np.asarray(x, np.int64)[:, None] % p * a + b) % p).min(0) if x is not None and len(x) else np.full(permutations, p) for x in h])

    return run


def duplicate_links(rows: DataFrame, key: str, text: str, threshold: float = 0.85, bands: int = 32, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(classes, links)``: ``(key, cls, n)`` of each row, and ``(a, b, jaccard)`` between classes.

    Rows with one shingle set form one class, named by its least key, so copies never pair.
    Bands of MinHash signatures give candidates; every candidate is verified on the sets.
    Rows without any word take no part.
    """
    x = rows.where(F.col(text).isNotNull()).select(key, F.sort_array(shingle_hashes(F.col(text), width)).alias("h")).where("size(h) > 0")
    x = cut(x.withColumn("g", F.md5(F.array_join(F.transform("h", lambda v: v.cast("string")), ","))))
    named = x.groupBy("g").agg(F.min(key).alias("cls"), F.count("*").alias("n"))
    classes = x.select(key, "g").join(named, "g").select(key, "cls", "n")
    one = cut(x.join(named.select("g", F.col("cls").alias(key)), ["g", key], "left_semi").select(F.col(key).alias("cls"), "h"))
    perms = 128
    r = perms // bands
    sig = one.select("cls", minhash(perms)("h").alias("s"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("s", i * r + 1, r)))
    b = cut(sig.select("cls", F.explode(parts).alias("b")))
    pairs = b.alias("p").join(b.alias("q"), F.col("p.b") == F.col("q.b")).where("p.cls < q.cls").select(F.col("p.cls").alias("a"), F.col("q.cls").alias("b")).distinct()
    v = pairs.join(one.select(F.col("cls").alias("a"), F.col("h").alias("ha")), "a").join(one.select(F.col("cls").alias("b"), F.col("h").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    v = v.withColumn("jaccard", F.round(common / (F.size("ha") + F.size("hb") - common), 6)).where(F.col("jaccard") >= threshold)
    return classes, v.select("a", "b", "jaccard")


def survivors(classes: DataFrame, links: DataFrame, rows: DataFrame, key: str, length: str) -> DataFrame:
    """The longest record of each group of linked classes (least key on ties)."""
    comp = connected_components(links, "a", "b")
    x = classes.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")).join(rows.select(key, length), key)
    return x.groupBy("component").agg(F.min_by(key, F.struct(-F.col(length), key)).alias(key)).select(key)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; a zero vector counts as length 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    one = lambda v: F.when(norm(v) == 0, 1.0).otherwise(norm(v))
    return dot / (one(a) * one(b))


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = 500) -> DataFrame:
    """``(query, key, similarity)``: the ``k`` most similar rows of each query, itself left out; exact.

    The query set goes to all rows in blocks of fixed size; each task keeps ``k`` per query,
    a second pass merges them.  Ties: smaller key.
    """
    ids = sorted(r[0] for r in queries.select(key).distinct().collect())  # the stated query set, keys alone
    out = None
    for i in range(0, len(ids), block):
        part = queries.where(F.col(key).isin(ids[i : i + block])).select(key, vector).collect()
        qk = np.array([r[0] for r in part])
        qv = np.array([r[1] for r in part], np.float64)
        n = np.linalg.norm(qv, axis=1, keepdims=True)
        qv = qv / np.where(n == 0, 1, n)

        def run(it, qk=qk, qv=qv):
            for pdf in it:
                if not len(pdf):
                    continue
                v = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                s = np.round((v / np.where(n == 0, 1, n)) @ qv.T, 9)
                keys = pdf[key].to_numpy()
                for j, q in enumerate(qk):
                    best = np.lexsort((keys, -s[:, j]))
                    best = best[keys[best] != q][:k]
                    yield pd.DataFrame({"query": np.full(len(best), q), key: keys[best], "similarity": s[best, j]})

        found = rows.select(key, vector).mapInPandas(run, f"query long, {key} long, similarity double")
        out = found if out is None else out.unionByName(found)
    r = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), key))
    return out.withColumn("_r", r).where(F.col("_r") <= k).drop("_r")


def coreset(rows: DataFrame, key: str, vector: str, k: int, block: int = 2000) -> DataFrame:
    """``k`` rows by greedy facility location; no task ever holds more than about ``block`` rows.

    Up to one block the greedy choice is exact.  Beyond, each of several blocks by hash picks
    ``k`` rows and the picks are picked from again, as long as all picks fit into one block;
    where ``k`` is too large for that, each block picks its share of ``k`` and that is the
    result.  Ties: smaller key.
    """
    n = rows.count()
    parts = max(1, -(-n // block))

    def greedy(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        v = np.stack(pdf[vector].to_numpy()).astype(np.float64)
        m = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(m == 0, 1, m)
        sim = np.clip(v @ v.T, 0, 1)
        best, chosen = np.zeros(len(v)), []
        for _ in range(min(most, len(v))):
            gain = np.maximum(sim, best[None, :]).sum(1) - best.sum()
            gain[chosen] = -1
            i = int(np.round(gain, 9).argmax())
            chosen.append(i)
            best = np.maximum(best, sim[i])
        return pdf.loc[chosen, [key, vector]]

    x = cut(rows.select(key, vector).withColumn("_b", F.pmod(F.xxhash64(key), F.lit(parts))))
    shared = parts > 1 and parts * k > block
    sizes = sorted((r[0], r[1]) for r in x.groupBy("_b").agg(F.count("*")).collect()) if shared else []  # one row a block
    quota = {b: k * c // n for b, c in sizes}
    for b in sorted(quota)[: k - sum(quota.values())]:
        quota[b] += 1
    kind = rows.schema[vector].dataType.simpleString()
    of_block = lambda pdf: greedy(pdf.drop(columns="_b"), quota.get(int(pdf["_b"].iloc[0]), k))
    x = x.groupBy("_b").applyInPandas(of_block, f"{key} long, {vector} {kind}")
    if parts > 1 and not shared:
        x = cut(x).withColumn("_b", F.lit(0)).groupBy("_b").applyInPandas(of_block, f"{key} long, {vector} {kind}")
    return x.select(key)


def similar_vectors(rows: DataFrame, key: str, vector: str, threshold: float, block: int = 2000) -> DataFrame:
    """``(a, b, similarity)``, ``a < b``: all pairs of rows with cosine similarity ``threshold`` or more, exact.

    Every two blocks of rows meet in one task that multiplies them and gives out only what
    reaches the threshold; the work is quadratic in the rows, the memory of a task is not.
    """
    parts = max(1, -(-rows.count() // block))
    x = rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("v is not null").withColumn("b", F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int"))
    x = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("k", "v", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        m = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(m == 0, 1, m)
        k, side = pdf["k"].to_numpy(), (pdf["b"] == pdf["j"]).to_numpy()
        left, right = (np.arange(len(k)),) * 2 if (pdf["i"] == pdf["j"]).iloc[0] else (np.flatnonzero(~side), np.flatnonzero(side))
        s = np.round(v[left] @ v[right].T, 9)
        p, q = np.nonzero(s >= threshold)
        a, b = k[left[p]], k[right[q]]
        ok = a < b if left is right else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok], "similarity": s[p, q][ok]})

    return x.groupBy("i", "j").applyInPandas(cell, "a long, b long, similarity double")


def semantic_groups(rows: DataFrame, key: str, vector: str, threshold: float = 0.88) -> DataFrame:
    """``(key, component, to_centre, kept)``: components of similar rows; the row nearest to its component's centre is kept (smaller key on ties)."""
    comp = connected_components(similar_vectors(rows, key, vector, threshold), "a", "b")
    x = rows.select(key, vector).join(comp.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", key))
    unit = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, e: s + e.cast("double") * e))
    x = cut(x.withColumn("u", F.transform(vector, lambda e: e.cast("double") / F.when(unit == 0, 1.0).otherwise(unit))))
    centre = x.select("component", F.posexplode("u").alias("i", "e")).groupBy("component", "i").agg(F.avg("e").alias("e"))
    centre = centre.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda z: z["e"]).alias("c"))
    y = x.join(centre, "component").withColumn("to_centre", F.round(cosine(F.col("u"), F.col("c")), 9))
    best = y.groupBy("component").agg(F.min_by(key, F.struct(-F.col("to_centre"), key)).alias("best"))
    return y.join(best, "component").select(key, "component", "to_centre", (F.col(key) == F.col("best")).alias("kept"))


def hash_rank(key: Column, seed: str) -> Column:
    """Reproducible random order."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(seed)))


def split(rows: DataFrame, key: str, train: float = 0.8, validation: float = 0.1, seed: str = "42") -> DataFrame:
    """Adds ``split`` by ranges of the key's hash: stable under growth, without any sort or shuffle."""
    u = F.conv(F.substring(hash_rank(F.col(key), seed), 1, 8), 16, 10).cast("double") / 2**32
    return rows.withColumn("split", F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test"))


def balanced(rows: DataFrame, key: str, label: str, cap: int, floor: int, seed: str = "42") -> DataFrame:
    """At most ``cap`` rows of a class in hash order; classes below ``floor`` repeat rows in turn (``copy`` from 0)."""
    x = ranked(rows, [label], [hash_rank(F.col(key), seed), key]).where(F.col("_rank") < cap)
    copies = F.when(F.col("_size") < floor, F.floor((floor - F.col("_rank") - 1) / F.col("_size")) + 1).otherwise(1).cast("int")
    return x.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_size", "_rank")


def active_subset(points: DataFrame, key: str, ratio: float = 0.2, seed: str = "42") -> DataFrame:
    """All ambiguous and a share (one at least) of the easy points; hard ones stay out."""
    x = ranked(points, ["region"], [hash_rank(F.col(key), seed), key])
    quota = F.greatest(F.lit(1), F.round(F.col("_size") * ratio))
    return x.where((F.col("region") == "ambiguous") | ((F.col("region") == "easy") & (F.col("_rank") < quota))).drop("_size", "_rank")


def runaway(text: Column, most: int = 7, least: int = 4, repeats: int = 4) -> Column:
    """Whether an n-gram of ``least`` to ``most`` words stands ``repeats`` times in a row."""
    hit = F.lit(False)
    for n in range(least, most + 1):
        hit = hit | text.rlike(rf"(?i)(?:^|\s)((?:\S+\s+){{{n - 1}}}\S+)(?:\s+\1){{{repeats - 1},}}(?:\s|$)")
    return F.coalesce(hit, F.lit(False))


def preference_pairs(rows: DataFrame, held_out: DataFrame, key: str = "sample_id") -> DataFrame:
    """Pairs whose texts are there and differ, outside the held-out keys, one per key, with a bucket by task."""
    x = rows.where("chosen is not null and rejected is not null and trim(chosen) <> '' and chosen <> rejected").join(held_out.select(key).distinct(), key, "left_anti")
    task = F.col("metadata.task_type")
    bucket = F.when(task.startswith("EXTRACT"), "structure").when(F.col("metadata.is_hard_negative"), "negative").when(task == "SUPPLY_QA", "answer").otherwise("prose")
    return x.withColumn("bucket", bucket).withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("record_no"))).where("_r = 1").drop("_r")
