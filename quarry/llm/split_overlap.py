"""Problem 7: records of evaluation splits that also occur in the training split.

Exact overlaps: canonical text (lower case, letters and digits only, single spaces) is
hashed to 128 bits and evaluation hashes meet training hashes in one equi-join; where only
counts are asked for, training hashes are counted before they are joined, so a prompt
repeated in both splits is never multiplied out.  A plain hash cannot see near copies, which
the problem also asks for; they come from the exact prefix join over word shingles
(``prefix_join``), evaluation against training only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.core.runtime import cut, small_side
from quarry.llm import prefix_join
from quarry.llm.near_duplicates import text_sets, verified

TRAIN = "train"


def canonical(text: Column) -> Column:
    """Lower case, every run of other characters than letters and digits one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def canonical_hashes(rows: DataFrame, text: str = "prompt") -> DataFrame:
    """Adds ``ch``: 128-bit hash of the canonical text, of the trimmed text where that is empty."""
    c = canonical(F.col(text))
    return rows.withColumn("ch", F.substring(F.md5(F.when(c == "", F.trim(F.col(text))).otherwise(c)), 1, 32))


def exact_overlaps(rows: DataFrame, key: str = "record_no", split: str = "split", text: str = "prompt") -> DataFrame:
    """``(t, e)``: keys of a training and an evaluation record with equal canonical text."""
    x = canonical_hashes(rows.select(key, split, text).where(F.col(text).isNotNull()), text)
    ev = x.where(F.col(split) != TRAIN).select(F.col(key).alias("e"), "ch")
    tr = x.where(F.col(split) == TRAIN).select(F.col(key).alias("t"), "ch")
    return tr.join(ev, "ch").select("t", "e")


def exact_counts(rows: DataFrame, key: str = "record_no", split: str = "split", text: str = "prompt") -> DataFrame:
    """``(e, k)``: evaluation records with how many training records have their canonical text, where any has."""
    x = canonical_hashes(rows.select(key, split, text).where(F.col(text).isNotNull()), text)
    train = x.where(F.col(split) == TRAIN).groupBy("ch").agg(F.count("*").alias("k"))
    return x.where(F.col(split) != TRAIN).select(F.col(key).alias("e"), "ch").join(train, "ch").select("e", "k")


def _keys_and_counts(sets: DataFrame) -> DataFrame:
    """One pass over ``sets``: a row ``(cls, key)`` for each, and the pieces of the table that orders shingles."""

    def run(it):
        counts = np.zeros(1 << prefix_join.ORDER_BITS, np.int64)
        for b in it:
            counts += prefix_join.bucket_counts(b.column("hs").flatten().to_numpy(zero_copy_only=False).view(np.uint32))
            none = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("key"), none.cast(pa.int32()), none.cast(pa.binary())], ["cls", "key", "piece", "counts"])
        rows = prefix_join.count_pieces(counts) if counts.any() else []
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["cls", "key", "piece", "counts"])

    return sets.mapInArrow(run, "cls long, key long, " + prefix_join.COUNTS)


def near_overlaps(rows: DataFrame, threshold: float = 0.6, width: int = 3, key: str = "record_no", split: str = "split", text: str = "prompt") -> DataFrame:
    """``(t, e)``: pairs across splits whose distinct word shingles overlap to ``threshold`` or more."""
    sided = rows.select(key, text, (F.col(split) == TRAIN).alias("_train"))
    # The sets are large against the prompts and quick to make: only their keys are kept.
    sets = text_sets(sided, key, text, width, "_train")
    once = cut(_keys_and_counts(sets))
    m = once.where("piece is null").select("cls", "key")
    table = prefix_join.order_table(once.where("piece is not null").select("piece", "counts"))
    pairs = cut(prefix_join.candidates(sets, threshold, True, table))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    first = cut(m.join(ends, "cls", "left_semi").groupBy("cls").agg(F.min("key").alias(key)).select(key))
    # Texts of candidates only; broadcasting their keys, where few, spares a shuffle of all texts.
    wanted = text_sets(sided.join(small_side(first), key, "left_semi"), key, text, width, "_train")
    linked = verified(wanted, pairs, threshold)
    both = linked.join(m.select(F.col("cls").alias("a"), F.col("key").alias("ka")), "a").join(m.select(F.col("cls").alias("b"), F.col("key").alias("kb")), "b")
    train_a = F.col("a").bitwiseAND(1) == 1
    return both.select(F.when(train_a, F.col("ka")).otherwise(F.col("kb")).alias("t"), F.when(train_a, F.col("kb")).otherwise(F.col("ka")).alias("e"))


def overlaps(rows: DataFrame, threshold: float = 0.6, width: int = 3) -> DataFrame:
    """``(record_a, record_b)``, smaller first, of every exact or near overlap across splits.

    Null prompts and splits take no part; empty prompts equal each other; prompts of fewer
    than three words overlap only exactly.
    """
    p = exact_overlaps(rows).unionByName(near_overlaps(rows, threshold, width))
    return p.select(F.least("t", "e").alias("record_a"), F.greatest("t", "e").alias("record_b")).distinct()


def overlap_report(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(split, source, records, overlapping, pairs)`` per evaluation split and source."""
    meta = rows.where(F.col("split") != TRAIN).select(F.col("record_no").alias("e"), "split", F.col("metadata.provenance").alias("source"))
    ends = pairs.select(F.explode(F.array("record_a", "record_b")).alias("e"))
    hits = ends.groupBy("e").agg(F.count("*").alias("k"))
    return meta.join(hits, "e", "left").groupBy("split", "source").agg(
        F.count("*").alias("records"), F.count("k").alias("overlapping"), F.coalesce(F.sum("k"), F.lit(0)).alias("pairs")
    )
