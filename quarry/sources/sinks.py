"""Tables out: snapshots, insert-or-ignore, upsert, property overlay, daily logs, cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quarry.core.runtime import cut
from quarry.sources.files import exists


def write_snapshot(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Replace a snapshot; empty tables keep their schema."""
    nodes.write.mode("overwrite").option("compression", "snappy").parquet(f"{folder}/nodes.parquet")
    edges.write.mode("overwrite").option("compression", "snappy").parquet(f"{folder}/edges.parquet")


def insert_or_ignore(rows: DataFrame, path: str, key: str, order: list[str]) -> int:
    """Append rows with new keys, the first of each in ``order``; null keys are left out.  Returns how many."""
    spark = rows.sparkSession
    new = rows.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti").select(rows.columns)
    new = cut(new)
    new.write.mode("append").parquet(path)
    return new.count()


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the latest by ``order``, new rows before old ones on ties."""
    x = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    return x.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order), F.desc("_p")))).where("_r = 1").drop("_r", "_p")


def overlaid(old: DataFrame, new: DataFrame, key: str, props: str) -> DataFrame:
    """Maps of properties merged key by key: new entries win, others stay."""
    a, b = old.select(key, F.col(props).alias("_a")), new.select(key, F.col(props).alias("_b"))
    x = a.join(b, key, "full")
    kept = F.map_filter(F.coalesce("_a", F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.map_contains_key("_b", k), F.lit(False)))
    return x.select(key, F.map_concat(kept, F.coalesce("_b", F.create_map().cast("map<string,string>"))).alias(props))


def append_daily(rows: DataFrame, path: str, at: str) -> None:
    """Append to a table partitioned by the day of ``at``."""
    rows.withColumn("dt", F.date_format(F.col(at), "yyyyMMdd")).hint("rebalance", "dt").write.mode("append").partitionBy("dt").json(path)


def save_cursor(spark: SparkSession, path: str, value: str) -> None:
    spark.createDataFrame([(value,)], "since_checkpoint string").coalesce(1).write.mode("overwrite").json(path)


def load_cursor(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    row = spark.read.schema("since_checkpoint string").json(path).first()
    return row and row[0]


def restore_snapshot(spark: SparkSession, folder: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Replace the tables at ``target`` by a snapshot, stored by label and by relation; returns them."""
    spark.read.parquet(f"{folder}/nodes.parquet").repartition("label").write.mode("overwrite").partitionBy("label").parquet(f"{target}/nodes")
    spark.read.parquet(f"{folder}/edges.parquet").repartition("rel_type").write.mode("overwrite").partitionBy("rel_type").parquet(f"{target}/edges")
    return spark.read.parquet(f"{target}/nodes"), spark.read.parquet(f"{target}/edges")


def publish(rows: DataFrame, key: str, topic: str, servers: str | None = None, folder: str | None = None) -> None:
    """Rows as JSON messages to a Kafka topic (all replicas acknowledge, three retries, idempotent), or appended to ``folder``/``topic`` as key and value."""
    x = rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))
    if servers:
        w = x.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
        w.option("kafka.acks", "all").option("kafka.retries", "3").option("kafka.enable.idempotence", "true").save()
    else:
        x.write.mode("append").json(f"{folder}/{topic}")


def attached(rows: DataFrame, vectors: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with ``column`` taken from ``vectors`` where it has the key, else their own."""
    v = vectors.groupBy(key).agg(F.first(column).alias("_v"))
    return rows.join(v, key, "left").withColumn(column, F.coalesce("_v", column)).drop("_v")


def rendered(rows: DataFrame, columns: dict[str, int], order: list[str]) -> DataFrame:
    """``(line_no, line)`` of a fixed-width text table with a header and a rule; longer values are cut."""
    head = "| " + " | ".join(c.ljust(n)[:n] for c, n in columns.items()) + " |"
    rule = "|-" + "-|-".join("-" * n for n in columns.values()) + "-|"
    cell = [F.rpad(F.substring(F.coalesce(F.col(c).cast("string"), F.lit("-")), 1, n), n, " ") for c, n in columns.items()]
    body = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |")).alias("line"), F.row_number().over(W.orderBy(*order)).alias("n"))
    top = rows.sparkSession.createDataFrame([(1, head), (2, rule)], "line_no int, line string")
    return top.unionByName(body.select((F.col("n") + 2).alias("line_no"), "line"))
