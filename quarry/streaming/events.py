"""Streaming ingestion: decode, route, deduplicate, window; every sink is safe to replay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quarry.core.runtime import scratch

ENVELOPE = "raw_payload string, fetched_at string, source_hash string, _source string"


def file_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """Stream of the Parquet files named ``name`` in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 16).parquet(folder)


def kafka_stream(spark: SparkSession, servers: str, topic: str, most: int | None = None) -> DataFrame:
    """Stream of a Kafka topic from its start; offsets are kept by the query's checkpoint (needs the connector)."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    return (r.option("maxOffsetsPerTrigger", most) if most else r).load().select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset")


def routed(messages: DataFrame, value: str = "value") -> DataFrame:
    """Adds the decoded envelope and ``route``: processed, skipped_empty, dlt_malformed or dlt_missing_fields; never fails."""
    x = messages.withColumn("e", F.from_json(value, ENVELOPE, {"mode": "PERMISSIVE"}))
    e = F.col("e")
    broken = F.col(value).isNull() | ~F.trim(F.col(value)).startswith("{") | F.try_parse_json(F.col(value)).isNull()
    some = lambda c: F.coalesce(F.trim(e[c]), F.lit("")) != ""
    route = F.when(broken, "dlt_malformed").when(~(some("fetched_at") & some("source_hash")), "dlt_missing_fields").when(~some("raw_payload"), "skipped_empty").otherwise("processed")
    return x.withColumn("route", route)


def message_text(payload: Column) -> Column:
    """Title, summary and content of the inner JSON."""
    return F.concat_ws(" ", *[F.get_json_object(payload, f"$.{k}") for k in ("title", "summary", "content")])


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its rows from Parquet; state and rows live in the shared checkpoint folder.

    With ``mode`` complete or update each batch replaces the rows, so the last one is returned.
    """
    spark = stream.sparkSession
    rows = scratch(spark, "rows")

    def write(batch: DataFrame, number: int) -> None:
        # a replayed batch writes its own folder again
        batch.write.mode("overwrite").parquet(f"{rows}/batch={number}" if mode == "append" else rows)

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{rows}/batch=-1" if mode == "append" else rows)
    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", rows).parquet(rows).select(stream.columns)


def consumed(stream: DataFrame, rows: str, checkpoint: str) -> None:
    """One consumer group: its own checkpoint, rows committed after they were written."""
    stream.writeStream.format("parquet").option("path", rows).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def with_dead_letters(stream: DataFrame, good: str, dead: str, checkpoint: str) -> None:
    """Processed messages to one table, malformed and incomplete ones with their reason to another; replays overwrite their batch."""

    def split(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where("route = 'processed'").write.mode("overwrite").parquet(f"{good}/batch={number}")
        bad = batch.where(F.col("route").startswith("dlt_"))
        bad.withColumn("reason", F.substring_index("route", "dlt_", -1)).drop("route").write.mode("overwrite").parquet(f"{dead}/batch={number}")
        batch.unpersist()

    stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def keyed_failures(stream: DataFrame, key: str, failed: str, order: str, limit: int = 3) -> DataFrame:
    """``(key, consecutive, blacklisted)`` after each batch: failures since the last success, as keyed stream state.

    Rows of a key are read in order of ``order`` within a batch; the state is one number a key.
    """

    def step(group, frames, state):
        run = state.get[0] if state.exists else 0
        x = pd.concat(list(frames)).sort_values(order)
        ok = (~x[failed].to_numpy(bool)).nonzero()[0]
        run = run + len(x) if not len(ok) else len(x) - 1 - int(ok[-1])
        state.update((run,))
        yield pd.DataFrame({key: [group[0]], "consecutive": [run], "blacklisted": [run >= limit]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, failed, order).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, consecutive long, blacklisted boolean", "run long", "update", "NoTimeout")


def rate_limited(stream: DataFrame, key: str, at: str, capacity: float, per_second: float) -> DataFrame:
    """Adds ``granted``: a token bucket a key refills by ``per_second`` up to ``capacity``; a row takes one token or is refused.

    ``at`` is seconds.  The state is the bucket's level and time, so a key needs no more memory however many rows it has.
    """
    columns = stream.columns

    def step(group, frames, state):
        level, last = state.get if state.exists else (float(capacity), None)
        for x in frames:
            x = x.sort_values([at, *[c for c in columns if c not in (key, at)]])
            out = []
            for t in x[at]:
                level = min(capacity, level + max(0.0, t - last) * per_second) if last is not None else level
                last = t if last is None else max(last, t)
                out.append(level >= 1)
                level -= 1 if level >= 1 else 0
            yield x.assign(granted=out)
        state.update((level, float(last)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema) + ", granted boolean"
    return stream.groupBy(key).applyInPandasWithState(step, schema, "level double, last double", "append", "NoTimeout")


def write_once(stream: DataFrame, path: str, checkpoint: str, key: str):
    """Append rows whose key is new to a Parquet table; replays and repeated keys change nothing."""

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*[c for c in batch.columns]))).where("_r = 1").drop("_r")
        try:
            new = new.join(spark.read.parquet(path).select(key), key, "left_anti").select(batch.columns)
        except Exception as e:  # the table is not there yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failure_state(rows: DataFrame, key: str, order: list, failed: str, limit: int = 3) -> DataFrame:
    """``(key, consecutive, blacklisted)``: failures since the last success, batch twin of the keyed state."""
    w = W.partitionBy(key).orderBy(*order)
    x = rows.withColumn("_g", F.sum((~F.col(failed)).cast("int")).over(w)).withColumn("_last", F.max("_g").over(W.partitionBy(key)))
    return x.groupBy(key).agg(F.sum((F.col(failed) & (F.col("_g") == F.col("_last"))).cast("int")).alias("consecutive")).withColumn("blacklisted", F.col("consecutive") >= limit)
