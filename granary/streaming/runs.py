"""Incremental runs: the batch operators in Structured Streaming, with state where it is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.sources.snapshots import Store


def first_seen(stream: DataFrame, key: str = "item_id", time: str | None = None, expire: str | None = None) -> DataFrame:
    """Rows of keys not seen before. With a time and an expiry the state of a key is dropped after it; else it stays for ever."""
    if time and expire:
        return stream.withWatermark(time, expire).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def recent(rows: DataFrame, as_of: Column, hours: int = 24, time: str = "published_ts", other: str = "collected_ts") -> DataFrame:
    """Rows not older than some hours before as_of; rows without any time stay."""
    t = F.coalesce(time, other)
    return rows.filter(t.isNull() | (t >= as_of - F.expr(f"INTERVAL {hours} HOURS")))


def age_band(rows: DataFrame, as_of: Column, low: int = 48, high: int = 168, time: str = "published_ts") -> DataFrame:
    age = (F.unix_micros(as_of) - F.unix_micros(F.col(time))) / 3.6e9
    return rows.filter(age.between(low, high))


def tumbling(events: DataFrame, every: str = "1 day", time: str = "ts", late: str | None = None) -> DataFrame:
    return _windowed(events, F.window(time, every), time, late)


def sliding(events: DataFrame, length: str = "72 hours", step: str = "24 hours", time: str = "ts", late: str | None = None) -> DataFrame:
    return _windowed(events, F.window(time, length, step), time, late)


def _windowed(events: DataFrame, w: Column, time: str, late: str | None) -> DataFrame:
    if late:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", time: str = "ts", late: str | None = None) -> DataFrame:
    if late:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return events.groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_into(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, micro-batch by micro-batch, upserted by key; a batch that runs again changes nothing."""
    return stream.writeStream.foreachBatch(lambda rows, _: store.upsert(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
