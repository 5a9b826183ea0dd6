"""Structured Streaming forms of the stateful operators, over the events table as a file stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scrivan.runtime import shared_dir


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream, in event time with an hour of lateness allowed."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a table of the shared folder, and reads that."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def tumbling(spark: SparkSession, d: str) -> DataFrame:
    """(start, event_type, n): counts per six hours; the windows still open at the end are withheld."""
    g = events(spark, d).groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return drained(g).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


TUMBLING_SQL = "SELECT strftime(w, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS w, event_type FROM events) WHERE w + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY w, event_type"


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, start, n): sessions with gaps of twelve hours that have ended."""
    g = events(spark, d).groupBy(F.session_window("ts", "12 hours"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return drained(g).select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


SESSION_SQL = """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 12 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""


def alert_matches(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, alert): a stream joined with a static table of stored rules."""
    rules = spark.createDataFrame([("slow", "error", 50.0), ("big", "purchase", 80.0)], "alert string, event_type string, least double")
    return drained(events(spark, d).join(F.broadcast(rules), "event_type").where("value >= least").select("event_id", "alert"))


ALERT_SQL = "SELECT event_id, alert FROM events JOIN (VALUES ('slow', 'error', 50.0), ('big', 'purchase', 80.0)) r(alert, event_type, least) USING (event_type) WHERE value >= least"


def watch_rate(most: int, seconds: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """A stateful function: the events of a key that are its (most + 1)th or later in the seconds up to and with them."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # nothing of the key for a whole window: what is kept can't count any more
            state.remove()
            return
        kept: list[int] = list(state.get[0]) if state.exists else []
        rows = sorted((int(us), int(e)) for f in frames for us, e in zip(f.us, f.event_id))
        out = []
        for us, event in rows:
            kept = [x for x in kept if us - x <= seconds * 1_000_000] + [us]
            if len(kept) > most:
                out.append((event, len(kept)))
        state.update((kept,))
        state.setTimeoutTimestamp(max(kept[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "n"])

    return step


def rate_watch(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, n): users with more than six events in 24 hours, by arbitrary state per user."""
    s = events(spark, d).withColumn("us", F.unix_micros("ts")).select("user_id", "event_id", "us", "ts")
    out = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("n", T.LongType())])
    kept: Any = T.StructType([T.StructField("kept", T.ArrayType(T.LongType()))])
    return drained(s.groupBy("user_id").applyInPandasWithState(watch_rate(6, 86_400), out, kept, "append", GroupStateTimeout.EventTimeTimeout))


RATE_SQL = "SELECT event_id, n FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 6"


def upsert_stream(changes: DataFrame, target: str, key: str, order: str) -> None:
    """Applies a stream of changes to a table in batches: each batch is merged into a new version, then pointed to. A repeated batch gives the same table."""
    from scrivan.sources.files import merged

    spark = changes.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        previous = f"{target}/v{number - 1}" if number else None
        base = spark.read.parquet(previous) if previous else batch.limit(0)
        merged(base, batch, key, order).write.mode("overwrite").parquet(f"{target}/v{number}")

    changes.writeStream.foreachBatch(apply).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start().awaitTermination()


CATALOG = {
    "stream_tumbling": (tumbling, TUMBLING_SQL),
    "stream_sessions": (session_windows, SESSION_SQL),
    "stream_alerts": (alert_matches, ALERT_SQL),
    "stream_rate_watch": (rate_watch, RATE_SQL),
}
