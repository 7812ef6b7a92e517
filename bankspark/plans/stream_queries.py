"""Queries that run as streams to their end: an extension, with batch SQL as twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from bankspark import streaming
from bankspark.plans.bank_queries import DETECTORS
from bankspark.runtime import checkpoint_path
from bankspark.sources.tables import load_detectors


def _run(df: DataFrame, mode: str) -> DataFrame:
    """The stream's whole output, written to the shared folder and read again."""
    at = f"{checkpoint_path(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        streaming.run_to_parquet(df, f"{at}/out", f"{at}/state")
        return df.sparkSession.read.schema(df.schema).parquet(f"{at}/out")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    query = df.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/out")


def _plain(df: DataFrame) -> DataFrame:
    """Window bounds as timestamps without zone, like the tables'."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type."""
    events = streaming.read_parquet(spark, f"{sf_dir}/events.parquet")
    return _run(streaming.window_counts(events, "ts", "1 day", "30 days", ["event_type"]), "complete").transform(_plain)


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with gaps of twelve hours."""
    events = streaming.read_parquet(spark, f"{sf_dir}/events.parquet")
    return _run(streaming.session_counts(events, "ts", "12 hours", "30 days", ["user_id"]), "complete").transform(_plain)


def stream_distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users of the event stream, once each."""
    events = streaming.read_parquet(spark, f"{sf_dir}/events.parquet").where("user_id is not null").select("user_id", "ts")
    return _run(streaming.distinct_stream(events, ["user_id"], "ts", "3650 days").select("user_id"), "append")


def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the bank in a stream of documents."""
    docs = streaming.read_parquet(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = streaming.scan_stream(docs, "doc_id", "text", load_detectors(spark, sf_dir)).select("doc_id", "entity_id", "name_id", "pattern_id", "start", "end")
    return _run(rows, "append")


QUERIES = {f.__name__: f for f in (stream_window_counts, stream_sessions, stream_distinct_users, stream_scan)}
ORACLE = {
    "stream_window_counts": "SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS events FROM events GROUP BY ALL",
    "stream_sessions": """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS opens FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
        SELECT min(ts) AS window_start, max(ts) + INTERVAL 12 HOURS AS window_end, user_id, count(*) AS events FROM n GROUP BY user_id, s""",
    "stream_distinct_users": "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL",
    "stream_scan": f"""WITH {DETECTORS} SELECT doc_id, entity_id, name_id, pattern_id, CAST(bs AS BIGINT) AS "start", CAST(be AS BIGINT) AS "end" FROM won""",
}
