"""The log view: the driver's ``events`` table seen as an incident log.

Every ``events`` row becomes one log row of the store schema: service
``svc-<user_id mod 5>``, level from the event type, a message, a raw JSON
carrying a trace id per user and a request id per ``props.k``, and a position
``logs/part-<event_id mod 8>.jsonl`` line ``event_id div 8 + 1``.
The same text in DuckDB (``LOG_VIEW_SQL``) is the oracle's starting point.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logcase.plans.sizing import spread
from logcase.session import configure

N_SERVICES = 5
N_FILES = 8


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def log_view(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    eid = F.col("event_id")
    return events.select(
        eid,
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("svc-"), (F.col("user_id") % N_SERVICES).cast("string")).alias("service"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warn")
         .otherwise("info").alias("level"),
        F.concat(F.col("event_type"), F.lit(" k="), k).alias("msg"),
        F.concat(F.lit('{"trace_id":"tr_'), F.col("user_id").cast("string"), F.lit('","request_id":"req_'), k,
                 F.lit('","event_id":'), eid.cast("string"), F.lit("}")).alias("raw"),
        F.concat(F.lit("logs/part-"), (eid % N_FILES).cast("string"), F.lit(".jsonl")).alias("file"),
        (F.floor(eid / N_FILES).cast("bigint") + 1).alias("line"),
    )


def load_log_view(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    """``even``: the events are dealt evenly to tasks first, for CPU-heavy work on their lines."""
    configure(spark)
    events = load_table(spark, sf_dir, "events")
    return log_view(spread(events) if even else events)


LOG_VIEW_SQL = f"""
SELECT event_id, ts,
  concat('svc-', user_id % {N_SERVICES}) AS service,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' ELSE 'info' END AS level,
  concat(event_type, ' k=', json_extract_string(props, '$.k')) AS msg,
  concat('{{"trace_id":"tr_', user_id, '","request_id":"req_', json_extract_string(props, '$.k'),
         '","event_id":', event_id, '}}') AS raw,
  concat('logs/part-', event_id % {N_FILES}, '.jsonl') AS file,
  CAST(floor(event_id / {N_FILES}) AS BIGINT) + 1 AS line
FROM events
"""


def with_log_view(sql: str) -> str:
    """Prefix an oracle query with the log view as CTE ``log_events``."""
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH log_events AS ({LOG_VIEW_SQL}),\n{body[5:]}"
    return f"WITH log_events AS ({LOG_VIEW_SQL})\n{sql}"
