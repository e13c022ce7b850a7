"""Streaming jobs run over the events file as it is now."""

from __future__ import annotations

import uuid


from lumaforge.session import ensure_checkpoint_dir
from lumaforge.streaming import arrivals as st
from lumaforge.workload.registry import query


def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # As a glob, so that one file is as good as a folder of part files.
    files = spark.readStream.schema(schema).parquet(f"{sf}/[e]vents.parquet")
    return files.selectExpr(
        "cast(ts AS timestamp) AS ts", "user_id AS camera", "event_type AS kind", "value AS size", "event_type = 'error' AS failed", "event_id % 50 AS hash"
    )


def _drained(spark, df, schema):
    """Run the stream into a new folder beside the checkpoints and read the table back."""
    base = f"{ensure_checkpoint_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    st.drain_to_table(df, f"{base}/out", f"{base}/ckpt")
    return spark.read.schema(schema).parquet(f"{base}/out")


@query("W3", "SELECT DISTINCT user_id AS camera, event_id % 50 AS hash FROM events")
def stream_dedup(spark, sf):
    """The file arrives as one batch, inside the time bound, so every key is kept exactly once."""
    kept = st.first_arrivals(_stream(spark, sf), ["camera", "hash"], within="1 hour").select("camera", "hash")
    return _drained(spark, kept, "camera bigint, hash bigint")


@query(
    "W4",
    """
    SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS bytes,
      count(*) FILTER (WHERE event_type = 'error') AS failures
    FROM events GROUP BY 1 HAVING time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour'
      <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '10 minutes' FROM events)
    """,
)
def arrival_metrics(spark, sf):
    """Closed windows only: in append mode a window is emitted once the watermark has passed its end."""
    out = st.arrival_metrics(_stream(spark, sf))
    done = _drained(spark, out, "start timestamp, n bigint, bytes double, failures bigint")
    return done.withColumn("start", done["start"].cast("timestamp_ntz"))


@query(
    "W4",
    """
    SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS bytes,
      count(*) FILTER (WHERE event_type = 'error') AS failures
    FROM events GROUP BY 1
    """,
)
def arrival_metrics_batch(spark, sf):
    """The same plan on a finished table: every window."""
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("cast(ts AS timestamp) AS ts", "value AS size", "event_type = 'error' AS failed")
    out = st.arrival_metrics(e)
    return out.withColumn("start", out["start"].cast("timestamp_ntz"))
