"""The folds as streams: ordered state by key, event-time windows, bounded state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seqloom.operators.statistics import LIMIT
from seqloom.plans.registry import query, table


def _shared(spark: SparkSession) -> str:
    """A new folder for a stream's sink and checkpoint: in the shared folder, or a temporary one where all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return f"{(found or tempfile.mkdtemp(prefix='seqloom-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and read its sink as a table."""
    spark, at = stream.sparkSession, _shared(stream.sparkSession)
    writer = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode(mode)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def ema_stream(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Each user's capped running estimate, kept in state across batches; a row for each user and batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p, n, seen = state.get if state.exists else (0.5, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for hit in (rows["event_type"] == "click").astype(float):
            p += (hit - p) / (n + 1)
            n = min(n + 1, limit - 1)
        seen += len(rows)
        state.update((float(p), int(n), int(seen)))
        yield pd.DataFrame({"user_id": [key[0]], "p": [round(float(p), 6)], "seen": [seen]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, p double, seen long", "p double, n int, seen long", "append", GroupStateTimeout.NoTimeout)


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, as a stream takes a single file only by one
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


@query("stream_ema_per_user", "ST1 ST2 ST3 ST5", f"""SELECT user_id, round(list_reduce(list_prepend(struct_pack(p := 0.5e0, n := 0), list(struct_pack(p := CASE WHEN event_type = 'click' THEN 1.0e0 ELSE 0.0e0 END, n := 0) ORDER BY ts, event_id)),
      lambda a, x: struct_pack(p := a.p + (x.p - a.p) / (a.n + 1), n := least(a.n + 1, {LIMIT - 1}))).p, 6) AS p, count(*) AS seen FROM events GROUP BY user_id""")
def stream_ema_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capped estimate as a stream: the last row of each user is the batch answer."""
    found = run_available(ema_stream(_read(spark, sf_dir)))
    return found.groupBy("user_id").agg(F.max_by("p", "seen").alias("p"), F.max("seen").alias("seen"))


@query("stream_daily_counts", "ST8 ST6", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE ts < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows of a day with a watermark; the last day is still open, so it isn't there."""
    own = _read(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", "0 seconds")
    days = own.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return run_available(days.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n"))


@query("session_islands", "ST7 ST8", "WITH t AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), i AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM t) SELECT user_id, count(DISTINCT s) AS sessions, count(*) AS n FROM i GROUP BY user_id")
def session_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events with gaps under six hours."""
    own = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    sessions = own.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return sessions.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").cast("bigint").alias("n"))
