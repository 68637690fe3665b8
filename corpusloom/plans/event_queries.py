"""Queries over run logs and metric events, in batch and as streams.

Events become a log: the user is the run, the event type picks agent and level,
the value is the loss or latency, the property ``k`` the epoch or error code.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import events as E
from corpusloom.plans.registry import query, rounded, table
from corpusloom.session import scratch_path
from corpusloom.streaming import logs as S

# The schema the event files have on disk.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
AGENTS = {
    "signup": ("DatasetAgent", "WARN"),
    "error": ("ValidationAgent", "ERROR"),
    "click": ("PreprocessingAgent", "INFO"),
    "purchase": ("TrainingAgent", "METRIC"),
    "view": ("EvaluationAgent", "INFO"),
}


def _pick(position: int) -> Column:
    chosen = None
    for kind, names in AGENTS.items():
        test = F.col("event_type") == kind
        chosen = F.when(test, names[position]) if chosen is None else chosen.when(test, names[position])
    return chosen


def as_log(events: DataFrame) -> DataFrame:
    """Event rows, batch or streaming, as log rows."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    metric, faulty = F.col("level") == "METRIC", F.col("level").isin("ERROR", "WARN")
    entries = F.array(
        F.struct(F.lit("step").alias("k"), F.when(metric, F.col("event_id").cast("string")).alias("v")),
        F.struct(F.lit("epoch").alias("k"), F.when(metric & (F.col("k") > 20), F.col("k").cast("string")).alias("v")),
        F.struct(F.lit("loss").alias("k"), F.when(metric, F.col("value").cast("string")).alias("v")),
        F.struct(F.lit("error_code").alias("k"), F.when(faulty, F.concat(F.lit("E"), F.floor(F.col("k") / 10))).alias("v")),
    )
    shaped = events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("run_"), "user_id").alias("run_id"),
        _pick(0).alias("agent"), _pick(1).alias("level"), F.col("event_type").alias("message"),
        "value", k.alias("k"),
    )
    metadata = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    return shaped.withColumn("metadata", metadata)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_log(table(spark, sf_dir, "events"))


def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A file stream watches a folder or a pattern, not a single file.
    return as_log(S.read_events(spark, os.path.join(sf_dir, "events.parque[t]"), EVENT_SCHEMA))


#: A replayed stream is delivered in three slices of time.
SLICES = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")


def time_slices(events: DataFrame) -> list[DataFrame]:
    """The events before, between and after the times of ``SLICES``."""
    times = [None, *[F.lit(t).cast("timestamp_ntz") for t in SLICES], None]
    ts, out = F.col("ts"), []
    for begin, end in zip(times, times[1:], strict=False):
        rows = events if begin is None else events.where(ts >= begin)
        out.append(rows if end is None else rows.where(ts < end))
    return out


def replayed(
    spark: SparkSession, sf_dir: str, follow: Callable[[DataFrame, str], DataFrame], slices: list[DataFrame] | None = None
) -> DataFrame:
    """What ``follow(stream, root)`` gives in the end, called anew after each slice of the events with the same ``root``."""
    root = scratch_path(spark, "replayed")
    delivered = f"{root}/delivered"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = lambda: S.read_events(spark, delivered, EVENT_SCHEMA)
    return S.replay(slices or time_slices(events), delivered, lambda: follow(stream(), f"{root}/result"))


def _sql_case(position: int) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v[position]}'" for k, v in AGENTS.items()) + " END"


_LOG = f"""
  (SELECT event_id, ts, 'run_' || user_id AS run_id, {_sql_case(0)} AS agent, {_sql_case(1)} AS level,
          event_type AS message, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
"""


def stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _sql_stamp(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


# --- publishing and reading -------------------------------------------------


def _published(events: DataFrame) -> DataFrame:
    base = {"timestamp": "ts", "run_id": "run_id", "agent": "agent", "level": "level", "message": "message"}
    records = events.select("*", F.struct("k").alias("context"), (F.col("k") > 50).alias("late"))
    # ``message`` as metadata replaces the fixed field of the same name.
    shadowed = records.withColumn("fixed_message", F.lit("event")).withColumn("base_ts", F.col("ts"))
    return E.log_records(
        shadowed, {**base, "message": "fixed_message", "timestamp": "base_ts"},
        ["event_id", "message", "value", "context", "late"],
    )


_PUBLISHED = f"""
    SELECT run_id, CAST(event_id AS VARCHAR) AS event_id, agent, level, message,
           '{{"k":' || k || '}}' AS context, CASE WHEN k > 50 THEN 'True' ELSE 'False' END AS late,
           replace({_sql_stamp('ts')}, ' ', 'T') AS second
    FROM {_LOG}
"""


def _flat_record(records: DataFrame) -> DataFrame:
    d = F.col("data")
    names = ["event_id", "agent", "level", "message", "context", "late"]
    return records.select("run_id", *[d[n].alias(n) for n in names], F.left(d["timestamp"], F.lit(19)).alias("second"))


@query(_PUBLISHED)
def publish_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_record(_published(log(spark, sf_dir)))


@query(_PUBLISHED)
def publish_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records, published by a stream to JSON files and read back."""
    root = scratch_path(spark, "published")
    records = _published(log_stream(spark, sf_dir))
    S.publish(records, f"{root}/rows", f"{root}/state").awaitTermination()
    return _flat_record(spark.read.schema(records.schema).json(f"{root}/rows"))


@query(f"SELECT event_id, agent, level FROM {_LOG} WHERE run_id = 'run_7'")
def consume_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run followed from the start of the stream, by a reader that stops and resumes after each slice of it."""

    def follow(events: DataFrame, root: str) -> DataFrame:
        return S.append_result(E.for_run(as_log(events), "run_7").select("event_id", "agent", "level"), "followed", root)

    return replayed(spark, sf_dir, follow)


@query(f"SELECT event_id, agent, level FROM {_LOG} WHERE run_id = 'run_7' AND ts > TIMESTAMP '2024-01-15 00:00:00'")
def consume_new_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.lit("2024-01-15 00:00:00").cast("timestamp")
    followed = E.for_run(log_stream(spark, sf_dir), "run_7", since).select("event_id", "agent", "level")
    return S.append_result(followed, "followed")


@query(
    f"""
    WITH p AS (SELECT event_id, unnest([
        {{'key': 'agent', 'text': agent}}, {{'key': 'level', 'text': level}}, {{'key': 'message', 'text': message}},
        {{'key': 'run_id', 'text': run_id}}, {{'key': 'event_id', 'text': CAST(event_id AS VARCHAR)}},
        {{'key': 'context', 'text': '{{"k":' || k || '}}'}}, {{'key': 'late', 'text': CASE WHEN k > 50 THEN 'True' ELSE 'False' END}},
        {{'key': 'timestamp', 'text': replace(CAST(ts AS VARCHAR), ' ', 'T')}}, {{'key': 'value', 'text': CAST(value AS VARCHAR)}}
      ]) AS e FROM {_LOG})
    SELECT e.key AS key,
           CASE WHEN NOT json_valid(e.text) THEN 'string'
                WHEN json_type(e.text) = 'OBJECT' THEN 'object'
                WHEN json_type(e.text) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' ELSE 'string' END AS kind,
           count(*) AS n, count(DISTINCT e.text) AS distinct_texts
    FROM p WHERE e.text IS NOT NULL GROUP BY 1, 2
    """
)
def parse_event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every published value read back, as JSON where it is JSON."""
    parsed = E.parse_values(_published(log(spark, sf_dir)), ["run_id"])
    counted = parsed.groupBy("key", "kind", "text").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("key", "kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct_texts"))


@query(
    f"""
    SELECT run_id, event_id, position, count(*) OVER (PARTITION BY run_id) AS total
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS position FROM {_LOG})
    WHERE position <= 20
    """
)
def log_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = E.log_history(log(spark, sf_dir), 20)
    return history.select("run_id", "event_id", F.col("position").cast("bigint").alias("position"), "total")


_NOW = "2024-02-05 12:00:00"


@query(
    f"""
    SELECT event_id, run_id FROM {_LOG}
    WHERE run_id IN (SELECT run_id FROM {_LOG} GROUP BY run_id
                     HAVING max(ts) >= TIMESTAMP '{_NOW}' - INTERVAL 7 DAY)
    """
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(_NOW).cast("timestamp")
    return E.retained(log(spark, sf_dir), now).select("event_id", "run_id")


_DELAY = "1 hour"


@query(
    f"""
    WITH e AS (SELECT user_id || '_' || event_type AS run_id, ts FROM events),
    g AS (SELECT *, CASE WHEN ts - lag(ts) OVER o > INTERVAL 7 DAY THEN 1 ELSE 0 END AS anew FROM e WINDOW o AS (PARTITION BY run_id ORDER BY ts)),
    l AS (SELECT *, sum(anew) OVER (PARTITION BY run_id ORDER BY ts) AS life FROM g),
    lives AS (SELECT run_id, life, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM l GROUP BY run_id, life)
    SELECT run_id, {_sql_stamp('first_ts')} AS first_ts, {_sql_stamp('last_ts')} AS last_ts,
           {_sql_stamp('last_ts + INTERVAL 7 DAY')} AS expired_at, events
    FROM lives a
    WHERE EXISTS (SELECT 1 FROM lives b WHERE b.run_id = a.run_id AND b.life > a.life)
       OR last_ts + INTERVAL 7 DAY < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
    """
)
def retention_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs (a user's events of one type) that expire while the events come in, in several resumed micro-batches.

    A life that a later one followed has expired; the last life of a run has if
    the watermark passed its expiry.
    """

    def follow(events: DataFrame, root: str) -> DataFrame:
        runs = events.select(
            F.concat_ws("_", F.col("user_id").cast("string"), "event_type").alias("run_id"), F.col("ts").cast("timestamp").alias("ts")
        )
        return S.append_result(E.expired_runs(runs, delay=_DELAY), "expired", root)

    expired = replayed(spark, sf_dir, follow)
    return expired.select("run_id", stamp("first_ts"), stamp("last_ts"), stamp("expired_at"), "events")


@query(
    f"""
    SELECT event_id, run_id FROM {_LOG}
    WHERE run_id NOT IN (SELECT run_id FROM {_LOG} WHERE level = 'ERROR' AND k >= 90)
    """
)
def delete_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete the runs that reported a grave error."""
    rows = log(spark, sf_dir)
    return E.delete_runs(rows, rows.where("level = 'ERROR' AND k >= 90")).select("event_id", "run_id")


# --- metrics ----------------------------------------------------------------


@query(
    f"""
    SELECT event_id, run_id, event_id AS step, CAST(CASE WHEN k > 20 THEN k ELSE 0 END AS DOUBLE) AS epoch, value AS loss
    FROM {_LOG} WHERE level = 'METRIC'
    """
)
def training_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.training_metrics(log(spark, sf_dir)).select("event_id", "run_id", "step", "epoch", "loss")


_GAUGE = f"SELECT run_id, arg_max(value, row(ts, event_id)) AS value FROM {_LOG} GROUP BY run_id"


@query(_GAUGE)
def gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gauge(log(spark, sf_dir), ["run_id"], "value")


@query(_GAUGE)
def gauge_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept live: each slice of the stream writes the rows it changes, and the next call resumes."""
    live = E.live_gauge(["run_id"], "value")
    return replayed(spark, sf_dir, lambda events, root: live.whole(S.live_result(live.parts(as_log(events)), live.keys, "gauge", root)))


_COUNTER = f"SELECT agent, level, count(*) AS total FROM {_LOG} GROUP BY agent, level"


@query(_COUNTER)
def counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.counter(log(spark, sf_dir), ["agent", "level"])


@query(_COUNTER)
def counter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = E.live_counter(["agent", "level"])
    return live.whole(S.live_result(live.parts(log_stream(spark, sf_dir)), live.keys, "counter"))


_HISTOGRAM = " UNION ALL ".join(
    f"SELECT agent, '{b}' AS le, count(*) FILTER (value <= {b}) AS n, round(sum(value), 4) AS sum FROM {_LOG} GROUP BY agent"
    for b in E.LATENCY_BOUNDS
) + f" UNION ALL SELECT agent, '+Inf', count(value), round(sum(value), 4) FROM {_LOG} GROUP BY agent"


@query(_HISTOGRAM)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = E.histogram(log(spark, sf_dir), "value", labels=["agent"])
    return buckets.select("agent", "le", "n", rounded("sum", 4))


@query(_HISTOGRAM)
def histogram_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = E.live_histogram("value", labels=["agent"])
    counts = live.whole(S.live_result(live.parts(log_stream(spark, sf_dir)), live.keys, "histogram"))
    return E.histogram_rows(counts, labels=["agent"]).select("agent", "le", "n", rounded("sum", 4))


def _states(events: DataFrame) -> DataFrame:
    status = F.when(F.col("k") < 10, "failed").when(F.col("k") < 60, "completed").otherwise("running")
    code = F.when(F.col("k") < 10, F.concat(F.lit("E"), F.col("k")))
    return events.select(
        "run_id", "agent", "ts", "event_id", status.alias("status"), code.alias("error_code")
    )


_STATES = f"""
  (SELECT run_id, agent, CASE WHEN k < 10 THEN 'failed' WHEN k < 60 THEN 'completed' ELSE 'running' END AS status,
          CASE WHEN k < 10 THEN 'E' || k END AS error_code, ts AS updated_at
   FROM (SELECT *, row_number() OVER (PARTITION BY run_id, agent ORDER BY ts DESC, event_id DESC) AS r FROM {_LOG})
   WHERE r = 1)
"""
_STATE_ROWS = f"SELECT run_id, agent, status, error_code, {_sql_stamp('updated_at')} AS updated_at FROM {_STATES}"


@query(_STATE_ROWS)
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = E.run_states(_states(log(spark, sf_dir)))
    return states.select("run_id", "agent", "status", "error_code", stamp("updated_at"))


@query(_STATE_ROWS)
def run_states_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = E.live_run_states()
    states = live.whole(S.live_result(live.parts(_states(log_stream(spark, sf_dir))), live.keys, "states"))
    return states.select("run_id", "agent", "status", "error_code", stamp("updated_at"))


@query(
    f"""
    SELECT run_id, coalesce(string_agg(agent, ',' ORDER BY agent) FILTER (status = 'completed'), '') AS completed_agents,
           count(*) FILTER (status = 'completed') AS completed,
           arg_max(agent, row(updated_at, agent)) FILTER (status = 'running') AS current_agent, 5 AS total_agents,
           CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed'
                WHEN count(*) FILTER (status = 'completed') >= 5 THEN 'completed' ELSE 'running' END AS status
    FROM {_STATES} GROUP BY run_id
    """
)
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_progress(E.run_states(_states(log(spark, sf_dir))), len(AGENTS))


@query(
    f"""
    WITH m AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS r,
                      count(*) OVER (PARTITION BY run_id) AS n FROM {_LOG} WHERE level = 'METRIC')
    SELECT run_id, 'first' AS place, event_id, value FROM m WHERE r = 1
    UNION ALL SELECT run_id, 'middle', event_id, value FROM m WHERE n > 2 AND r = n // 2 + 1
    UNION ALL SELECT run_id, 'last', event_id, value FROM m WHERE r = n
    """
)
def curve_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.curve_sample(log(spark, sf_dir).where("level = 'METRIC'"), "value", ("1 day", "1 minute"))


_THROUGHPUT = f"""
    SELECT agent, {_sql_stamp('w')} AS window_start, count(*) AS events, round(count(*) / 86400.0, 9) AS events_per_second,
           round(sum(value) / 86400.0, 6) AS amount_per_second
    FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS w FROM {_LOG}) GROUP BY agent, w
"""


def _throughput_columns(windows: DataFrame) -> DataFrame:
    return windows.select(
        "agent", stamp("window_start"), "events", rounded("events_per_second", 9), rounded("amount_per_second")
    )


@query(_THROUGHPUT)
def windowed_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _throughput_columns(E.windowed_throughput(log(spark, sf_dir), "1 day", labels=["agent"], value="value"))


@query(_THROUGHPUT)
def windowed_throughput_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode, so that windows the watermark has not closed are there too; closed ones are state no more."""
    live = E.windowed_throughput(log_stream(spark, sf_dir).withWatermark("ts", _DELAY), "1 day", labels=["agent"], value="value")
    return _throughput_columns(S.live_result(live, ["agent", "window_start"], "throughput"))


@query(
    f"""
    WITH d AS (SELECT agent, time_bucket(INTERVAL 1 DAY, ts) AS w, count(*) AS events FROM {_LOG} GROUP BY ALL)
    SELECT agent, {_sql_stamp('w')} AS window_start, events FROM d
    WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
    """
)
def closed_windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: a window is written once, when the watermark has passed it."""
    late = log_stream(spark, sf_dir).withWatermark("ts", "1 hour")
    windows = E.windowed_throughput(late, "1 day", labels=["agent"])
    return S.append_result(windows, "closed").select("agent", stamp("window_start"), "events")


@query(
    f"""
    SELECT {_sql_stamp('w')} AS window_start, count(*) AS events FROM (
      SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS w FROM {_LOG})
    GROUP BY w
    """
)
def sliding_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = E.windowed_throughput(log(spark, sf_dir), "12 hours", "6 hours")
    return windows.select(stamp("window_start"), "events")


@query(
    f"""
    SELECT agent, level, 'E' || (k // 10) AS error_code, count(*) AS n
    FROM {_LOG} WHERE level IN ('ERROR', 'WARN') GROUP BY ALL
    """
)
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.error_summary(log(spark, sf_dir))


@query(
    f"""
    SELECT agent, level, 'E' || (k // 10) AS error_code, count(*) AS n
    FROM {_LOG} WHERE level IN ('ERROR', 'WARN') GROUP BY ALL
    """
)
def error_summary_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.try_element_at("metadata", F.lit("error_code")).alias("error_code")
    faults = log_stream(spark, sf_dir).where(F.col("level").isin("ERROR", "WARN")).select("ts", "agent", "level", code)
    live = E.live_counter(["agent", "level", "error_code"])
    return live.whole(S.live_result(live.parts(faults), live.keys, "errors")).withColumnRenamed("total", "n")
