"""Run logs and metric events. Every function takes a batch or, where the
description says so, a streaming table with the columns

    event_id, ts, run_id, agent, level, message, metadata map<string,string>

A run may be as long as it likes: nothing here gathers a run into one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.positions import with_positions
from corpusloom.session import through_table

RETENTION_DAYS = 7
HISTORY_LIMIT = 1000
# Metric fields kept from a training log, and latency bucket bounds.
TRAINING_FIELDS = ("loss", "learning_rate", "grad_norm", "eval_loss", "eval_accuracy")
LATENCY_BOUNDS = (10, 50, 100, 200, 500, 1000)
_JSON_END = "corpusloom:end"


def _stringified(df: DataFrame, name: str) -> Column:
    """Value as log text: nested values as JSON, times in ISO form, the rest plainly."""
    dtype, value = df.schema[name].dataType, F.col(name)
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    if isinstance(dtype, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        iso = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.replace(iso, F.lit(".000000"), F.lit(""))
    return value.cast("string")


def log_records(df: DataFrame, base: Mapping[str, str], metadata: Sequence[str]) -> DataFrame:
    """(run_id, data map<string,string>): one published record per row. Works on streams.

    ``base`` maps the fixed fields (timestamp, run_id, agent, level, message) to
    columns. A metadata field of the same name replaces a fixed one; a missing
    metadata value is left out.
    """
    sources = {name: [column] for name, column in base.items()}
    for name in metadata:
        sources[name] = [name, *sources.get(name, [])]
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("k"), F.coalesce(*[_stringified(df, c) for c in columns]).alias("v"))
            for name, columns in sources.items()
        ]
    )
    data = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    return df.select(F.col(base["run_id"]).cast("string").alias("run_id"), data.alias("data"))


def _whole_json(text: Column) -> Column:
    """The text as a variant if all of it is one JSON value, else null.

    Spark's parser stops after the first value. A marker behind the text shows
    that nothing else was left. Texts that cannot begin a JSON value skip the parser.
    """
    may_be_json = text.rlike(r'^[ \t\r\n]*[-{\["0-9tfn]')
    closed = F.concat(F.lit("["), text, F.lit(f',"{_JSON_END}"]'))
    pair = F.try_parse_json(F.when(may_be_json, closed))
    whole = F.try_variant_get(pair, "$[1]", "string") == _JSON_END
    return F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))


def parse_values(records: DataFrame, keys: Sequence[str], data: str = "data") -> DataFrame:
    """Long form (…, key, kind, text, parsed): each value read as JSON, or else as text. Works on streams."""
    long = records.select(*keys, F.explode(data).alias("key", "text"))
    read = long.withColumn("json", _whole_json(F.col("text")))
    # Bare NaN and Infinity are numbers to the original reader.
    special = F.col("text").isin("NaN", "Infinity", "-Infinity")
    opening = F.left(F.ltrim("text", F.lit(" \t\r\n")), F.lit(1))
    kind = (
        F.when(special, "number")
        .when(F.col("json").isNull() | (opening == '"'), "string")
        .when(opening == "{", "object")
        .when(opening == "[", "array")
        .when(opening.isin("t", "f"), "boolean")
        .when(opening == "n", "null")
        .otherwise("number")
    )
    parsed = F.when(special, F.col("text").try_cast("double").cast("variant")).otherwise(
        F.coalesce("json", F.col("text").cast("variant"))
    )
    return read.select(*keys, "key", kind.alias("kind"), "text", parsed.alias("parsed"))


def for_run(log: DataFrame, run_id: str, since: Column | None = None) -> DataFrame:
    """Events of one run, all of them or only those after ``since``. Works on streams."""
    rows = log.where(F.col("run_id") == run_id)
    return rows if since is None else rows.where(F.col("ts") > since)


def log_history(log: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest ``limit`` events of every run, with their number as total; above 1000 is refused.

    Spark cuts each run to the limit before the shuffle, so a long run sends at
    most ``limit`` rows per map task.
    """
    if not 0 <= limit <= HISTORY_LIMIT:
        raise ValueError(f"need 0 <= limit <= {HISTORY_LIMIT}")
    order = Window.partitionBy("run_id").orderBy("ts", "event_id")
    oldest = log.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    return oldest.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("run_id")))


def retained(log: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Events of the runs whose last event is at most ``days`` old; a run expires as a whole."""
    alive = log.groupBy("run_id").agg(F.max("ts").alias("last")).where(
        F.col("last") >= now - F.make_dt_interval(F.lit(days))
    )
    return log.join(alive.select("run_id"), "run_id", "left_semi")


_DAY_US = 24 * 3600 * 1_000_000
_LIFE = "run_id string, first_us bigint, last_us bigint, events bigint"


#: States that runs are dealt to: a call of Python works through all runs of one of them.
BUCKETS = 1024


def _by_hour(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run and hour of each batch of rows: its newest time, its range and its number of events."""
    for rows in batches:
        hours = pa.Table.from_batches([rows]).group_by(["bucket", "run_id", "hour"], use_threads=False)
        out = hours.aggregate([("ts", "max"), ("us", "min"), ("us", "max"), ("us", "count")])
        out = out.select(["bucket", "run_id", "ts_max", "us_min", "us_max", "us_count"])
        yield from out.rename_columns(["bucket", "run_id", "ts", "first_us", "last_us", "events"]).to_batches()


def _expire(days: int):
    """Follows one run: closes a life when the next event, or the watermark, is more than ``days`` past its last event.

    The rule in plain form; :func:`_expire_many` follows it for many runs at once.
    """
    limit = days * _DAY_US

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed: list[tuple] = []
        if state.hasTimedOut:
            closed.append((key[0], *state.get))
            state.remove()
        else:
            # Plain numbers: a run has few rows here, and table operations on them cost more than all the rest.
            hours = [h for part in parts for h in zip(*(part[c].tolist() for c in ("first_us", "last_us", "events")), strict=True)]
            held = state.get if state.exists else None
            for first, last, n in sorted(hours):
                if held is not None and first - held[1] > limit:
                    closed.append((key[0], *held))
                    held = None
                held = (first, last, n) if held is None else (min(held[0], first), max(held[1], last), held[2] + n)
            due = (held[1] + limit) // 1000 + 1
            if due <= state.getCurrentWatermarkMs():
                closed.append((key[0], *held))
                if state.exists:
                    state.remove()
            else:
                state.update(held)
                state.setTimeoutTimestamp(due)
        if closed:
            yield pd.DataFrame(closed, columns=["run_id", "first_us", "last_us", "events"])

    return follow


_LIVES = pa.schema([("run_id", pa.string()), ("first_us", pa.int64()), ("last_us", pa.int64()), ("events", pa.int64())])


def _packed(lives: dict) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _LIVES, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(pa.table(lives, schema=_LIVES))
    return sink.getvalue().to_pybytes()


def _expire_many(days: int):
    """Follows the runs of a bucket by the rule of :func:`_expire`; the state holds the lives of all of them as one table."""
    limit = days * _DAY_US

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pa.ipc.open_stream(state.get[0]).read_all().to_pandas() if state.exists else None
        tables = [] if state.hasTimedOut else [part[_LIVES.names] for part in parts]
        n_held = 0 if held is None else len(held)
        rows = pd.concat([t for t in (held, *tables) if t is not None], ignore_index=True)
        run, names = pd.factorize(rows["run_id"])
        first, last, events = (rows[c].to_numpy() for c in ("first_us", "last_us", "events"))
        order = np.lexsort((first, np.arange(len(rows)) >= n_held, run))  # the life that is held comes first
        run, first, last, events = (c[order] for c in (run, first, last, events))
        other = np.concatenate([[True], run[1:] != run[:-1]])
        newest = pd.Series(last).groupby(run).cummax().to_numpy()
        anew = other.copy()
        anew[1:] |= first[1:] - newest[:-1] > limit
        begins = np.flatnonzero(anew)
        lives = {
            "run_id": np.asarray(names, dtype=object)[run[begins]], "first_us": np.minimum.reduceat(first, begins),
            "last_us": np.maximum.reduceat(last, begins), "events": np.add.reduceat(events, begins),
        }
        due = (lives["last_us"] + limit) // 1000 + 1
        followed = np.append(~other[begins[1:]], False)
        closed = followed | (due <= state.getCurrentWatermarkMs())
        if not closed.all():
            state.update((_packed({n: c[~closed] for n, c in lives.items()}),))
            state.setTimeoutTimestamp(int(due[~closed].min()))
        elif state.exists:
            state.remove()
        if closed.any():
            yield pd.DataFrame({n: c[closed] for n, c in lives.items()})

    return follow


def expired_runs(log: DataFrame, days: int = RETENTION_DAYS, delay: str = "1 hour") -> DataFrame:
    """Retention on a stream: (run_id, first_ts, last_ts, expired_at, events), once per life of a run.

    A run expires as a whole ``days`` after its last event, and lives anew if an
    event comes later. What is kept of a run is the range and number of its events.
    Runs are dealt to ``BUCKETS`` states, each with a timer at the first expiry of
    its runs, so that Python is called once per state and micro-batch and not per run.
    Events are first reduced to one row per run and hour where they are read, so a
    busy run sends few rows to its state. An hour whose newest event is more than
    ``delay`` behind the newest of all is dropped.
    """
    rows = log.select(F.col("run_id").cast("string").alias("run_id"), "ts", F.unix_micros("ts").alias("us")).where("ts IS NOT NULL AND run_id IS NOT NULL")
    bucket, hour = F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).cast("int"), F.col("us") - F.pmod("us", F.lit(3_600_000_000))
    hours = rows.select(bucket.alias("bucket"), "run_id", hour.alias("hour"), "ts", "us").mapInArrow(
        _by_hour, "bucket int, run_id string, ts timestamp, first_us bigint, last_us bigint, events bigint"
    )
    lives = hours.withWatermark("ts", delay).groupBy("bucket").applyInPandasWithState(
        _expire_many(days), _LIFE, "lives binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    expired = F.timestamp_micros(F.col("last_us") + days * _DAY_US)
    return lives.select(
        "run_id", F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"),
        expired.alias("expired_at"), "events",
    )


def training_metrics(log: DataFrame) -> DataFrame:
    """Metric events as typed columns; a missing epoch reads as 0. Works on streams."""

    def number(name: str, dtype: str) -> Column:
        return F.try_element_at("metadata", F.lit(name)).try_cast(dtype)

    return log.where(F.col("level") == "METRIC").select(
        "event_id", "ts", "run_id",
        number("step", "bigint").alias("step"),
        F.coalesce(number("epoch", "double"), F.lit(0.0)).alias("epoch"),
        *[number(name, "double").alias(name) for name in TRAINING_FIELDS],
    )


def gauge(events: DataFrame, labels: Sequence[str], value: str) -> DataFrame:
    """Latest value per label set, ties by event_id. Works on streams."""
    return events.groupBy(*labels).agg(
        F.max_by(value, F.struct("ts", "event_id")).alias("value")
    )


def counter(events: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Events per label set. Works on streams."""
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("total"))


def histogram(
    events: DataFrame, value: str, bounds: Sequence[float] = LATENCY_BOUNDS, labels: Sequence[str] = ()
) -> DataFrame:
    """Cumulative buckets (labels…, le, n) with the infinite one last, and total sum. Works on streams."""
    return histogram_rows(events.groupBy(*labels).agg(*_histogram_counts(value, bounds)), bounds, labels)


def _histogram_counts(value: str, bounds: Sequence[float]) -> list[Column]:
    counts = [F.count_if(F.col(value) <= F.lit(b)).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return [*counts, F.count(value).alias("le_all"), F.coalesce(F.sum(value), F.lit(0.0)).alias("sum")]


def histogram_rows(counts: DataFrame, bounds: Sequence[float] = LATENCY_BOUNDS, labels: Sequence[str] = ()) -> DataFrame:
    """One row per label set and bucket, from one row per label set."""
    entries = [
        F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("n"), F.col("sum")) for i, b in enumerate(bounds)
    ]
    entries.append(F.struct(F.lit("+Inf").alias("le"), F.col("le_all").alias("n"), F.col("sum")))
    return counts.select(*labels, F.inline(F.array(*entries)))


def run_states(states: DataFrame) -> DataFrame:
    """Last state per (run, agent) from (run_id, agent, ts, event_id, status, error_code). Works on streams."""
    last = F.max_by(F.struct("status", "error_code"), F.struct("ts", "event_id"))
    return states.groupBy("run_id", "agent").agg(last.alias("last"), F.max("ts").alias("updated_at")).select(
        "run_id", "agent", "last.status", "last.error_code", "updated_at"
    )


def _per_bucket(events: DataFrame, labels: Sequence[str], width: str, delay: str, parts: Sequence[Column]) -> DataFrame:
    watched = events.withWatermark("ts", delay) if events.isStreaming else events
    return watched.groupBy(*labels, F.window("ts", width).alias("bucket")).agg(*parts)


class Live:
    """A figure per label set in two steps, so that a stream keeps little state.

    ``parts`` sums the events up per label set and time bucket: only buckets that
    the watermark has not closed are state. ``whole`` merges the buckets of a label
    set, from the table that :func:`corpusloom.streaming.logs.live_result` keeps.
    """

    def __init__(self, labels: Sequence[str], parts: Sequence[Column], merged: Sequence[Column]):
        self.labels, self._parts, self._merged = list(labels), list(parts), list(merged)
        self.keys = [*self.labels, "bucket"]

    def parts(self, events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
        return _per_bucket(events, self.labels, width, delay, self._parts)

    def whole(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy(*self.labels).agg(*self._merged)


def live_gauge(labels: Sequence[str], value: str) -> Live:
    """The latest value, as :func:`gauge`."""
    last = F.max(F.struct("ts", "event_id", F.col(value).alias("value")))
    return Live(labels, [last.alias("last")], [F.max("last").getField("value").alias("value")])


def live_counter(labels: Sequence[str]) -> Live:
    """The number of events, as :func:`counter`."""
    return Live(labels, [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("total")])


def live_histogram(value: str, bounds: Sequence[float] = LATENCY_BOUNDS, labels: Sequence[str] = ()) -> Live:
    """Bucket counts and sum; :func:`histogram_rows` gives the rows of :func:`histogram`."""
    parts = _histogram_counts(value, bounds)
    names = [*[f"le_{i}" for i in range(len(bounds))], "le_all", "sum"]
    return Live(labels, parts, [F.sum(n).alias(n) for n in names])


def live_run_states() -> Live:
    """The last state per run and agent, as :func:`run_states`."""
    last = F.max(F.struct("ts", "event_id", "status", "error_code"))
    return Live(
        ["run_id", "agent"], [last.alias("last")],
        [*[F.max("last").getField(n).alias(n) for n in ("status", "error_code")], F.max("last").getField("ts").alias("updated_at")],
    )


def run_progress(latest: DataFrame, total_agents: int) -> DataFrame:
    """Per run: completed agents, the agent at work, and the status, from :func:`run_states`.

    A run holds one row per agent, so the list is bounded by ``total_agents``.
    """
    status = F.col("status")
    done = F.when(status == "completed", F.col("agent"))
    per_run = latest.groupBy("run_id").agg(
        F.array_join(F.array_sort(F.collect_set(done)), ",").alias("completed_agents"),
        F.count(done).alias("completed"),
        F.max_by(
            F.when(status == "running", F.col("agent")),
            F.when(status == "running", F.struct("updated_at", "agent")),
        ).alias("current_agent"),
        F.count_if(status == "failed").alias("failed"),
    )
    verdict = (
        F.when(F.col("failed") > 0, "failed")
        .when(F.col("completed") >= total_agents, "completed")
        .otherwise("running")
    )
    return per_run.select(
        "run_id", "completed_agents", "completed", "current_agent",
        F.lit(total_agents).alias("total_agents"), verdict.alias("status"),
    )


def _holder(counts: DataFrame, wanted: DataFrame, width: str) -> DataFrame:
    """(run_id, slice, wanted): the time slice of each run that holds its wanted rank, and the rank inside it.

    ``counts`` has one row per run and slice of a finer width; ``wanted`` counts from 1.
    """
    sliced = counts.groupBy("run_id", F.window("slice", width)["start"].alias("slice")).agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("run_id").orderBy("slice"))
    placed = sliced.withColumn("upto", upto).join(wanted, "run_id")
    holds = (F.col("wanted") <= F.col("upto")) & (F.col("wanted") > F.col("upto") - F.col("n"))
    return placed.where(holds).select(
        "run_id", "slice", (F.col("wanted") - F.col("upto") + F.col("n")).alias("wanted")
    )


def curve_sample(
    events: DataFrame, value: str, slice_widths: Sequence[str] = ("1 hour", "1 second")
) -> DataFrame:
    """First, middle (n div 2, if n > 2) and last event of every run that has a value.

    The events are read twice. The first pass counts them per run and finest slice
    of ``slice_widths`` and keeps the first and last of each slice; that table gives
    the ends, and the slice that holds the middle, found from the widest slices
    down. The second pass takes the events of that one slice per run, whose places
    come from a distributed sort by time and event id, so any number may tie.
    """
    order, picked = F.struct("ts", "event_id"), F.struct("event_id", F.col(value).alias("value"))
    fine = slice_widths[-1]
    rows = events.where(F.col(value).isNotNull() & F.col("run_id").isNotNull()).select("run_id", "ts", "event_id", F.col(value).alias("value"))
    counts = through_table(
        rows.groupBy("run_id", F.window("ts", fine)["start"].alias("slice")).agg(
            F.count(F.lit(1)).alias("n"), F.min_by(picked, order).alias("first"), F.max_by(picked, order).alias("last")
        ),
        "slice-counts",
    )
    ends = through_table(
        counts.groupBy("run_id").agg(
            F.sum("n").alias("n"), F.min_by("first", "slice").alias("first"), F.max_by("last", "slice").alias("last")
        ),
        "curve-ends",
    )
    wanted, inside = ends.where("n > 2").select("run_id", (F.floor(F.col("n") / 2) + 1).alias("wanted")), counts.select("run_id", "slice", "n")
    for width, finer in zip(slice_widths, [*slice_widths[1:], None], strict=True):
        holder = _holder(inside, wanted, width)
        if finer:
            at = holder.select("run_id", F.col("slice").alias("within"))
            inside = inside.join(at, "run_id").where(F.window("slice", width)["start"] == F.col("within")).drop("within")
            wanted = holder.select("run_id", "wanted")
    holder = through_table(holder, "middle-slices")
    tied = through_table(
        rows.withColumn("slice", F.window("ts", fine)["start"]).join(holder, ["run_id", "slice"]).drop("slice"), "middle-events"
    )
    middles = with_positions(tied, ["ts", "event_id"], within=["run_id"]).where(F.col("position") == F.col("wanted") - 1)

    def end(place: str) -> Column:
        return F.struct(F.lit(place).alias("place"), F.col(f"{place}.event_id"), F.col(f"{place}.value"))

    outer = ends.select("run_id", F.inline(F.array(end("first"), end("last"))))
    return outer.unionByName(middles.select("run_id", F.lit("middle").alias("place"), "event_id", "value"))


def windowed_throughput(
    events: DataFrame, width: str, slide: str | None = None, labels: Sequence[str] = (), value: str | None = None
) -> DataFrame:
    """Events (and summed value) per second and time window. Works on streams."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    seconds = F.unix_timestamp("window_end") - F.unix_timestamp("window_start")
    sums = [F.count(F.lit(1)).alias("events")]
    if value:
        sums.append(F.sum(value).alias("amount"))
    out = events.groupBy(*labels, window.alias("window")).agg(*sums).select(
        *labels, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "events", *(["amount"] if value else []),
    )
    out = out.withColumn("events_per_second", F.col("events") / seconds)
    return out.withColumn("amount_per_second", F.col("amount") / seconds) if value else out


def error_summary(log: DataFrame) -> DataFrame:
    """Errors and warnings per agent, level and error code. Works on streams."""
    return (
        log.where(F.col("level").isin("ERROR", "WARN"))
        .groupBy("agent", "level", F.try_element_at("metadata", F.lit("error_code")).alias("error_code"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def delete_runs(log: DataFrame, runs: DataFrame) -> DataFrame:
    return log.join(runs.select("run_id"), "run_id", "left_anti")


def event_dedup(events: DataFrame, id_col: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Each event once. On a stream, copies are recognised within ``delay`` of event time; in batch, always."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([id_col])
    return events.dropDuplicates([id_col])


#: Events of a run that one task works through at a time.
STOPPING_SLICE = 65_536


def early_stopping(
    events: DataFrame, value: str, patience: int, min_gain: float = 0.0, slice_rows: int = STOPPING_SLICE
) -> DataFrame:
    """(run_id, stop_event, stop_ts, best): where a run would stop, for the runs that would.

    A run stops at the first event after which ``patience`` events in a row have
    not brought the least value so far down by more than ``min_gain``. Events
    without a value do not count.

    A run of any length is cut into slices of ``slice_rows`` events. The least
    value before a slice, and then the last gain before it, come from one row per
    slice; inside, both are running figures.
    """
    if patience < 1:
        raise ValueError("patience must be at least 1")
    rows = events.where(F.col(value).isNotNull()).select("run_id", "ts", "event_id", F.col(value).alias("value"))
    placed = with_positions(through_table(rows, "curve"), ["ts", "event_id"], within=["run_id"], position="place", group="run")
    placed = through_table(placed.withColumn("slice", F.floor(F.col("place") / slice_rows)), "placed-curve")

    def carried(table: DataFrame, figure: Column, name: str) -> DataFrame:
        """Per run and slice: ``figure`` over all slices before it."""
        before = Window.partitionBy("run").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        per_slice = table.groupBy("run", "slice").agg(figure.alias("of_slice"))
        merge = F.min if name == "best_before" else F.max
        return through_table(per_slice.select("run", "slice", merge("of_slice").over(before).alias(name)), "carried")

    inside = Window.partitionBy("run", "slice").orderBy("place")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    best = F.least("best_before", F.min("value").over(earlier))  # nulls are skipped
    gains = placed.join(carried(placed, F.min("value"), "best_before"), ["run", "slice"]).withColumn("best", best)
    gained = F.col("best").isNull() | (F.col("value") < F.col("best") - min_gain)
    gains = through_table(gains.withColumn("gain", F.when(gained, F.col("place"))).drop("best_before", "value"), "gains")
    last_gain = F.greatest("gain_before", F.max("gain").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    stalled = gains.join(carried(gains, F.max("gain"), "gain_before"), ["run", "slice"]).withColumn("stalled", F.col("place") - last_gain)
    first = stalled.where(F.col("stalled") >= patience).groupBy("run").agg(
        F.min(F.struct("place", "run_id", "ts", "event_id", "best")).alias("stop")
    )
    return first.select("stop.run_id", F.col("stop.event_id").alias("stop_event"), F.col("stop.ts").alias("stop_ts"), "stop.best")
