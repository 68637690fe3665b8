import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import events as E
from corpusloom.session import scratch_path
from corpusloom.sources.readers import file_inventory, infer_format, load, resolve_uri
from corpusloom.sources.writers import save_jsonl
from corpusloom.streaming import logs as S

LOG = "event_id bigint, ts timestamp, run_id string, agent string, level string, message string, metadata map<string,string>"


def at(day, hour=0, second=0):
    return dt.datetime(2024, 1, day, hour, 0, second)


@pytest.fixture
def log(spark):
    rows = [
        (1, at(1), "a", "X", "INFO", "start", {}),
        (2, at(1, 1), "a", "X", "METRIC", "m", {"loss": "3.0", "step": "1"}),
        (3, at(1, 2), "a", "X", "METRIC", "m", {"loss": "2.0", "step": "2", "epoch": "1.5"}),
        (5, at(1, 3), "a", "X", "METRIC", "m", {"loss": "1.0", "step": "3"}),
        (4, at(1, 3), "a", "X", "METRIC", "m", {"loss": "1.5", "step": "4"}),
        (6, at(9), "b", "Y", "ERROR", "bad", {"error_code": "E1"}),
        (7, at(9, 1), "b", "Y", "METRIC", "m", {"loss": "0.5"}),
        (8, at(9, 2), "c", "Y", "METRIC", "m", {"loss": "0.7"}),
        (9, at(9, 3), "c", "Y", "METRIC", "m", {"loss": "0.6", "learning_rate": "oops"}),
    ]
    return spark.createDataFrame(rows, LOG).withColumn("value", F.col("metadata")["loss"].cast("double"))


def test_values_are_read_as_json_or_text(spark):
    values = ["12 34", '{"a":1} x', "2024-01-01", " 5 ", '"q"', "nan", "NaN", "1e5", "01", "[1,2]]", "true", "null", "[1]", "1,2", "True"]
    df = spark.createDataFrame([(i, {"v": v}) for i, v in enumerate(values)], "id int, data map<string,string>")
    rows = E.parse_values(df, ["id"]).orderBy("id").collect()

    def spec(text):
        try:
            value = json.loads(text)
        except ValueError:
            return "string"
        names = {bool: "boolean", type(None): "null", dict: "object", list: "array", str: "string"}
        return names.get(type(value), "number")

    assert [r.kind for r in rows] == [spec(v) for v in values]


def test_records_are_text_and_metadata_wins(spark):
    df = spark.sql(
        """SELECT 'r' AS run_id, timestamp '2024-01-02 03:04:05' AS ts, 'INFO' AS level, 'METRIC' AS forced,
           array(1, 2) AS ids, true AS ok, CAST(NULL AS INT) AS gone, 1.5D AS loss"""
    ).withColumnRenamed("level", "base_level").withColumnRenamed("forced", "level")
    record = E.log_records(
        df, {"timestamp": "ts", "run_id": "run_id", "level": "base_level"}, ["level", "ids", "ok", "gone", "loss"]
    ).first()
    assert record.data == {
        "timestamp": "2024-01-02T03:04:05", "run_id": "r", "level": "METRIC", "ids": "[1,2]", "ok": "True", "loss": "1.5",
    }


def test_history_retention_deletion(log):
    rows = E.log_history(log, 2).orderBy("event_id").collect()
    assert [(r.event_id, r.position, r.total) for r in rows] == [
        (1, 1, 2), (2, 2, 2), (6, 1, 2), (7, 2, 2), (8, 1, 2), (9, 2, 2),
    ]
    alive = E.retained(log, F.lit("2024-01-08 03:00:00").cast("timestamp")).select("run_id").distinct().collect()
    assert {r.run_id for r in alive} == {"a", "b", "c"}
    later = E.retained(log, F.lit("2024-01-08 03:00:01").cast("timestamp")).select("run_id").distinct().collect()
    assert {r.run_id for r in later} == {"b", "c"}
    left = E.delete_runs(log, log.where("level = 'ERROR'")).select("run_id").distinct().collect()
    assert {r.run_id for r in left} == {"a", "c"}
    assert [r.event_id for r in E.for_run(log, "c", F.lit(at(9, 2))).collect()] == [9]


def test_training_metrics(log):
    rows = {r.event_id: r for r in E.training_metrics(log).collect()}
    assert set(rows) == {2, 3, 4, 5, 7, 8, 9}
    assert (rows[2].epoch, rows[3].epoch, rows[2].step) == (0.0, 1.5, 1)
    assert rows[9].learning_rate is None and rows[9].loss == 0.6


@pytest.mark.parametrize("widths", [("1 hour",), ("1 day", "1 hour"), ("1 day", "1 hour", "1 second")])
def test_curve_sample_positions(log, widths):
    metric = log.where("level = 'METRIC'")
    got = {(r.run_id, r.place): r.event_id for r in E.curve_sample(metric, "value", widths).collect()}
    # Run a in order: 2, 3, 4, 5 (ties by id); the middle is position 4 // 2.
    assert got == {
        ("a", "first"): 2, ("a", "middle"): 4, ("a", "last"): 5,
        ("b", "first"): 7, ("b", "last"): 7, ("c", "first"): 8, ("c", "last"): 9,
    }


def test_gauge_histogram_states(spark, log):
    latest = {r.run_id: r.value for r in E.gauge(log, ["run_id"], "value").collect()}
    assert latest == {"a": 1.0, "b": 0.5, "c": 0.6}
    v = spark.createDataFrame([(5.0,), (10.0,), (60.0,), (5000.0,), (None,)], "v double")
    buckets = {r.le: (r.n, r.sum) for r in E.histogram(v, "v").collect()}
    assert {k: n for k, (n, _) in buckets.items()} == {"10": 2, "50": 2, "100": 3, "200": 3, "500": 3, "1000": 3, "+Inf": 4}
    assert buckets["+Inf"][1] == 5075.0
    states = spark.createDataFrame(
        [("r", "A", at(1), 1, "running", None), ("r", "A", at(1), 2, "completed", None), ("r", "B", at(1), 3, "running", None),
         ("s", "A", at(1), 4, "failed", "E7"), ("t", "A", at(1), 5, "completed", None), ("t", "B", at(1), 6, "completed", None)],
        "run_id string, agent string, ts timestamp, event_id bigint, status string, error_code string",
    )
    last = E.run_states(states)
    assert {(r.run_id, r.agent): (r.status, r.error_code) for r in last.collect()}[("s", "A")] == ("failed", "E7")
    progress = {r.run_id: r for r in E.run_progress(last, 2).collect()}
    assert (progress["r"].completed_agents, progress["r"].current_agent, progress["r"].status) == ("A", "B", "running")
    assert progress["s"].status == "failed" and progress["t"].status == "completed" and progress["t"].current_agent is None


def test_errors_and_windows(log):
    assert [tuple(r) for r in E.error_summary(log).collect()] == [("Y", "ERROR", "E1", 1)]
    windows = E.windowed_throughput(log, "1 day").orderBy("window_start").collect()
    assert [(w.window_start, w.events) for w in windows] == [(at(1), 5), (at(9), 4)]
    assert windows[0].events_per_second == pytest.approx(5 / 86400)


def test_stream_equals_batch_and_goes_on_from_its_checkpoint(spark, log, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    early, late = log.where("event_id <= 5"), log.where("event_id > 5")
    early.write.parquet(source)

    def follow():
        stream = S.read_events(spark, source, log.schema, files_per_batch=1)
        S.publish(stream.select("event_id", "run_id"), sink, state, "parquet").awaitTermination()
        return sorted(r.event_id for r in spark.read.parquet(sink).collect())

    assert follow() == [1, 2, 3, 4, 5]
    late.write.mode("append").parquet(source)
    assert follow() == [1, 2, 3, 4, 5, 6, 7, 8, 9]  # once each: the reader went on, not back
    live = S.snapshot_result(E.gauge(S.read_events(spark, source, log.schema), ["run_id"], "value"), "t")
    assert {tuple(r) for r in live.collect()} == {tuple(r) for r in E.gauge(log, ["run_id"], "value").collect()}


# --- sources ------------------------------------------------------------------


def test_formats_and_uris():
    assert [infer_format(p) for p in ("a.CSV", "b.jsonl", "c.json", "d.parquet", "e.txt", "f.xyz", "g")] == [
        "csv", "jsonl", "json", "parquet", "txt", "txt", "txt",
    ]
    buckets = {"datasets": "file:///data/sets/"}
    assert resolve_uri("s3://datasets/x/y.csv", buckets) == "file:///data/sets/x/y.csv"
    assert resolve_uri("s3://other/x.csv", buckets) == "s3://other/x.csv"
    assert resolve_uri("/plain/x.csv", buckets) == "/plain/x.csv"


def test_csv_quoting_missing_words_and_types(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('text,n,x,flag,mix\n"two\nlines, and ""quotes""",1,1.5,True,1\nplain,NA,2,False,x\nN/A,3,,true,\n')
    df = load(spark, str(path), multiline=True)
    assert dict(df.dtypes) == {"text": "string", "n": "bigint", "x": "double", "flag": "boolean", "mix": "string"}
    assert [tuple(r) for r in df.collect()] == [
        ('two\nlines, and "quotes"', 1, 1.5, True, "1"), ("plain", None, 2.0, False, "x"), (None, 3, None, True, None),
    ]
    typed = load(spark, str(path), multiline=True, schema="text string, n int, x double, flag boolean, mix string")
    assert typed.schema["n"].dataType.simpleString() == "int" and typed.collect()[1].n is None


def test_json_text_and_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"t": "x", "n": 1},\n {"t": null, "n": 2}]')
    assert sorted(tuple(r) for r in load(spark, str(tmp_path / "a.json")).select("n", "t").collect()) == [(1, "x"), (2, None)]
    (tmp_path / "b.unknown").write_text("one\ntwo\n")
    assert [r.text for r in load(spark, f"s3://here/b.unknown", buckets={"here": str(tmp_path)}).collect()] == ["one", "two"]
    df = spark.createDataFrame([("é\n", None)], "text string, note string")
    path = save_jsonl(df, str(tmp_path), "run9")
    assert path.endswith("run9/processed_dataset.jsonl")
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert lines == [{"text": "é\n", "note": None}]
    assert [tuple(r) for r in load(spark, path).select("text").collect()] == [("é\n",)]
    with pytest.raises(ValueError):
        load(spark, path, "xml")


def test_inventory_is_recursive(spark, tmp_path):
    (tmp_path / "m" / "sub").mkdir(parents=True)
    (tmp_path / "m" / "a.bin").write_bytes(b"12345")
    (tmp_path / "m" / "sub" / "b.bin").write_bytes(b"1")
    (tmp_path / "c.bin").write_bytes(b"12")
    sizes = {r.path.rsplit("/", 1)[-1]: r.size for r in file_inventory(spark, str(tmp_path)).collect()}
    assert sizes == {"a.bin": 5, "b.bin": 1, "c.bin": 2}
    assert file_inventory(spark, str(tmp_path), "m/").count() == 2
    assert file_inventory(spark, str(tmp_path), "sub/").count() == 0


class _Cluster:
    """Just enough of a session that is not local."""

    class sparkContext:
        master = "spark://host"

        @staticmethod
        def getConf():
            return {}

    class conf:
        values: dict = {}

        @classmethod
        def get(cls, key, default=None):
            return cls.values.get(key, default)


def test_scratch_folder_is_the_one_the_cluster_names(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(_Cluster, "x")
    _Cluster.conf.values = {"spark.checkpoint.dir": "hdfs://shared/points/"}
    assert scratch_path(_Cluster, "x").startswith("hdfs://shared/points/x-")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    from pyspark.sql import types as T

    from corpusloom.streaming import logs as S

    schema = T.StructType([T.StructField("run", T.StringType()), T.StructField("n", T.LongType())])
    folder, root = tmp_path / "in", str(tmp_path / "root")

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))

    def totals():
        stream = S.read_events(spark, str(folder), schema, files_per_batch=1)
        return {r.run: r.n for r in S.snapshot_result(stream.groupBy("run").sum("n").toDF("run", "n"), "t", f"{root}/sums").collect()}

    def rows():
        return S.append_result(S.read_events(spark, str(folder), schema, files_per_batch=1), "t", f"{root}/rows").count()

    add([("x", 1), ("y", 2)])
    add([("x", 3)])
    assert totals() == {"x": 4, "y": 2} and rows() == 3
    assert totals() == {"x": 4, "y": 2} and rows() == 3  # nothing new
    add([("y", 5)])
    assert totals() == {"x": 4, "y": 7} and rows() == 4
