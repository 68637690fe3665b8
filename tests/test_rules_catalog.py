import pytest
from pyspark.sql import functions as F

from corpusloom.operators import catalog as G
from corpusloom.operators import rules as R


def test_task_rules(spark):
    cases = [
        (["text", "Label"], ("classification", 0.7, "Label")),
        (["CATEGORY", "class"], ("classification", 0.7, "CATEGORY")),
        (["question", "best_answer", "answer"], ("qa", 0.8, "best_answer")),
        (["prompt", "output", "response"], ("chat", 0.8, "output")),
        (["instruction", "answer"], ("generation", 0.5, "answer")),
        (["text", "summary_long", "summary"], ("summarization", 0.75, "summary_long")),
        (["question", "answer", "label"], ("classification", 0.7, "label")),
        (["a", "b"], ("generation", 0.5, "b")),
        ([], ("generation", 0.5, "text")),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "id int, columns array<string>")
    rows = R.detect_task(df).orderBy("id").collect()
    assert [(r.task_type, r.confidence, r.target_column) for r in rows] == [want for _, want in cases]


def test_config_rules_and_presets(spark):
    cases = [
        # rows, length, gpus -> batch, epochs, rank, alpha, rate, precision
        ((999, 500.0, 0), (2, 5, 8, 16, 1e-4, "fp32")),
        ((1000, 501.0, 0), (2, 3, 8, 32, 2e-4, "fp32")),
        ((5000, 10.0, 1), (4, 3, 16, 32, 2e-4, "fp16")),
        ((5001, 10.0, 1), (8, 3, 16, 32, 2e-4, "fp16")),
        ((9999, 501.0, 1), (4, 3, 8, 32, 2e-4, "fp16")),
        ((10000, 501.0, 2), (4, 2, 16, 64, 2e-4, "fp16")),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "id int, rows int, avg_text_length double, gpu_count int")
    suggested = R.suggest_config(df)
    names = ["batch_size", "epochs", "lora_rank", "lora_alpha", "learning_rate", "precision"]
    rows = suggested.orderBy("id").collect()
    assert [tuple(r[n] for n in names) for r in rows] == [want for _, want in cases]

    def preset(mode):
        out = R.apply_preset(suggested.withColumn("training_mode", F.lit(mode))).orderBy("id").collect()
        return [(r.epochs, r.batch_size, r.lora_rank, r.learning_rate, r.gradient_accumulation) for r in out]

    assert preset("fast")[0] == (1, 4, 8, 1e-4, 4) and preset("fast")[5] == (1, 4, 8, 2e-4, 2)
    assert preset("balanced")[3] == (3, 8, 16, 2e-4, 1)
    assert preset("high_quality")[5] == (5, 4, 32, 1e-4, 2)


def test_rank_snapping(spark):
    df = spark.createDataFrame([(r,) for r in (1, 12, 13, 24, 25, 48, 49, 999)], "r int")
    assert [x[0] for x in df.select(R.snap_rank(F.col("r"))).collect()] == [8, 8, 16, 16, 32, 32, 64, 64]


@pytest.fixture
def models(spark):
    return spark.range(25).select("id", (F.col("id") % 2).alias("kind"))


def test_pages(models):
    got = G.page(models, "id", 5, 10, {"kind": 1}).collect()
    assert [r.id for r in got] == [21, 23] and {(r.total, r.has_more) for r in got} == {(12, False)}
    first = G.page(models, "id", 5).collect()
    assert [r.id for r in first] == [0, 1, 2, 3, 4] and first[0].has_more and first[0].total == 25
    with pytest.raises(ValueError):
        G.page(models, "id", 101)
    assert [r.total for r in G.preview(models, "id", 3).collect()] == [25] * 3


def test_export_upserts(spark):
    registry = spark.sql(
        """SELECT 'r1' AS run_id, map('gguf', named_struct('path', 'old', 'created_at', timestamp '2024-01-01')) AS exports
           UNION ALL SELECT 'r2', NULL"""
    )
    exports = spark.sql(
        """SELECT * FROM VALUES ('r1', 'adapter', 'a1', timestamp '2024-01-02'), ('r1', 'adapter', 'a2', timestamp '2024-01-03'),
           ('r1', 'gguf', 'new', timestamp '2024-01-02'), ('r9', 'gguf', 'x', timestamp '2024-01-02')
           AS t(run_id, format, path, created_at)"""
    )
    updated = G.add_exports(registry, exports)
    found = {r.run_id: (r.path, r.available) for r in G.export_lookup(updated, "adapter").collect()}
    assert found == {"r1": ("a2", "adapter,gguf"), "r2": (None, "")}
    assert G.export_lookup(updated, "gguf").where("run_id = 'r1'").first().path == "new"
    assert [r.run_id for r in G.unknown_exports(registry, exports).collect()] == ["r9"]


def test_cache_and_search(spark):
    objects = spark.createDataFrame(
        [("org--m/a/b.bin", 2**30), ("org--m/c.json", 2**29), ("plain/x", 1), ("top.txt", 0)], "object_name string, size bigint"
    )
    rows = {r.model_id: (r.s3_path, r.total_size, r.size_gb, r.files_count) for r in G.cached_models(objects).collect()}
    assert rows["org/m"] == ("s3://models/org--m", 2**30 + 2**29, 1.5, 2)
    assert rows["plain"][1:] == (1, 0.0, 1) and rows["top.txt"][3] == 1
    assert tuple(G.cached_size(objects, "org/m").first()) == (2**30 + 2**29, True)
    assert tuple(G.cached_size(objects, "none").first()) == (None, False)
    hub = spark.createDataFrame(
        [("a/Llama-x", 5, ["t", "u"]), ("b/llama-y", 9, ["t"]), ("llama", 9, ["t"]), ("c/other", 99, ["t"])],
        "id string, downloads int, tags array<string>",
    )
    found = G.search_models(hub, "llama", ["t"], 2).collect()
    assert [(r.id, r.name, r.author) for r in found] == [("b/llama-y", "llama-y", "b"), ("llama", "llama", "unknown")]
    assert [r.id for r in G.search_models(hub, "llama", ["t", "u"]).collect()] == ["a/Llama-x"]


def test_projects(spark):
    projects = spark.createDataFrame(
        [("p1", "One", "a,b", "old"), ("p2", "Two", "", "old"), ("p3", "Three", None, "old")],
        "project_id string, project_name string, tags string, updated_at string",
    )
    assert [r.tags for r in G.list_projects(projects).collect()] == [["a", "b"], [], []]
    assert [r.project_id for r in G.list_projects(projects, 1, 1).collect()] == ["p2"]
    jobs = spark.createDataFrame([("p1",), ("p1",), ("p9",)], "project_id string")
    counted = G.project_counts(projects, {"job_count": jobs}).orderBy("project_id").collect()
    assert [r.job_count for r in counted] == [2, 0, 0]
    changes = spark.createDataFrame([("p1", None, "z"), ("p2", "Duo", None)], "project_id string, project_name string, tags string")
    updated = G.partial_update(projects, changes, "project_id", ["project_name", "tags"], F.lit("now"))
    assert [tuple(r) for r in updated.orderBy("project_id").collect()] == [
        ("p1", "One", "z", "now"), ("p2", "Duo", "", "now"), ("p3", "Three", None, "old"),
    ]
    assert [r.project_id for r in G.remove_rows(projects, jobs, "project_id").orderBy("project_id").collect()] == ["p2", "p3"]


@pytest.mark.parametrize("offset", [0, 700, 995, 1490, 1500, 4000])
def test_pages_at_any_depth(spark, monkeypatch, offset):
    monkeypatch.setattr(G, "NEAR", 50)
    ids = [None, None, *range(0, 4500, 3), *[900] * 3]
    rows = spark.createDataFrame([(i, "x") for i in ids], "id bigint, v string").repartition(6)
    wanted = sorted(ids, key=lambda i: (i is not None, i or 0))[offset : offset + 20]
    got = G.page(rows, "id", 20, offset).collect()
    assert sorted((r.id is not None, r.id or 0) for r in got) == [(i is not None, i or 0) for i in wanted]
    assert all(r.total == len(ids) and r.has_more == (len(ids) > offset + 20) for r in got)
    if offset == 0:
        assert [r.id for r in got] == wanted
