import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dedup as D
from corpusloom.operators import profile as P
from corpusloom.operators import validate as V
from corpusloom.plans.preparation import ingest_and_profile

ROWS = ["a", None, "a", "", "b", None, "nan", "a"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_dedup_keeps_the_first_and_treats_nulls_as_equal(texts):
    kept = D.exact_dedup(texts(ROWS), "text", "id").orderBy("id").collect()
    assert [(r.id, r.text) for r in kept] == [(0, "a"), (1, None), (3, ""), (4, "b"), (6, "nan")]
    assert sorted(r.id for r in D.kept_ids(texts(ROWS), "text", "id").collect()) == [0, 1, 3, 4, 6]
    assert sorted(r.id for r in D.near_dedup(texts(ROWS), "text", "id", 0.5).collect()) == [0, 1, 3, 4, 5, 6]
    counts = D.dedup_counts(texts(ROWS), "text").first()
    assert tuple(counts) == (8, 5, 3)


def test_similar_pairs_are_all_found_and_grouped(texts):
    base = [f"w{k}" for k in range(40)]

    def changed(*places):
        return " ".join("x" if k in places else w for k, w in enumerate(base))

    values = [changed(), changed(0), changed(0, 1), changed(0, 20), "w1 w2", "w1  w2", "", None, changed()]
    sets = [{tuple(v.split()[k : k + 5]) for k in range(max(1, len(v.split()) - 4))} if v and v.split() else set() for v in values]
    for threshold in (0.3, 0.6, 0.9):
        near = {
            (i, j) for i in range(9) for j in range(i + 1, 9)
            if sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9
        }
        firsts = {i: min(j for j in range(9) if sets[j] == sets[i]) for i in range(9) if sets[i]}
        pairs = {(r.a, r.b) for r in D.similar_pairs(texts(values), "text", "id", threshold).collect()}
        assert {(i, j) for i, j in near if firsts[i] == i and firsts[j] == j} <= pairs <= near
        root = list(range(9))
        for _ in range(9):
            for i, j in near:
                root[i] = root[j] = min(root[i], root[j])
        kept = sorted(r.id for r in D.near_dedup(texts(values), "text", "id", threshold).collect())
        assert kept == [i for i in range(9) if root[i] == i]


def test_a_hot_text_is_cut_before_the_shuffle(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    kept = D.exact_dedup(df, "text", "id")
    plan = plan_of(kept)
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")  # below the exchange too
    assert kept.count() == 2001
    assert kept.where("text = 'hot'").first().id == 0


def test_duplicate_rules_differ_on_nulls(texts):
    dup = V.check_duplicates(texts(ROWS), "text").first()
    assert (dup.has_duplicates, dup.duplicate_count, dup.duplicate_percentage) == (True, 3, 37.5)
    stats = V.duplicate_stats(texts(ROWS), "text").first()
    assert tuple(stats) == (8, 4, 4, 50.0)


def test_empty_table_has_zero_percentages(texts):
    empty = texts(["x"]).where("id < 0")
    assert tuple(V.check_missing(empty, "text").first()) == (False, 0, 0.0)
    assert V.check_duplicates(empty, "text").first().duplicate_percentage == 0.0
    assert V.duplicate_stats(empty, "text").first().duplicate_percentage == 0.0
    report = V.validation_report(empty, "text").first()
    assert report.valid and report.warnings == [] and not report.pii_detected


def test_quality_counts_both_faults_of_a_row_twice(texts):
    row = V.text_quality(texts(["\x01", "ok text", None, "long enough \x02", "\x7f del is fine"]), "text").first()
    assert (row.low_quality_count, row.too_short_count, row.encoding_issues_count) == (4, 2, 2)


def test_pii_sample_and_full_scan(texts):
    df = texts(["plain"] * 120 + ["mail a@b.org", "call 555-123-4567 or c@d.org"])
    assert V.check_pii(df, "text", 100, "id").count() == 0
    rows = V.check_pii(df, "text").orderBy("position").collect()
    assert [(r.pii_type, r.rows) for r in rows] == [("email", 2), ("phone", 1)]
    with pytest.raises(ValueError):
        V.check_pii(df, "text", 100)


def test_validation_report_texts(texts):
    df = texts(["a@b.org is here", "a@b.org is here", None, "123-45-6789 x", "hi"])
    report = V.validation_report(df, "text").first()
    assert report.warnings == [
        "1 missing values in text column", "1 duplicate rows found", "PII detected: email, ssn",
        "2 rows with low quality text",
    ]
    nested = report.validation_report
    assert nested.pii.pii_counts == {"email": 2, "ssn": 1}
    assert nested.missing_values.missing_percentage == 20.0
    assert report.errors == [] and report.valid and report.pii_detected


def test_column_profile(spark):
    df = spark.createDataFrame(
        [(1, "short", "a much longer text here", 0.0), (2, None, "another quite long text", -0.0),
         (3, "short", "a much longer text here", float("nan"))],
        "n bigint, tag string, body string, x double",
    )
    rows = {r.column: r for r in P.column_profile(df).collect()}
    assert {c: (r.rows, r.missing, r.distinct_values, r.duplicates) for c, r in rows.items()} == {
        "n": (3, 0, 3, 0), "tag": (3, 1, 1, 1), "body": (3, 0, 2, 1), "x": (3, 1, 1, 1),
    }
    assert math.isclose(rows["tag"].avg_length, 13 / 3)  # a missing value reads as "nan"
    assert [r.column for r in P.detect_text_columns(df).collect()] == ["body"]
    assert P.primary_text_column(df).first().text_column == "body"
    assert P.primary_text_column(df.select("n", "tag")).first().text_column is None
    approx = {r.column: r.distinct_values for r in P.column_profile(df, exact_distinct=False).collect()}
    assert approx["n"] == 3 and approx["tag"] == 1


def test_primary_column_tie_takes_the_first(spark):
    df = spark.createDataFrame([("x" * 20, "y" * 20)], "b string, a string")
    assert P.primary_text_column(df).first().text_column == "b"


def test_long_values_are_keyed_by_digest_without_confusion(spark):
    import hashlib

    long = "z" * 100
    lookalike = "#" + hashlib.md5(long.encode()).hexdigest()
    df = spark.createDataFrame([(long,), (lookalike,), (long,)], "t string")
    assert P.distinct_per_column(df).first().distinct_values == 2


def test_stats_and_profile(spark, tmp_path):
    df = spark.createDataFrame([("q1 is a question", "p"), ("q1 is a question", None)], "text string, label string")
    stats = P.dataset_stats(df).first()
    assert (stats.rows, stats.columns, stats.text_columns, stats.has_missing) == (2, 2, "text", True)
    assert (stats.avg_text_length, stats.token_count_estimate, stats.duplicate_ratio) == (16.0, 8, 0.5)
    df.write.parquet(str(tmp_path / "d.parquet"))
    row = ingest_and_profile(spark, str(tmp_path / "d.parquet"), "0123456789").first()
    assert row.dataset_id == "ds_01234567" and row.columns == ["text", "label"]
    assert row.stats.missing_values == {"text": 0, "label": 1}
    assert row.stats.text_stats.max_length == 16


def test_row_length_measures_differ(spark):
    df = spark.createDataFrame([("ab", "c"), ("abcd", None)], "a string, b string")
    assert P.avg_row_length(df).first()[0] == 5.0
    assert P.avg_of_column_means(df).first()[0] == 2.5
    assert tuple(P.class_count(df, "b").first()) == (2, 1)
    assert {(r["class"], r.n) for r in P.label_distribution(df, "b").collect()} == {("c", 1), (None, 1)}


def test_constraints(spark):
    df = spark.createDataFrame(
        [(1, "fast", 0.5), (11, "slow", 0.96), (None, "balanced", 0.95)],
        "epochs int, training_mode string, split_ratio double",
    )
    rows = {r.field: (r.checked, r.violations) for r in V.constraint_violations(df).collect()}
    assert rows == {"epochs": (2, 1), "training_mode": (3, 1), "split_ratio": (3, 1)}


def test_unique_texts_are_not_shuffled(spark):
    rows = spark.range(2000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 100 = 1 THEN NULL ELSE concat('text ', id) END AS text")
    kept = D.exact_dedup(rows, "text", "id")
    assert kept.count() == 2000 - 666 - (2000 // 100 - 2000 // 300) + 1
    plan = kept._jdf.queryExecution().executedPlan()
    shuffled = [line for line in plan.toString().split("\n") if "Exchange hashpartitioning" in line and "text" in line]
    assert len(shuffled) <= 1 and plan.toString().count("Union") == 1
    # What meets in the window: the copies, and next to nothing else.
    assert sorted(r.id for r in kept.where("text = 'hot' OR text IS NULL").collect()) == [0, 1]


def jaccard_groups(values, threshold):
    def sets(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    held, label = {i: sets(t) for i, t in values.items()}, {i: i for i in values}
    changed = True
    links = [(a, b) for a in held for b in held if a < b and held[a] and len(held[a] & held[b]) >= threshold * len(held[a] | held[b]) - 1e-9]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("hashed", [False, True])
@pytest.mark.parametrize("block", [4, 1024])
def test_near_copies_of_a_large_group_and_of_chains(spark, monkeypatch, hashed, block):
    monkeypatch.setattr(D.linked_groups, "__defaults__", (block,))
    r = random.Random(6)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    values = {}
    for k in range(60):  # near copies of one text, a third of the rows
        words = list(base)
        words[r.randrange(120)] = f"x{k}"
        values[k] = " ".join(words)
    chain = [f"c{k}" for k in range(200)]
    for k in range(12):  # each is similar to the next, not to the first
        values[100 + k] = " ".join(chain[3 * k : 3 * k + 100])
    for k in range(110):
        values[300 + k] = " ".join(f"w{r.randrange(900)}" for _ in range(30))
    values[500], values[501] = values[300], ""
    frame = spark.createDataFrame(list(values.items()), "id bigint, text string").repartition(3)
    label = jaccard_groups(values, 0.8)
    kept = sorted(r.id for r in D.near_dedup(frame, "text", "id", 0.8, hashed=hashed).collect())
    assert kept == sorted(i for i in values if label[i] == i)


def test_a_group_sends_rows_in_proportion_to_its_size(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[: k % 55], f"x{k}", *base[k % 55 :]])) for k in range(400)]
    sets = D.shingle_sets(spark.createDataFrame(rows, "id bigint, text string"), "text", "id")
    classes = sets.select(F.col("id").alias("a"), "members")
    links = []
    inner = D.least_reachable
    D.least_reachable = lambda found: links.append(found.count()) or inner(found)
    try:
        groups = D.linked_groups(D.band_buckets(classes), classes, 0.8)
    finally:
        D.least_reachable = inner
    assert groups.select("label").distinct().count() == 1
    assert all(n <= 6 * 400 for n in links)


def test_sketches_unite_to_an_estimate(spark):
    rows = spark.range(30_000).selectExpr("concat('s', id % 7) AS source", "id % 9000 AS a", "CASE WHEN id % 2 = 0 THEN concat('x', id) END AS b")
    sketches = P.distinct_sketches(rows, ["a", "b"], by=["source"])
    assert sketches.count() == 14
    got = {r.column: r.distinct_values for r in P.united_distinct(sketches).collect()}
    assert abs(got["a"] - 9000) < 300 and abs(got["b"] - 15_000) < 500
