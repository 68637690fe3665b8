"""What near de-duplication sends through the shuffle, and that it loses no link for it."""

import random

from corpusloom.operators import dedup as D


def test_shingles_are_exploded_for_one_count_and_one_join(spark):
    classes = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 2, 4])], "a bigint, members array<bigint>")
    heads = D._heads(classes, 0.5)
    assert heads._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2
    assert {(r.s, r.a) for r in heads.collect()} == {(1, 1), (1, 2)}


def test_groups_with_copies_and_repeated_rows(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(300)}" for _ in range(200)]
    near = base[:190] + ["x"] + base[191:]
    other = [f"v{r.randrange(300)}" for _ in range(50)]
    rows = [(5, base), (3, near), (9, base), (7, other), (8, other), (8, other), (1, []), (2, []), (None, base), (4, other + ["z"])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "id bigint, text string")
    for hashed in (False, True):
        got = D.near_dedup(df, "text", "id", 0.9, hashed=hashed)
        assert sorted(x.id if x.id is not None else -1 for x in got.collect()) == [-1, 1, 2, 3, 4]


def test_only_wanted_sets_are_read(spark):
    classes = spark.createDataFrame([(k, [k]) for k in range(20)], "a bigint, members array<bigint>")
    wanted = spark.createDataFrame([(3,), (3,), (40,)], "a bigint")
    kept = D._classes_of(classes, wanted)
    assert [x.a for x in kept.collect()] == [3] and "BroadcastHashJoin" in kept._jdf.queryExecution().executedPlan().toString()
