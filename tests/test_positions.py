"""Places of rows in a sorted table."""

import random

from corpusloom.operators.positions import with_positions


def test_places_follow_the_order_and_far_ids_change_nothing(spark):
    ids = [*range(0, 3000, 3), 10**15, -(10**15)]
    random.Random(1).shuffle(ids)
    rows = spark.createDataFrame([(i, "x") for i in ids], "id bigint, at string").repartition(5)
    got = with_positions(rows, ["id"]).collect()
    assert sorted((r.id, r.position) for r in got) == [(i, k) for k, i in enumerate(sorted(ids))]
    assert got[0].asDict().keys() == {"id", "at", "position"}


def test_places_inside_groups(spark):
    r = random.Random(2)
    data = [(r.choice([None, "a", "b", "ü"]), r.choice([None, 1, 2, 3]), k) for k in range(400)]
    rows = spark.createDataFrame(data, "part string, v int, k int").repartition(7)
    got = with_positions(rows, ["v", "k"], within=["part"], total="size", group="number").collect()
    low = lambda x: (x is not None, x if x is not None else 0)
    names = sorted({d[0] for d in data}, key=lambda x: (x is not None, (x or "").encode()))
    for n, name in enumerate(names):
        wanted = sorted((d for d in data if d[0] == name), key=lambda d: (low(d[1]), d[2]))
        mine = sorted((x for x in got if x.part == name), key=lambda x: x.position)
        assert [(x.v, x.k) for x in mine] == [(d[1], d[2]) for d in wanted]
        assert {(x.size, x.number) for x in mine} == {(len(wanted), n)}


def test_ties_and_empty_tables(spark):
    ties = spark.createDataFrame([(None,)] * 50, "id bigint")
    assert sorted(r.position for r in with_positions(ties, ["id"]).collect()) == list(range(50))
    assert with_positions(ties.limit(0), ["id"], within=["id"], group="g").count() == 0
