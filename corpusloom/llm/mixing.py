"""Mixing sources to target weights with a time-varying curriculum.

Each source has a weight schedule over training time. Its integral, scaled to
the source's target, is the demand for the source's words up to a time; the
inverse of that demand gives the time at which a document is read. Documents are
range-sorted by that position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import sql_word_count, written

MAX_REPEATS = 3
#: Schedule of a source by its weight: (time, relative weight), linear in between.
SCHEDULES = {
    1: [(0.0, 1.5), (1.0, 0.5)],
    2: [(0.0, 1.0), (1.0, 1.0)],
    3: [(0.0, 0.5), (1.0, 1.5)],
}


def time_of_demand(share: Column, knots: list[tuple[float, float]]) -> Column:
    """Time at which a schedule has spent ``share`` (0 to 1) of its integral."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    total, before, out = sum(areas), 0.0, None
    for k, ((t0, w0), (t1, w1)) in enumerate(zip(knots, knots[1:], strict=False)):
        area = share * F.lit(total) - F.lit(before)
        slope = (w1 - w0) / (t1 - t0)
        # Solve w0 x + slope x^2 / 2 = area for x, in the form without cancellation.
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * area, F.lit(0.0)))
        inside = F.lit(t0) + F.lit(2.0) * area / (F.lit(w0) + root)
        before += areas[k]
        out = inside if out is None else F.when(share * F.lit(total) < F.lit(before - areas[k]), out).otherwise(inside)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def _source_key(source: str) -> list[Column]:
    return [F.col(source).isNull().alias("no_source"), F.coalesce(F.col(source), F.lit("")).alias("name")]


def source_targets(sized: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """Per source (no_source, name): weight, source_size, n_docs, target.

    The sources are range-sorted, so that their ranks come from counts per
    partition, and only two sums per round of the resharing reach the driver.
    """
    ranked = written(
        sized.groupBy("no_source", "name")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .repartitionByRange("no_source", "name")
        .sortWithinPartitions("no_source", "name")
        .withColumn("at", F.monotonically_increasing_id()),
        "sources",
    ).withColumn("block", F.shiftright("at", 33))
    # One row per partition of the sorted sources.
    blocks = ranked.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.select(
        "block",
        (F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).alias("before"),
    )
    rank = F.coalesce(F.col("before"), F.lit(0)) + F.col("at") - F.shiftleft(F.col("block"), 33)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    sources = written(
        ranked.join(blocks, "block").select(
            "no_source", "name", "source_size", "n_docs", weight.cast("bigint").alias("weight")
        ),
        "source-weights",
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * max_repeats
    unit, before = 0.0, None
    while unit != before:
        over = limit < F.lit(unit) * F.col("weight")
        capped, free = sources.agg(
            F.coalesce(F.sum(F.when(over, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))
        ).first()
        before, unit = unit, (total - capped) / free if free else unit
    target = F.least(limit.cast("double"), F.lit(float(unit)) * F.col("weight"))
    return sources.withColumn("target", target)


def mix_plan(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    id_column: str = "doc_id",
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = MAX_REPEATS,
    schedules: dict[int, list[tuple[float, float]]] | None = None,
    row_column: str | None = None,
) -> DataFrame:
    """How often and when each document is read: one row per input row.

    Columns: id, no_source, name, size (words), source_size, target, takes,
    taken (= takes * size), first_position (time of the first reading, null if
    none), due (place of the first reading in the demand) and row, which is
    ``row_column`` or else a number of the row.

    A source's documents stand in the order of a hash of their id. Whole passes
    over the source are taken while its target allows; of the last pass, the
    documents before the end of the demand, and then the one whose size is
    nearest to the words still missing, if that brings the source closer to its
    target. Within a source, running sums are taken in about sqrt(n) slices of
    about sqrt(n) documents, so no source is sorted in one task.

    Null and blank texts have size 0 and are never read. The null source comes
    last. Repeated rows are documents of their own. An empty table gives an
    empty result. Other columns are not read.
    """
    schedules = schedules or SCHEDULES
    sized = written(
        docs.select(
            F.col(id_column).alias("id"),
            *_source_key(source),
            sql_word_count(F.col(text)).alias("size"),
            F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")).alias("h"),
            (F.col(row_column) if row_column else F.monotonically_increasing_id()).alias("row"),
        ),
        "sizes",
    )
    key = ["no_source", "name"]
    sources = written(source_targets(sized, weights, max_repeats), "targets")
    share = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    placed = sized.join(sources, key).withColumn("slice", F.floor(share * F.ceil(F.sqrt("n_docs"))).cast("bigint"))
    slices = placed.groupBy(*key, "slice").agg(F.sum("size").alias("words"))
    before = Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*key, "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("slice_start"))
    inside = Window.partitionBy(*key, "slice").orderBy("h", "id", "size", "row")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    passes = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("bigint")
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    ends = written(
        placed.join(slices, [*key, "slice"])
        .withColumn("end", F.col("slice_start") + running)
        .withColumn("passes", passes)
        .withColumn("rest", rest)
        .withColumn("extra", (F.col("end") <= F.col("rest")) & (F.col("size") > 0))
        .drop("slice", "slice_start", "n_docs"),
        "ends",
    )
    # Written, so that its size is known when the join with the documents is planned.
    gaps = written(
        ends.groupBy(*key).agg(
            (F.max("rest") - F.coalesce(F.sum(F.when(F.col("extra"), F.col("size"))), F.lit(0))).alias("gap")
        ),
        "gaps",
    )
    spare = ends.where("NOT extra AND size > 0").join(gaps, key)
    off = F.abs(F.col("size") - F.col("gap"))
    nearest = (
        spare.where(off < F.col("gap"))
        .groupBy(*key)
        .agg(F.min(F.struct(off.alias("off"), "h", "id", "size", "row")).alias("pick"))
        .select(*key, F.col("pick.row").alias("filler"))
    )
    ends_of_sources = written(gaps.join(nearest, key, "left"), "fillers")
    filler = F.coalesce(F.col("row") == F.col("filler"), F.lit(False))
    extra = F.col("extra") | filler
    takes = F.when(F.col("size") > 0, F.col("passes") + F.when(extra, 1).otherwise(0)).otherwise(0)
    # Where in the demand for its source the document is first due.
    due = F.when(
        filler & (F.col("passes") == 0), F.greatest(F.col("target") - F.col("gap"), F.lit(0.0))
    ).otherwise((F.col("end") - F.col("size")).cast("double"))
    position = None
    for weight, knots in schedules.items():
        at = time_of_demand(F.try_divide(F.col("due"), F.col("target")), knots)
        position = F.when(F.col("weight") == weight, at) if position is None else position.when(F.col("weight") == weight, at)
    return (
        ends.join(ends_of_sources, key)
        .select("*", takes.cast("bigint").alias("takes"), due.alias("due"))
        .select(
            "id", "row", *key, "weight", "size", "source_size", "target", "takes",
            (F.col("takes") * F.col("size")).alias("taken"),
            F.when(F.col("takes") > 0, position).alias("first_position"),
            "due",
        )
    )


def curriculum(plan: DataFrame, schedules: dict[int, list[tuple[float, float]]] | None = None) -> DataFrame:
    """Every reading of a document, range-sorted by its training position.

    Columns: id, row, reading (from 0), position (0 to 1), size.
    """
    readings = plan.where("takes > 0").select(
        "id", "row", "size", "weight", F.explode(F.sequence(F.lit(0), F.col("takes").cast("int") - 1)).alias("reading"),
        F.try_divide(F.col("due"), F.col("target")).alias("first_share"),
        F.try_divide(F.col("source_size"), F.col("target")).alias("lap"),
    )
    share = F.least(F.col("first_share") + F.col("reading") * F.col("lap"), F.lit(1.0))
    position = None
    for weight, knots in (schedules or SCHEDULES).items():
        at = time_of_demand(share, knots)
        position = F.when(F.col("weight") == weight, at) if position is None else position.when(F.col("weight") == weight, at)
    return (
        readings.select("id", "row", "reading", position.alias("position"), "size")
        .repartitionByRange("position", "id")
        .sortWithinPartitions("position", "id", "row", "reading")
    )
