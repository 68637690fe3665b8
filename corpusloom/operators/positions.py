"""Positions of rows in a sorted table, without sorting in one task.

The table is range-partitioned, each partition counts its rows, and running
offsets over the counts turn places inside a partition into places in the whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import through_table

#: Bits that ``monotonically_increasing_id`` keeps for the place inside a partition.
_PLACE_BITS = 33


def free_name(df: DataFrame, wish: str) -> str:
    """``wish`` with as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def sorted_places(df: DataFrame, order: Sequence[Column], at: str) -> DataFrame:
    """The rows range-partitioned and sorted by ``order``, written, with a column ``at`` of rising numbers.

    The number of the partition is in the bits above ``_PLACE_BITS``. Rows that
    tie in all of ``order`` are told apart by their place in the input, so that
    one hot key does not fill a partition. Sampling the splitters reads the input
    once more: pass a narrow or written table.
    """
    tie = free_name(df, "tie")
    keyed = df.withColumn(tie, F.monotonically_increasing_id())
    keys = [*order, F.col(tie)]
    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
    return through_table(ranged.withColumn(at, F.monotonically_increasing_id()), "sorted")


def _same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x & y, [a.eqNullSafe(b) for a, b in zip(left, right, strict=True)])


def with_positions(
    df: DataFrame,
    order_by: Sequence[Column | str],
    within: Sequence[str] = (),
    position: str = "position",
    total: str | None = None,
    group: str | None = None,
) -> DataFrame:
    """``df`` with ``position``: the place of a row, from 0, in the order of ``order_by`` (nulls first).

    With ``within``, places are counted inside each group of equal values there
    (nulls are one value), ``total`` names a column for the size of the group and
    ``group`` one for its number, from 0, in the order of ``within``. A group may
    hold any share of the rows: rows meet their offset by (partition, group).
    """
    order = [F.col(c).asc_nulls_first() for c in within]
    order += [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order_by]
    at, part = free_name(df, "at"), free_name(df, "part")
    rows = sorted_places(df, order, at).withColumn(part, F.shiftright(F.col(at), _PLACE_BITS))
    names = [f"key{k}" for k in range(len(within))]
    keys = [F.col(c).alias(n) for c, n in zip(within, names, strict=True)]
    # One row per partition and group.
    counts = rows.groupBy(F.col(part).alias("part"), *keys).agg(F.min(at).alias("least"), F.count(F.lit(1)).alias("n"))
    if group:
        counts = through_table(counts, "counts")
    before = Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")
    whole = F.sum("n").over(Window.partitionBy(*names))
    offsets = counts.select("part", *names, shift.alias("shift"), whole.alias("total"))
    if group:
        groups = with_positions(counts.select(*names).distinct(), names, position="number")
        renamed = groups.select(*[F.col(n).alias(f"of_{n}") for n in names], "number")
        offsets = offsets.join(renamed, _same([F.col(n) for n in names], [F.col(f"of_{n}") for n in names]))
    offsets = through_table(offsets, "offsets")
    found = F.struct("shift", "total", *(["number"] if group else []))
    holder = free_name(df, "offset")
    offsets = offsets.select(F.col("part").alias("offset_part"), *[F.col(n).alias(f"offset_{n}") for n in names], found.alias(holder))
    same = F.col(part) == F.col("offset_part")
    if within:
        same &= _same([rows[c] for c in within], [offsets[f"offset_{n}"] for n in names])
    wanted = [(F.col(at) + F.col(f"{holder}.shift")).alias(position)]
    wanted += [F.col(f"{holder}.total").alias(total)] if total else []
    wanted += [F.col(f"{holder}.number").alias(group)] if group else []
    return rows.join(offsets, same).select(*[rows[c] for c in df.columns], *wanted)
