"""Exact and near de-duplication."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import text_digest
from corpusloom.operators.links import least_reachable
from corpusloom.session import through_table


#: Bits (2 MiB) of the filter that tells which texts may be repeated; it is broadcast as at most 2^18 rows.
FILTER_BITS = 24


def _filter_word(digest: Column) -> Column:
    return F.shiftrightunsigned(digest, 64 - FILTER_BITS + 6)


def _filter_bit(digest: Column) -> Column:
    place = F.shiftrightunsigned(digest, 64 - FILTER_BITS).bitwiseAND(F.lit(63))
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))


def exact_dedup(df: DataFrame, text: str, order_by: Sequence[str] | str) -> DataFrame:
    """First row of each text in the order of ``order_by``; missing texts equal each other.

    Only texts that may be repeated are shuffled. A first pass counts 8-byte
    digests; those seen twice set bits in a filter of fixed size, which is
    broadcast. Rows whose digest is not in it are unique and stay where they are.
    The others meet in a window by text, which keeps one row per group, so Spark
    limits each group before the shuffle as well (WindowGroupLimit): a text copied
    a billion times sends one row per map task. The filter lets a few unique texts
    through, more as it fills; the text itself decides equality.

    ``df`` is read three times: pass a table, or write costly work first.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    # A null text has the digest of its kind.
    digest = F.xxhash64(text)
    repeated = df.groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    words = repeated.groupBy(_filter_word(F.col("digest")).alias("__word")).agg(F.bit_or(_filter_bit(F.col("digest"))).alias("__bits"))
    # At most 2^(FILTER_BITS - 6) rows of two numbers.
    marked = df.withColumn("__digest", digest).withColumn("__word", _filter_word(F.col("__digest"))).join(
        F.broadcast(words), "__word", "left"
    )
    may_repeat = F.coalesce(F.col("__bits").bitwiseAND(_filter_bit(F.col("__digest"))), F.lit(0)) != 0
    first = Window.partitionBy("__digest", F.col(text)).orderBy(*order)
    copies = marked.where(may_repeat).withColumn("__copy", F.row_number().over(first)).where("__copy = 1")
    return marked.where(~may_repeat).select(*df.columns).unionByName(copies.select(*df.columns))


SHINGLE_WORDS = 5


def shingle_sets(df: DataFrame, text: str, id_col: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, members): hashes of the distinct runs of ``words`` words; a shorter text is one run, an empty one has none."""
    parts = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\f\r]+"), lambda w: w != "")
    count = F.greatest(F.size("w") - (words - 1), F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), count), lambda k: F.xxhash64(F.slice("w", k, words)))
    tokens = df.select(F.col(id_col).alias("id"), parts.alias("w"))
    return tokens.where(F.size("w") > 0).select("id", F.array_sort(F.array_distinct(runs)).alias("members"))


def _check(threshold: float) -> None:
    if not 0 < threshold <= 1:
        raise ValueError("similarity_threshold must lie in (0, 1]")


def _heads(classes: DataFrame, threshold: float) -> DataFrame:
    """(s, a, n): of each class, the rarest shingles that it must share one of with any similar class, and its size."""
    flat = classes.select("a", F.size("members").alias("n"), F.explode("members").alias("s"))
    rare = F.row_number().over(Window.partitionBy("a").orderBy("df", "s"))
    head = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    shared = flat.join(flat.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "s")
    # Shingles of one set alone are rarest but join with nothing: they only shorten the rest of the head.
    alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("a"))
    return shared.withColumn("place", rare).withColumn("alone", alone).where(F.col("place") + F.col("alone") <= head).select("s", "a", "n")


def similar_pairs(df: DataFrame, text: str, id_col: str, threshold: float, words: int = SHINGLE_WORDS) -> DataFrame:
    """(a, b, common, either) with a < b: all pairs whose Jaccard similarity reaches the threshold, exactly.

    Rows with equal sets are one class, tied to its smallest id. Two sets that
    reach the threshold share one of their rarest shingles: of a set of n, the
    n - ceil(threshold n) + 1 that the fewest sets have. Only those are joined,
    so a line that every text has makes no pair; candidates are verified on the
    whole sets.
    """
    _check(threshold)
    sets = shingle_sets(df, text, id_col, words)
    classes = sets.groupBy("members").agg(F.min("id").alias("a"))
    copies = sets.join(classes, "members").where("id != a").select(
        "a", F.col("id").alias("b"), F.size("members").alias("common"), F.size("members").alias("either")
    )
    heads = _heads(classes, threshold)
    other = heads.select("s", F.col("a").alias("b"), F.col("n").alias("m"))
    fits = F.least("n", "m") >= F.lit(threshold) * F.greatest("n", "m") - 1e-9
    candidates = heads.join(other, "s").where(F.col("a") < F.col("b")).where(fits).select("a", "b").distinct()
    one, two = classes.withColumnRenamed("members", "of_a"), classes.select(F.col("a").alias("b"), F.col("members").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    verified = candidates.join(one, "a").join(two, "b").select(
        "a", "b", common.alias("common"), (F.size("of_a") + F.size("of_b") - common).alias("either")
    )
    return verified.where(F.col("common") >= F.lit(threshold) * F.col("either") - 1e-9).unionByName(copies)


#: Members of a candidate group that one task compares at a time.
BLOCK = 1_024


def _group_links(threshold: float):
    """Links inside candidate groups (runs of equal ``key``, ``low``, ``high``): one per pair of labels that has one.

    Members of the label that most have are compared with the others only, so a
    group that one round has joined costs little.
    """

    def links(table: pd.DataFrame) -> list[tuple[int, int]]:
        ids, labels, sides = (table[c].to_numpy() for c in ("id", "label", "part"))
        apart = table["low"].iloc[0] != table["high"].iloc[0]
        members = table["members"].to_numpy()
        sizes = np.fromiter(map(len, members), np.int64, len(members))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        terms, place = np.unique(np.concatenate(members), return_inverse=True)
        names, counts = np.unique(labels, return_counts=True)
        marked, found = np.zeros(len(terms), np.int64), {}
        for k in np.flatnonzero(labels != names[np.argmax(counts)]):
            own = place[starts[k] : starts[k] + sizes[k]]
            marked[own] = 1
            common = np.add.reduceat(marked[place], starts)
            marked[own] = 0
            near = (common >= threshold * (sizes + sizes[k] - common) - 1e-9) & (labels != labels[k])
            if apart:
                near &= sides != sides[k]
            for j in np.flatnonzero(near):
                found.setdefault((min(labels[k], labels[j]), max(labels[k], labels[j])), (int(ids[k]), int(ids[j])))
        return list(found.values())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups come whole and one behind the other; only the last one of a batch may go on in the next."""
        rest, out = None, []
        for frame in frames:
            rows = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            keys = rows[["key", "low", "high"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *cuts[:-1]], cuts, strict=False):
                out += links(rows.iloc[begin:end])
            rest = rows.iloc[cuts[-1] :] if len(cuts) else rows
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []
        if rest is not None and len(rest):
            yield pd.DataFrame(links(rest), columns=["a", "b"])

    return run


def _classes_of(classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The classes with a wanted ``a``, so that the sets of the others are not shuffled.

    The ids are written first: Spark then knows their size and broadcasts them if they are few.
    """
    return classes.join(through_table(wanted.distinct(), "wanted"), "a", "left_semi")


def linked_groups(buckets: DataFrame, classes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(id, label): connected groups of the classes (a, members) that share a bucket (key, a) and reach the threshold.

    The rows grow with the sizes of the buckets, not with their squares: every
    member is first compared with the smallest of its bucket (a star); where
    members are still apart, the bucket is compared inside tasks, in blocks, and
    one link per pair of labels comes out. No link between groups is lost.
    """
    sized = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("first"))
    held = through_table(buckets.join(sized.where("n > 1"), "key"), "buckets")
    stars = through_table(held.where("a <> first").select(F.col("first").alias("a"), F.col("a").alias("b")).distinct(), "star-pairs")
    one = _classes_of(classes, stars.select("a")).select("a", F.col("members").alias("of_a"))
    two = _classes_of(classes, stars.select(F.col("b").alias("a"))).select(F.col("a").alias("b"), F.col("members").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    near = common >= F.lit(threshold) * (F.size("of_a") + F.size("of_b") - common) - 1e-9
    star_links = through_table(stars.join(one, "a").join(two, "b").where(near).select("a", "b"), "stars")
    labelled = through_table(
        held.join(least_reachable(star_links).withColumnRenamed("id", "a"), "a", "left").select(
            "key", "n", F.col("a").alias("id"), F.coalesce("label", "a").alias("label")
        ),
        "labelled-buckets",
    )
    # Buckets with the same members give the same links: one of them is enough.
    apart = (
        labelled.groupBy("key").agg(
            F.min("label").alias("least"), F.max("label").alias("most"), F.max("n").alias("n"),
            F.bit_xor(F.xxhash64("id")).alias("one"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("two"),
        )
        .where("least < most").groupBy("n", "one", "two").agg(F.min("key").alias("key"))
    )
    apart = through_table(apart.select("key", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks")), "apart")
    entries = through_table(
        labelled.join(apart, "key")
        .withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "id", "label"),
        "entries",
    )
    compared = _classes_of(classes, entries.select(F.col("id").alias("a"))).select(F.col("a").alias("id"), "members")
    rest = through_table(
        entries.join(compared, "id").select("key", "low", "high", "part", "id", "label", "members")
        .repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        .mapInPandas(_group_links(threshold), "a bigint, b bigint"),
        "block-links",
    )
    return least_reachable(star_links.unionByName(rest))


def _rare_buckets(classes: DataFrame, threshold: float) -> DataFrame:
    """(key, a): the classes by each of their rarest shingles, of which two similar sets share one."""
    return _heads(classes, threshold).select(F.col("s").alias("key"), "a")


#: Bands and rows of the hashed form; a pair of similarity 0.9 is missed with a probability below 1e-7.
BANDS, ROWS = 16, 4


def band_buckets(classes: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, a): the classes by each band of a MinHash signature, all in column expressions.

    Coordinate k is the least hash of the shingles with seed k. The shingles of a
    class stand together, so its minima are taken before the shuffle.
    """
    flat = classes.select("a", F.explode("members").alias("s"))
    signature = flat.groupBy("a").agg(*[F.min(F.xxhash64("s", F.lit(k))).alias(f"h{k}") for k in range(bands * rows)])
    keys = [F.xxhash64(F.lit(b), *[f"h{b * rows + r}" for r in range(rows)]) for b in range(bands)]
    return signature.select(F.explode(F.array(*keys)).alias("key"), "a")


def near_dedup(
    df: DataFrame, text: str, id_col: str, similarity_threshold: float = 0.9, hashed: bool = False
) -> DataFrame:
    """One row of each group of similar texts, the one with the smallest id; ids must be unique integers.

    Two texts are similar if the Jaccard similarity of their shingle sets reaches
    the threshold, and groups are connected over similar pairs. Candidates share
    one of their rarest shingles, which finds every pair, or, with ``hashed``, a
    band of a MinHash signature, which needs no counts over the table; both are
    verified on whole sets by :func:`linked_groups`. Texts without words are
    similar to nothing.
    """
    _check(similarity_threshold)
    sets = through_table(
        shingle_sets(df, text, id_col).select(
            "*", F.xxhash64("members").alias("one"), F.xxhash64(F.lit(7), "members").alias("two"), F.monotonically_increasing_id().alias("row")
        ),
        "shingle-sets",
    )
    # Equal sets meet by 128 bits of hash; of a class, the row with its smallest id holds the set.
    own = F.when(F.col("id").isNotNull(), F.struct("id", "row"))
    others = through_table(
        sets.select("id", "row", "one", "two")
        .join(sets.groupBy("one", "two").agg(F.min(own).alias("first")), ["one", "two"])
        .where("first IS NULL OR row <> first.row").select("id", "row", F.col("first.id").alias("a")),
        "other-rows",
    )
    classes = through_table(
        sets.join(others.select("row"), "row", "left_anti").select("members", F.col("id").alias("a")), "classes"
    )
    copies = others.where("id <> a").select("a", F.col("id").alias("b"))
    buckets = band_buckets(classes) if hashed else _rare_buckets(classes, similarity_threshold)
    groups = linked_groups(buckets, classes, similarity_threshold)
    # A copy goes with its class, whatever the class is linked to; of a group, the smallest class stays.
    dropped = groups.where("id <> label").select("id").unionByName(copies.select(F.col("b").alias("id")))
    return df.join(dropped.select(F.col("id").alias(id_col)), id_col, "left_anti")


def kept_ids(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """Ids of the rows :func:`exact_dedup` keeps, without moving any text."""
    per_text = df.groupBy(text_digest(F.col(text)).alias("key")).agg(F.min(id_col).alias(id_col))
    return per_text.select(id_col)


def hash_text(df: DataFrame, text: str, alias: str = "text_hash") -> DataFrame:
    """Add the hexadecimal MD5 of the text."""
    return df.withColumn(alias, F.md5(F.col(text)))


def dedup_counts(df: DataFrame, text: str) -> DataFrame:
    """Rows before, after and removed by exact de-duplication."""
    per_text = df.groupBy(text_digest(F.col(text)).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return per_text.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows_removed"),
    )
