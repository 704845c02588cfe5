"""Library statistics: read lengths, insert sizes, thresholds of each read group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import DEVIATIONS, MAD_CUT
from tessera.functions.expr import MATE_UNMAPPED, PAIRED, UNMAPPED, has_bits, round_half_up, unused
from tessera.session import cut


def usable_inserts(reads: DataFrame) -> DataFrame:
    """Reads of mapped pairs with an insert size; adds ``size``, its absolute value."""
    f = F.col("flag")
    return reads.where(has_bits(f, PAIRED) & ~has_bits(f, UNMAPPED) & ~has_bits(f, MATE_UNMAPPED) & (F.col("tlen") != 0)).withColumn("size", F.abs("tlen"))


def read_length_mode(reads: DataFrame, least: int = 50) -> DataFrame:
    """(len) -> the most frequent length of ``least`` or more; of equal ones the longest."""
    counts = reads.where(F.col("len") >= least).groupBy("len").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.desc("len")).limit(1)


def first_of_group(rows: DataFrame, n: int, group: str, *order: str, buckets: int = 256) -> DataFrame:
    """The first ``n`` rows of each group in the given, total order, with their ``rank``.

    A group may be the whole table, so each is first cut to ``n`` rows in each of ``buckets``
    parts, and only what is left of these meets in one place.
    """
    part, place = unused(rows.columns, "_part", "_rank")
    near = F.row_number().over(Window.partitionBy(group, part).orderBy(*order))
    left = rows.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(buckets))).withColumn(place, near).where(F.col(place) <= n).drop(part, place)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return left.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def position_parts(rows: DataFrame, column: str, first: int, growth: int = 4, most: int = 1 << 40) -> Iterator[DataFrame]:
    """``rows`` in parts of growing ranges of a position that is 0 or more, in its order: [0, first), [first, first * growth), ..., the rest.

    The bounds are filters on the column, so that a table that is sorted or partitioned by it is
    read only where a part lies. Rows without a position come with the first part.
    """
    low, high = 0, first
    yield rows.where((F.col(column) < high) | F.col(column).isNull())
    while high < most:
        low, high = high, high * growth
        yield rows.where((F.col(column) >= low) & (F.col(column) < high))
    yield rows.where(F.col(column) >= high)


def first_of_group_in_parts(parts: Iterable[DataFrame], groups: list[str], n: int, group: str, *order: str, usable: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """first_of_group over parts of one table, which stops reading as soon as every one of ``groups`` (those of a header) has ``n`` rows.

    Groups are strings. Parts come in order: ``order`` puts no row of a later part before one of an earlier one. Of a
    later part only rows of groups that aren't full are read. A group with fewer rows than
    ``n`` makes it read every part; rows of groups that aren't named are left out. ``usable`` is
    applied to each part. The driver sees a count a group and part; no parts are an error.
    """
    missing = {g: n for g in groups}
    found, ranks = None, {}
    for part in parts:
        if not missing:
            break
        more = cut(first_of_group(usable(part.where(F.col(group).isin(list(missing)))), n, group, *order))
        have = {r[0]: r[1] for r in more.groupBy(group).agg(F.count("*")).collect()}
        (earlier,) = unused(more.columns, "_earlier")
        so_far = more.sparkSession.createDataFrame([(g, ranks.get(g, 0)) for g in missing], f"`{group}` string, {earlier} long")
        more = more.join(F.broadcast(so_far), group).withColumn("rank", F.col("rank") + F.col(earlier)).where(F.col("rank") <= n).select(more.columns)
        found = more if found is None else found.unionByName(more)
        for g, k in have.items():
            ranks[g] = ranks.get(g, 0) + k
        missing = {g: n - ranks.get(g, 0) for g in missing if ranks.get(g, 0) < n}
    if found is None:
        raise ValueError("no parts or no groups")
    return found


def order_median(values):
    """Of a sorted array: entry n/2 for even n; for odd n the floored mean of it and the next one, the last with itself."""
    n = F.size(values)
    half = F.floor(n / 2).cast("int")
    one, two = F.get(values, half), F.get(values, F.least(half + 1, n - 1))
    return F.when(n % 2 == 0, one).otherwise(F.floor((one + two) / 2))


def _spread(samples: DataFrame, group: str, value: str) -> DataFrame:
    got = samples.groupBy(group).agg(F.sort_array(F.collect_list(value)).alias("v"))
    got = got.select(group, F.size("v").cast("long").alias("n"), "v", order_median(F.col("v")).cast("long").alias("median"))
    off = F.sort_array(F.transform("v", lambda x: F.abs(x - F.col("median"))))
    return got.withColumn("off", off).select(group, "n", "v", "median", order_median(F.col("off")).cast("long").alias("mad"))


def median_and_mad(samples: DataFrame, group: str = "rg", value: str = "size") -> DataFrame:
    """(group, value) with bounded groups -> (group, n, median, mad)."""
    return _spread(samples, group, value).drop("v")


def thresholds(samples: DataFrame, max_distance: int, group: str = "rg", value: str = "size") -> DataFrame:
    """(group, value) -> (group, n_kept, n_outliers, mean, stdev, lower, upper, max_distance).

    One aggregate: a group's sample is bounded and its numbers come from one array. Values are kept below median + MAD_CUT * MAD; one equal to it is neither kept nor counted out.
    """
    got = _spread(samples, group, value).select(group, "v", F.filter("v", lambda x: x < F.col("median") + MAD_CUT * F.col("mad")).alias("kept"), F.filter("v", lambda x: x > F.col("median") + MAD_CUT * F.col("mad")).alias("out"))
    got = got.select(group, F.size("kept").cast("long").alias("n_kept"), F.size("out").cast("long").alias("n_outliers"), "kept")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    got = got.withColumn("mean", F.when(F.col("n_kept") > 0, total("kept") / F.col("n_kept")).otherwise(0.0))
    squares = total(F.transform("kept", lambda x: (x - F.col("mean")) * (x - F.col("mean"))))
    got = got.withColumn("stdev", F.when(F.col("n_kept") > 1, F.sqrt(squares / (F.col("n_kept") - 1))).otherwise(0.0)).drop("kept")
    lower, upper = round_half_up(F.col("mean") - DEVIATIONS * F.col("stdev")), round_half_up(F.col("mean") + DEVIATIONS * F.col("stdev"))
    return got.select("*", F.greatest(F.lit(0), lower).cast("long").alias("lower"), upper.cast("long").alias("upper"), F.lit(max_distance).cast("long").alias("max_distance"))
