"""Interval joins, islands and merges.

An overlap join needs an equality to be hashed on. Every interval has a home level, the
finest whose bins are as wide as it is, so it lies in two bins there at most; it also visits
the bins of the coarser levels. Two intervals meet once, in the first common bin of the
coarser one's home level: home meets home or visitor, never visitor visitor. So there is
no nested loop, no limit on lengths, and no interval takes more than a dozen rows.

Pairs are as many as there are, so what needs no pairs is found without: ``without_overlap`` by
how far the right side reaches, ``overlap_counts`` by counting bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import BIN
from tessera.functions.expr import overlaps, unused

WIDTHS = [BIN << (3 * k) for k in range(6)]
#: Width of the pieces in which islands are looked for.
ISLAND_BIN = 1 << 20


def _bin(x, width) -> Column:
    return F.floor(x / width).cast("long")


def _level(length: Column) -> Column:
    level = F.lit(len(WIDTHS) - 1)
    for k in range(len(WIDTHS) - 2, -1, -1):
        level = F.when(length <= WIDTHS[k], k).otherwise(level)
    return level


def _binned(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """(…) -> (name: struct of the row, home, level, bin, from): a row for each bin of each level from the home level on."""
    widths = F.array(*(F.lit(w).cast("long") for w in WIDTHS))
    d = df.select(F.struct(*df.columns).alias(name), _level(F.col(end) - F.col(start)).alias("home"))
    d = d.select(name, "home", F.explode(F.sequence("home", F.lit(len(WIDTHS) - 1))).alias("level"))
    d = d.select("*", F.get(widths, F.col("level")).alias("w"))
    first, last = _bin(F.col(f"{name}.{start}"), F.col("w")), _bin(F.col(f"{name}.{end}"), F.col("w"))
    return d.select(name, "home", "level", first.alias("first"), F.explode(F.sequence(first, F.greatest(first, last))).alias("bin"))


def overlap_pairs(left: DataFrame, right: DataFrame, on: list[str], slop: int = 0, left_cols=("start", "end"), right_cols=("start", "end")) -> DataFrame:
    """Each pair of overlapping rows, once: columns ``a`` and ``b``, structs of the two rows.

    ``on``: columns that have to be equal (the chromosome). Intervals are half open; touching
    ones don't overlap. ``slop`` widens the right side's intervals by so much at both ends.
    Rows with nulls in the columns concerned meet nothing.
    """
    (ls, le), (rs, re) = left_cols, right_cols
    s, e = unused(right.columns, "_s", "_e")
    right = right.withColumns({s: F.col(rs) - slop, e: F.col(re) + slop})
    a, b = _binned(left.where(F.col(ls).isNotNull() & F.col(le).isNotNull()), ls, le, "a"), _binned(right.where(F.col(s).isNotNull() & F.col(e).isNotNull()), s, e, "b")
    a, b = [d.select(*(F.col(f"{n}.{c}").alias(f"k{i}") for i, c in enumerate(on)), *d.columns) for d, n in ((a, "a"), (b, "b"))]
    keys = [f"k{i}" for i in range(len(on))]
    b = b.withColumnsRenamed({"home": "bhome", "first": "bfirst"})
    meet = overlaps(F.col(f"a.{ls}"), F.col(f"a.{le}"), F.col(f"b.{s}"), F.col(f"b.{e}")) & (F.col("bin") == F.greatest("first", "bfirst"))

    def join(x: DataFrame, y: DataFrame) -> DataFrame:
        # Spark takes a table's size for that of its rows in bins, and would broadcast millions.
        return x.join(y.hint("merge"), [*keys, "level", "bin"]).where(meet).select("a", "b")

    found = join(a.where("home = level"), b).union(join(a.where("home < level"), b.where("bhome = level")))
    return found.withColumn("b", F.col("b").dropFields(s, e))


def without_overlap(left: DataFrame, right: DataFrame, on: list[str], key: str | None = None, slop: int = 0, left_cols=("start", "end"), right_cols=("start", "end")) -> DataFrame:
    """Rows of ``left`` that overlap no row of ``right`` (as in ``overlap_pairs``), each once, however many it would meet. ``key`` isn't needed.

    A row meets one if, of those that start before its end, the one that reaches furthest ends
    after its start. That is a running maximum over pieces of a chromosome, and a prefix over
    one row a piece. ``left`` and ``right`` are read twice.
    """
    (ls, le), (rs, re) = left_cols, right_cols
    keys = [f"k{i}" for i in range(len(on))]
    l = left.select(*(F.col(c).alias(k) for c, k in zip(on, keys)), F.col(le).alias("at"), F.lit(0).alias("side"), F.col(ls).alias("begin"), F.struct(*left.columns).alias("row"))  # noqa: E741
    r = right.select(*(F.col(c).alias(k) for c, k in zip(on, keys)), (F.col(rs) - slop).alias("at"), F.lit(1).alias("side"), (F.col(re) + slop).alias("far")).dropna(subset=[*keys, "at", "far"])
    both = l.unionByName(r, allowMissingColumns=True).withColumn("piece", _bin(F.col("at"), BIN))
    earlier = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    reach = both.groupBy(*keys, "piece").agg(F.max("far").alias("far")).withColumn("before", F.max("far").over(earlier)).drop("far")
    # At one position the left rows come first: what starts at their end doesn't overlap.
    here = Window.partitionBy(*keys, "piece").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = both.withColumn("far", F.max("far").over(here)).where("side = 0")
    # Rows without a key or an end have nothing before them either. The window has dealt rows out for the join.
    d = d.join(reach, [*keys, "piece"], "left")
    return d.where(F.coalesce(F.greatest("far", "before") <= F.col("begin"), F.lit(True))).select("row.*")


def _ranks_below(x: np.ndarray, w: np.ndarray, y: np.ndarray, k: np.ndarray, side: str) -> np.ndarray:
    """For each (y, k), how many points (x, w) have w <= k and x <= y (side ``right``) or x < y (``left``): bit by bit of w's rank, all at once."""
    along = np.argsort(x, kind="stable")
    by_w = np.argsort(w, kind="stable")
    rank = np.empty(len(w), np.int64)
    rank[by_w] = np.arange(len(w))
    rank = rank[along]
    limit = np.searchsorted(w[by_w], k, "right")
    low, high = np.zeros(len(y), np.int64), np.searchsorted(x[along], y, side)
    found = np.zeros(len(y), np.int64)
    for bit in range(len(w).bit_length() - 1, -1, -1):
        one = (rank >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        up = (limit >> bit & 1).astype(bool)
        below, until = zeros[low], zeros[high]
        found += np.where(up, until - below, 0)
        low, high = np.where(up, zeros[-1] + low - below, below), np.where(up, zeros[-1] + high - until, until)
        rank = np.concatenate([rank[~one], rank[one]])
    return found


def _counted(rows: DataFrame, keys: list[str], region_key: str) -> DataFrame:
    """Regions (side 0: low, high, w = high - low) and intervals (side 1: low, high, w) by keys -> (region_key, n): the intervals of a key with low <= high of them within the region's and w up to the region's.

    As many as have their high one up to the region's end, less those that have their low one before
    its start: none of w up to the region's length lies across both. A key's regions are held, its intervals are a stream.
    """
    columns = [*keys, "side", "low", "high", "w", region_key]
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, counts, ids = None, [], None, []

        def told() -> pa.RecordBatch:
            some = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids).take(pa.array(some)), pa.array(counts[some], pa.int64())], [region_key, "n"])

        for b in batches:
            if not b.num_rows:
                continue
            change = np.zeros(b.num_rows, bool)
            for c in b.columns[:n]:
                change[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            side, *values = (b.column(i).to_numpy(zero_copy_only=False) for i in range(n, n + 4))
            cuts = [0, *np.flatnonzero(change), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                key = tuple(c[i].as_py() for c in b.columns[:n])
                if key != now:
                    if counts is not None:
                        yield told()
                    now, held, counts, ids = key, [], None, []
                m = i + int(np.searchsorted(side[i:j], 1))
                if m > i:
                    held.append([v[i:m] for v in values])
                    ids.append(b.column(n + 4)[i:m])
                if m < j and held:
                    if counts is None:
                        held = [[np.concatenate(v) for v in zip(*held)]]
                        counts = np.zeros(len(held[0][0]), np.int64)
                    (start, end, length), (low, high, w) = held[0], [v[m:j] for v in values]
                    counts += _ranks_below(high, w, end, length, "right") - _ranks_below(low, w, start, length, "left")
        if counts is not None:
            yield told()

    schema = T.StructType([rows.schema[region_key], T.StructField("n", T.LongType())])
    return rows.select(columns).repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(run, schema)


def overlap_counts(left: DataFrame, regions: DataFrame, on: list[str], region_key: str, share: float = 0.5) -> DataFrame:
    """(region_key, n): how many left intervals lie in each region with ``share`` of their length or more; 0 included. Positions are integers.

    An interval of which half or more has to lie in the region is counted without its pairs: with w
    the length that has to, start + w and end - w lie in the region, and w is no longer than it. So regions stand in the
    bins that they touch at their home level, an interval in the one of end - w at each level where such regions are. For a
    lesser share, and for intervals without a length, pairs are looked at.
    """
    length = F.col("end") - F.col("start")
    whole = regions.dropna(subset=[*on, "start", "end"]).where("start <= end")
    longest = whole.agg(F.max(length)).first()[0] if share >= 0.5 else None
    sparse = left if longest is None else left.where("start >= end")
    pairs = overlap_pairs(sparse, regions, on)
    common = F.least("a.end", "b.end") - F.greatest("a.start", "b.start")
    met = pairs.where(common >= share * (F.col("a.end") - F.col("a.start"))).groupBy(F.col(f"b.{region_key}").alias(region_key)).agg(F.count("*").alias("n"))
    if longest is not None:
        keys = [f"_k{i}" for i in range(len(on))]
        same, widths = [F.col(c).alias(k) for c, k in zip(on, keys)], F.array(*(F.lit(w).cast("long") for w in WIDTHS))
        top = next((k for k, w in enumerate(WIDTHS) if longest <= w), len(WIDTHS) - 1)
        places = [*keys, "_level", "_bin"]
        w = F.ceil(share * length).cast("long")
        points = left.where("start < end").select(*same, (F.col("end") - w).cast("long").alias("low"), (F.col("start") + w).cast("long").alias("high"), w.alias("w"), length.alias("_l")).dropna(subset=keys)
        points = points.where((F.col("w") <= F.least(F.col("_l"), F.lit(longest)))).select("*", F.explode(F.sequence(_level(F.col("w")), F.lit(top))).alias("_level"))
        points = points.select("*", _bin(F.col("low"), F.get(widths, F.col("_level"))).alias("_bin"), F.lit(1).alias("side"))
        own = whole.select(*same, F.col("start").cast("long").alias("low"), F.col("end").cast("long").alias("high"), length.cast("long").alias("w"), _level(length).alias("_level"), F.lit(0).alias("side"), region_key)
        bins = [_bin(F.col(c), F.get(widths, F.col("_level"))) for c in ("low", "high")]
        own = own.select("*", F.explode(F.sequence(*bins)).alias("_bin"))
        met = met.unionByName(_counted(own.unionByName(points.drop("_l"), allowMissingColumns=True), places, region_key)).groupBy(region_key).agg(F.sum("n").alias("n"))
    return regions.select(region_key).join(met, region_key, "left").select(region_key, F.coalesce("n", F.lit(0)).alias("n"))


def islands(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Adds ``island``: the start of the first interval of each chain of overlapping or touching ones within the keys.

    Windows run over pieces of a chromosome. What a piece has to know of those before it (how
    far they reach, where their last island began) is a prefix over one row a piece.
    """
    at, far, top, head, origin = unused([*rows.columns, "island"], "_piece", "_far", "_max", "_head", "_from")
    piece = [*keys, at]
    d = rows.withColumn(at, _bin(F.col(start), ISLAND_BIN))
    along = Window.partitionBy(*piece).orderBy(start, end)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    reach = d.groupBy(*piece).agg(F.max(end).alias(far)).withColumn(far, F.max(far).over(over))
    # Every row has a piece of its own table, so the join loses none; keys are compared null-safe.
    d = _join_pieces(d, reach, piece)
    d = d.withColumn(top, F.greatest(F.max(end).over(before), F.col(far)))
    d = d.withColumn(head, F.when(F.col(top).isNull() | (F.col(start) > F.col(top)), F.col(start)))
    heads = d.groupBy(*piece).agg(F.max(head).alias(origin)).withColumn(origin, F.max(origin).over(over))
    d = _join_pieces(d, heads, piece)
    # By range, as rows of one start may come in another order than above.
    here = F.max(head).over(Window.partitionBy(*piece).orderBy(start).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return d.withColumn("island", F.greatest(here, F.col(origin))).select(*rows.columns, "island")


def _join_pieces(rows: DataFrame, small: DataFrame, piece: list[str]) -> DataFrame:
    other = small.withColumnsRenamed({c: f"__{c}" for c in piece})
    same = F.lit(True)
    for c in piece:
        same = same & rows[c].eqNullSafe(other[f"__{c}"])
    return rows.join(other, same, "left").drop(*(f"__{c}" for c in piece))


def merge(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row an island: keys, start, end, n."""
    return islands(rows, keys).groupBy(*keys, "island").agg(F.max("end").alias("end"), F.count("*").alias("n")).select(*keys, F.col("island").alias("start"), "end", "n")


def next_after(left: DataFrame, right: DataFrame, keys: list[str], at: str, within: int, right_at: str) -> DataFrame:
    """Each left row with the nearest right position at or after it within the distance (null where there is none).

    ``right_at`` names the right side's position column, in the result too; equal positions
    match. Positions are cut into pieces of the distance: what a row looks for is in its own
    piece, found along a window, or the first of the next piece.
    """
    l = left.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_row"))  # noqa: E741
    r = right.where(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("_at"), F.lit(1).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_piece", _bin(F.col("_at"), within))
    ahead = Window.partitionBy(*keys, "_piece").orderBy(F.desc("_at"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("_next", F.last(F.when(F.col("_side") == 1, F.col("_at")), ignorenulls=True).over(ahead)).where("_side = 0")
    first = r.groupBy(*keys, (_bin(F.col("_at"), within) - 1).alias("_piece")).agg(F.min("_at").alias("_first"))
    near = near.join(first, [*keys, "_piece"], "left").withColumn("_next", F.coalesce("_next", "_first"))
    return near.select("_row.*", F.when(F.col("_next") - F.col("_at") <= within, F.col("_next")).alias(right_at))
