"""Greedy weighted set cover over shared names, by components.

The procedure takes the heaviest set, uses its names up, weighs the others anew, drops those that
became too light, and goes on. Sets that share no name, not even through other sets, don't
influence one another, so each connected component of sets is finished by itself, in a task of
its own; sets that share nothing are taken as they are. Only components too large for one task
are thinned by parallel rounds first: a set that outweighs every set it shares a name with is
taken by the procedure before any of them, and nothing that happens elsewhere changes its weight,
so all such sets are taken in one round; what is left falls into smaller components.

Weights are exact: a name counts ``UNIT`` div its mapping count, and sums of such integers don't
depend on the order. They are compared and told as rounded to ``DIGITS`` digits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.session import cut, materialize

DIGITS = 9
UNIT = 10**15
ROUND = UNIT // 10**DIGITS
#: Rows of members that one task may finish.
GIANT = 500_000


def share(mapcount: Column) -> Column:
    """What a name counts, in units."""
    return F.floor(F.lit(UNIT) / mapcount.cast("decimal(20,0)")).cast("decimal(20,0)")


def _weight(total: Column) -> Column:
    """Units to weights: longs, in steps of the last digit."""
    return F.floor((total + ROUND // 2) / ROUND).cast("long")


def weights(members: DataFrame) -> DataFrame:
    """(set_id, name, mapcount) -> (set_id, weight, support): the sum of 1 / mapcount over distinct names."""
    w = members.groupBy("set_id").agg(_weight(F.sum(share(F.col("mapcount")))).alias("weight"))
    return w.withColumn("support", F.col("weight") / 10**DIGITS)


def shared_names(members: DataFrame) -> DataFrame:
    """(name, sets, first): names of more than one set, with the number of their sets and the smallest id of these."""
    return members.groupBy("name").agg(F.count("*").alias("sets"), F.min("set_id").alias("first")).where("sets > 1")


def touched_sets(members: DataFrame) -> DataFrame:
    """(set_id): sets with a name that another set has too."""
    return members.join(shared_names(members), "name", "left_semi").select("set_id").distinct()


def one_by_one(members: list[tuple[str, str, int]], min_weight: int) -> list[tuple[str, int]]:
    """The procedure itself: take the heaviest set (of equal ones the smallest id), use its names up, weigh anew. Weights are as in ``weights``."""
    names: dict[str, dict[str, int]] = {}
    sets: dict[str, list[str]] = {}
    for set_id, name, mapcount in members:
        names.setdefault(set_id, {})[name] = UNIT // mapcount
        sets.setdefault(name, []).append(set_id)
    total = {s: sum(n.values()) for s, n in names.items()}
    weigh = lambda s: (total[s] + ROUND // 2) // ROUND
    heap = [(-weigh(s), s) for s in names]
    heapq.heapify(heap)
    taken = []
    while heap:
        w, s = heapq.heappop(heap)
        if s not in total or -w != weigh(s):
            continue
        del total[s]
        if -w < min_weight:
            continue
        taken.append((s, -w))
        lighter = set()
        for name in names.pop(s):
            for other in sets.pop(name, ()):
                if other in total:
                    total[other] -= names[other].pop(name)
                    lighter.add(other)
        for other in lighter:
            heapq.heappush(heap, (-weigh(other), other))
    return taken


def _links(live: DataFrame) -> DataFrame:
    """(u, v): each name's sets linked to its first one, so a frequent name takes a row a set."""
    first = live.groupBy("name").agg(F.min("set_id").alias("v"), F.count("*").alias("n")).where("n > 1").select("name", "v")
    return live.join(first, "name").where("set_id <> v").select(F.col("set_id").alias("u"), "v")


def _round(live: DataFrame, min_weight: int) -> tuple[DataFrame, DataFrame]:
    """(set_id, name, mapcount) -> the sets that outweigh all they share a name with, and the members left of the others."""
    weighed = live.join(weights(live), "set_id")
    # Of each name the first set in the order: most weight, then smallest id.
    first = weighed.groupBy("name").agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col("set_id").alias("id"))).alias("best"))
    won = cut(weighed.join(first, "name").groupBy("set_id", "weight").agg(F.min(F.col("best.id") == F.col("set_id")).alias("won")).where("won").select("set_id", "weight"))
    used = live.join(won, "set_id", "left_semi").select("name").distinct()
    rest = live.join(won, "set_id", "left_anti").join(used, "name", "left_anti")
    heavy = weights(rest).where(F.col("weight") >= min_weight).select("set_id")
    return won, materialize(rest.join(heavy, "set_id", "left_semi").select("set_id", "name", "mapcount"))


def _finish(rows: DataFrame, min_weight: int) -> DataFrame:
    """(component, set_id, name, mapcount) -> (set_id, weight) of the taken sets; a component's rows come together in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int]] = []
        now, held = None, []
        for b in batches:
            for component, *row in zip(*(c.to_pylist() for c in b.columns)):
                if component != now:
                    out += one_by_one(held, min_weight)
                    now, held = component, []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.string()), pa.array([w for _, w in out], pa.int64())], ["set_id", "weight"])
            out = []
        out = one_by_one(held, min_weight)
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.string()), pa.array([w for _, w in out], pa.int64())], ["set_id", "weight"])

    dealt = rows.select("component", "set_id", "name", "mapcount").repartition("component").sortWithinPartitions("component")
    return dealt.mapInArrow(run, "set_id string, weight long")


def greedy_cover(sets: DataFrame, members: DataFrame, min_support: float, min_reads: int, giant: int = GIANT) -> DataFrame:
    """(set_id, raw_reads, ...) and (set_id, name, mapcount) -> (set_id, support) of the sets taken, with the support they were taken with.

    Sets with fewer reads or less support go, at first and whenever support falls. Of equal
    sets the smaller set_id is taken first. Names are distinct within a set; mapping counts are 1
    or more. Empty tables give an empty one.
    """
    min_weight = round(min_support * 10**DIGITS)
    allowed = sets.where(F.col("raw_reads") >= min_reads).select("set_id")
    live = members.join(allowed, "set_id", "left_semi").select("set_id", "name", "mapcount")
    heavy = weights(live).where(F.col("weight") >= min_weight).select("set_id")
    live = materialize(live.join(heavy, "set_id", "left_semi"))
    taken = []
    while True:
        found = connected_components(_links(live)).select(F.col("vertex").alias("set_id"), "component")
        placed = live.join(found, "set_id", "left")
        taken.append(weights(placed.where("component is null")).select("set_id", "weight"))
        placed = placed.where("component is not null")
        sizes = cut(placed.groupBy("component").agg(F.count("*").alias("rows")))
        large = sizes.where(F.col("rows") > giant).select("component")
        if large.isEmpty():
            taken.append(_finish(placed, min_weight))
            break
        taken.append(_finish(placed.join(large, "component", "left_anti"), min_weight))
        won, live = _round(placed.join(large, "component", "left_semi").select("set_id", "name", "mapcount"), min_weight)
        taken.append(won)
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out.select("set_id", (F.col("weight") / 10**DIGITS).alias("support"))


def calls(sets: DataFrame, taken: DataFrame, all_types: bool = False) -> DataFrame:
    """Taken sets as calls: chr, coordinates, event type, supports. Types that are not reported have consumed their names all the same."""
    event = F.when(F.col("svtype").isin("DELETION", "DELINV"), "DELETION").when(F.col("svtype").isin("INSERTION", "INSINV"), "INSERTION").when(F.col("svtype") == "EVERSION", "TANDEM")
    if all_types:
        event = F.coalesce(event, F.col("svtype"))
    return sets.join(taken, "set_id").withColumn("event", event).where("event is not null").select(
        "set_id", "chr", "start", "inner_start", "inner_end", "end", F.col("event").alias("svtype"), "disc_support", "split_support", "unbalanced_support", F.col("support").alias("weighted_support")
    )


def ranked(calls: DataFrame) -> DataFrame:
    """Calls by chromosome and whole support, the most first; equal ones by position."""
    return calls.orderBy("chr", F.desc(F.floor("weighted_support")), "start", "inner_start", "inner_end", "end", "svtype", "set_id")
