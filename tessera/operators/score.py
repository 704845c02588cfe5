"""Scoring of calls against known events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import unused
from tessera.operators.intervals import overlap_pairs
from tessera.session import cut, materialize

SLOP = 100


def match_truth(calls: DataFrame, truth: DataFrame, slop: int = SLOP, caller: str | None = None) -> DataFrame:
    """(call_id, chr, start, end) and (truth_id, chr, start, end) -> (call_id, truth_id): each call with the first event that it overlaps and no earlier call has.

    Calls come by chr, start, end and id, events by start, end and id. A call all of whose events
    are taken is a repeat and has no row. Calls propose to their first event left and an event
    keeps its earliest call; as all events rank calls alike, this settles on what matching the
    calls one by one would give. Later calls leave a taken event's list at once, so rounds are few.
    ``caller`` names a column of the calls whose values are matched each by itself; it is returned, too.
    """
    who = (F.lit("") if caller is None else F.col(f"a.{caller}")).alias("caller")
    met = overlap_pairs(calls, truth, ["chr"], slop)
    call, event = F.struct("a.chr", "a.start", "a.end", "a.call_id", who), F.struct("b.start", "b.end", "b.truth_id", who)
    left = cut(met.select(call.alias("call"), event.alias("event"), F.col("b.chr").alias("chr")).distinct())
    while True:
        asked = left.groupBy("call").agg(F.min(F.struct("event", "chr")).alias("first")).select("call", "first.event", "first.chr")
        held = asked.groupBy("chr", "event").agg(F.min("call").alias("holder"))
        judged = left.join(held, ["chr", "event"], "left")
        if not judged.where("call > holder").limit(1).count():
            return held.select("holder.call_id", "event.truth_id", *([] if caller is None else [F.col("holder.caller").alias(caller)]))
        left = cut(judged.where("holder is null or call <= holder").select("call", "event", "chr"))


def precision_recall(calls: DataFrame, truth: DataFrame, slop: int = SLOP) -> DataFrame:
    """One row: n_calls, n_truth, n_found (events hit, each once), precision, recall."""
    found = match_truth(calls, truth, slop).agg(F.count_distinct("truth_id").alias("n_found"))
    totals = calls.agg(F.count("*").alias("n_calls")).crossJoin(truth.agg(F.count("*").alias("n_truth"))).crossJoin(found)  # one row each
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return totals.select("n_calls", "n_truth", "n_found", ratio("n_found", "n_calls").alias("precision"), ratio("n_found", "n_truth").alias("recall"))


def counts_by_type(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): events or sets for each chromosome or type."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


def support_matrix(matches: DataFrame, truth: DataFrame, callers: list[str]) -> DataFrame:
    """(caller, truth_id) hits -> a row for each event and a column of hits for each caller."""
    counts = matches.groupBy("truth_id").pivot("caller", callers).count()
    return truth.join(counts, "truth_id", "left").select(*truth.columns, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in callers))


def support_listing(calls: DataFrame, truth: DataFrame, slop: int = SLOP) -> DataFrame:
    """(caller, call_id, chr, start, end) and (truth_id, chr, start, end, ...) -> a row for each event and call that overlap: the event's columns, caller, call_id, call_start, call_end. Events without calls have no row."""
    met = overlap_pairs(calls, truth, ["chr"], slop)
    return met.select(*(f"b.{c}" for c in truth.columns), "a.caller", "a.call_id", F.col("a.start").alias("call_start"), F.col("a.end").alias("call_end"))


def recall_by_type(calls: DataFrame, truth: DataFrame, types: dict[str, str], slop: int = SLOP) -> DataFrame:
    """(caller, call_id, chr, start, end) and (truth_id, svtype, chr, start, end) -> a row for each caller of ``types``: caller, n_found, n_calls, precision, n_known, recall.

    ``types`` names the event type that a caller reports. Each caller's calls are matched by
    themselves, with events of any type; ``n_known`` counts the events of its type. A caller
    without calls and a type without events have zeros.
    """
    listed = F.broadcast(calls.sparkSession.createDataFrame(list(types.items()), "caller string, svtype string"))  # a row a caller
    counted = calls.groupBy("caller").agg(F.count("*").alias("n_calls"))
    found = match_truth(calls, truth, slop, "caller").groupBy("caller").agg(F.count("*").alias("n_found"))
    known = truth.groupBy("svtype").agg(F.count("*").alias("n_known"))
    got = counted.join(found, "caller", "left").join(listed, "caller", "right").join(known, "svtype", "left").na.fill(0, ["n_calls", "n_found", "n_known"])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return got.select("caller", "n_found", "n_calls", ratio("n_found", "n_calls").alias("precision"), "n_known", ratio("n_found", "n_known").alias("recall"))


def rank_within(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """Adds ``rank``, a long from 1 within equal keys (nulls are equal), by an order that tells the rows of a key apart.

    Rows are dealt out by ranges of keys and order and written once; a rank is the row's number in
    its range and what earlier ranges hold of the key, a prefix over one row a key and range. So one key
    may have most of the rows and still be many tasks' work.
    """
    part, before = unused([*rows.columns, "rank"], "_part", "_before")
    ordered = materialize(rows.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()))
    sizes = ordered.groupBy(*keys, part).agg(F.count("*").alias(before))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    placed = ordered.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order)))
    other = sizes.withColumnsRenamed({c: f"_of_{c}" for c in (*keys, part)})
    same = F.lit(True)
    for c in (*keys, part):
        same = same & placed[c].eqNullSafe(other[f"_of_{c}"])
    return placed.join(other, same).select(*rows.columns, (F.col("rank") + F.col(before)).alias("rank"))
