"""The two whole plans: reads to pairs and splits, and evidence to ranked calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.config import ClusterOptions, PairOptions
from tessera.functions.expr import unused
from tessera.operators import cluster, cover, intervals, pairs, splits, stats
from tessera.session import cut, materialize


def detect(reads: DataFrame, options: PairOptions, seen: Observation | None = None) -> dict[str, DataFrame]:
    """Reads -> limits of the read groups, discordant pairs, split reads and anchors.

    One exchange by (rg, clone) serves the mate join and the fragment flags; thresholds are a
    row a read group and travel to the tasks. ``seen`` is told, by the one job that reads all
    reads after that, ``reads`` and ``reads_without_limits``, those of groups that have none and are left out.
    """
    r = reads if options.use_read_groups else reads.withColumn("rg", F.lit("D"))
    limits = cut(stats.thresholds(stats.first_of_group(stats.usable_inserts(r), options.sample, "rg", "chr", "pos", "clone", "num", "flag", "tlen", "cigar"), options.max_distance))
    if seen is not None:
        (known,) = unused(r.columns, "_known")
        r = r.join(F.broadcast(limits.select("rg", F.lit(True).alias(known))), "rg", "left")
        r = r.observe(seen, F.count("*").alias("reads"), F.count_if(F.col(known).isNull()).alias("reads_without_limits")).drop(known)
    flagged = materialize(pairs.split_and_anchor_flags(pairs.filter_reads(r, limits)))
    mapped = flagged.unionByName(pairs.alternative_hits(flagged))
    found = pairs.discordant(pairs.classify(pairs.mate_pairs(mapped), limits)).withColumn("name", F.col("clone"))
    return {
        "limits": limits, "pairs": found, "splits": flagged.where("has_split and not is_anchor"),
        "anchors": flagged.where("has_split and is_anchor"), "states": pairs.fragment_states(flagged),
    }


def evidence(discordant: DataFrame, anchors: DataFrame, halves: DataFrame, gaps: DataFrame | None, options: ClusterOptions) -> DataFrame:
    """Usable pairs and paired split halves, without what touches a gap."""
    a = anchors.join(anchors.groupBy("clone").agg(F.count("*").alias("mapcount")), "clone")
    counts = a.select(F.col("clone").alias("name"), "mapcount").distinct()
    both = pairs.pair_evidence(pairs.usable_pairs(discordant, options.min_probability)).unionByName(splits.split_evidence(anchors, halves, counts))
    if options.chromosome:
        both = both.where(F.col("chr") == options.chromosome)
    if gaps is None:
        return both
    # What is left is read by each sweep and each of its steps.
    return materialize(intervals.without_overlap(materialize(both), gaps, ["chr"]))


def call_events(found: DataFrame, options: ClusterOptions) -> DataFrame:
    """Evidence -> ranked calls."""
    made = cluster.evidence_sets(found)
    taken = cover.greedy_cover(made.sets, cluster.set_members(made, options.unify_names), options.min_support, options.min_reads)
    return cover.ranked(cover.calls(made.sets, taken, options.emit_all_types))
