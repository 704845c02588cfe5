"""Fragments: filters, alternative hits, mate joins and classification of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import expr as X


def filter_reads(reads: DataFrame, limits: DataFrame) -> DataFrame:
    """Reads worth looking at: placed, primary, and not proper by their group's thresholds.

    ``limits`` has a row a read group and is small; reads of groups without one are dropped.
    """
    clip = X.soft_clip(F.col("cigar"))
    f = F.col("flag")
    kept = reads.where(X.is_placed_unless_both_lost(f) & ~X.has_bits(f, X.SECONDARY)).withColumn("clip", clip)
    kept = kept.join(F.broadcast(limits.select("rg", "lower", "upper")), "rg")
    return kept.where(~X.is_proper(f, F.col("tlen"), F.col("clip"), F.col("len"), F.col("lower"), F.col("upper"))).drop("lower", "upper")


def alternative_hits(reads: DataFrame) -> DataFrame:
    """One row for each hit of the ``xa`` tag (chr,+-pos,cigar,edits;): the read's row with that chr and pos.

    Hits on the reverse strand start a read length earlier; flags stay the primary's. Hits
    without a place are left out.
    """
    hit = F.split(F.col("hit"), ",")
    place = F.regexp_extract(F.get(hit, F.lit(1)), "([+-])([0-9]+)", 2)
    sign = F.regexp_extract(F.get(hit, F.lit(1)), "([+-])([0-9]+)", 1)
    rows = reads.withColumn("hit", F.explode(F.split("xa", ";"))).where(F.col("hit") != "").where(place != "")
    rows = rows.select("*", F.get(hit, F.lit(0)).alias("hit_chr"), (place.cast("long") - F.when(sign == "-", F.col("len")).otherwise(0)).alias("hit_pos"))
    return rows.withColumns({"chr": F.col("hit_chr"), "pos": F.col("hit_pos")}).drop("hit", "hit_chr", "hit_pos")


def mate_pairs(reads: DataFrame) -> DataFrame:
    """Every first with every second mate's row of a fragment: one equi-join on (rg, clone).

    Where reads have ``edits`` or ``qual``, pairs have ``edits``, the mean edit distance, and
    ``quality``, the mean of the mates' mean base qualities.
    """
    further = {"edits": F.col("edits"), "quality": X.mean_quality(F.col("qual"))}
    further = {n: c for n, c in further.items() if {"edits": "edits", "quality": "qual"}[n] in reads.columns}
    side = lambda n: reads.where(F.col("num") == n).select("rg", "clone", *(F.col(c).alias(f"{c}{n}") for c in ("chr", "pos", "orient", "mapq", "len")), *(c.alias(f"{k}{n}") for k, c in further.items()))
    got = side(1).join(side(2), ["rg", "clone"])
    return got.select(
        "rg", "clone", "chr1", F.col("pos1").alias("start1"), (F.col("pos1") + F.col("len1")).alias("end1"), "orient1",
        "chr2", F.col("pos2").alias("start2"), (F.col("pos2") + F.col("len2")).alias("end2"), "orient2",
        ((X.map_probability(F.col("mapq1")) + X.map_probability(F.col("mapq2"))) / 2).alias("prob"),
        *(((F.col(f"{k}1") + F.col(f"{k}2")) / 2).alias(k) for k in further),
    )


def classify(pairs: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``svtype`` by the read group's thresholds (a small table); pairs of unknown groups are dropped."""
    got = pairs.join(F.broadcast(limits.select("rg", "lower", "upper", "max_distance")), "rg")
    args = [F.col(c) for c in ("chr1", "start1", "end1", "orient1", "chr2", "start2", "end2", "orient2", "lower", "upper", "max_distance")]
    return got.withColumn("svtype", X.pair_class(*args)).drop("lower", "upper", "max_distance")


def discordant(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("svtype") != "concordant")


def fragment_states(reads: DataFrame) -> DataFrame:
    """(state, n): fragments with both mates (0), without the first (1), the second (2) or both (3), of those with more than one row."""
    seen = reads.groupBy("rg", "clone").agg(F.max(F.col("num") == 1).alias("one"), F.max(F.col("num") == 2).alias("two"), F.count("*").alias("rows"))
    state = F.when(F.col("one") & F.col("two"), 0).when(F.col("two"), 1).when(F.col("one"), 2).otherwise(3)
    return seen.where("rows > 1").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def split_and_anchor_flags(reads: DataFrame) -> DataFrame:
    """Adds is_split, is_anchor, and has_split: whether any row of the fragment is split."""
    f, clip, length = F.col("flag"), X.soft_clip(F.col("cigar")), F.col("len")
    got = reads.select("*", X.is_split(f, clip, length).alias("is_split"), X.is_anchor(f, F.col("chr"), clip, length).alias("is_anchor"))
    return got.withColumn("has_split", F.max("is_split").over(Window.partitionBy("rg", "clone")))


def mapping_counts(rows: DataFrame, name: str = "name") -> DataFrame:
    """(name, mapcount): over all rows, so before any filter."""
    return rows.groupBy(name).agg(F.count("*").alias("mapcount"))


def with_mapping_counts(rows: DataFrame, name: str = "name") -> DataFrame:
    """Adds mapcount. A join with the aggregate rather than a window, so a frequent name is summed before the shuffle."""
    return rows.join(mapping_counts(rows, name), name)


def usable_pairs(pairs: DataFrame, min_probability: float) -> DataFrame:
    """Discordant rows on one chromosome that are probable enough and of a type that is clustered; counts come first."""
    counted = with_mapping_counts(pairs)
    return counted.where((F.col("chr1") == F.col("chr2")) & (F.col("prob") > min_probability) & ~F.col("svtype").isin("concordant", "transchr", "inversion"))


def pair_evidence(pairs: DataFrame) -> DataFrame:
    """Usable pairs as evidence: outer and inner hull, type, flags; one row a pair."""
    start, inner_start, inner_end, end = X.hull(F.col("start1"), F.col("end1"), F.col("start2"), F.col("end2"))
    return pairs.select(
        "name", F.col("chr1").alias("chr"), start.alias("start"), inner_start.alias("inner_start"), inner_end.alias("inner_end"), end.alias("end"),
        X.evidence_type(F.col("svtype")).alias("svtype"), F.lit("disc").alias("kind"), (F.col("orient1") == "F").alias("forward"), "mapcount", "prob",
    )
