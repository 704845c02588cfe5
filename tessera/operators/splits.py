"""Split reads: halving, anchors, and pairing of halves with anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import MAX_HALVES
from tessera.functions import expr as X


def halve(reads: DataFrame, half: int) -> DataFrame:
    """(name, seq, qual) -> (name, status, seq1, qual1, seq2, qual2).

    Reads are cut in the middle (an odd last base is left out) and trimmed at the outer ends to
    halves of ``half`` bases. status: ok, trimmed, short (dropped) or error (lengths differ);
    the halves are null for the last two.
    """
    middle = F.floor(F.length("seq") / 2).cast("int")
    extra = middle - half
    status = F.when(F.length("seq") != F.length("qual"), "error").when(middle < half, "short").when(middle > half, "trimmed").otherwise("ok")
    d = reads.select("name", status.alias("status"), middle.alias("m"), extra.alias("x"), "seq", "qual")
    cut = lambda c, at: F.when(F.col("status").isin("ok", "trimmed"), F.substring(F.col(c), at, F.lit(half)))
    left, right = F.col("x") + 1, F.col("m") + 1
    return d.select("name", "status", cut("seq", left).alias("seq1"), cut("qual", left).alias("qual1"), cut("seq", right).alias("seq2"), cut("qual", right).alias("qual2"))


def as_fastq(halves: DataFrame) -> DataFrame:
    """One text value for each half: four lines, names with _1 and _2."""
    each = F.explode(F.array(*(F.concat_ws("\n", F.concat(F.lit("@"), "name", F.lit(f"_{k}")), F.col(f"seq{k}"), F.lit("+"), F.col(f"qual{k}")) for k in (1, 2))))
    return halves.where(F.col("status").isin("ok", "trimmed")).select(each.alias("value"))


def half_counts(halves: DataFrame) -> DataFrame:
    """(clone, n, n_first): halves of each clone, and those that are first halves."""
    return halves.groupBy("clone").agg(F.count("*").alias("n"), F.count_if("is_first").alias("n_first"))


def anchored_halves(anchors: DataFrame, halves: DataFrame) -> DataFrame:
    """Anchors joined with their clone's halves; repetitive clones are left out before the join."""
    counted = halves.join(half_counts(halves).where(F.col("n") < MAX_HALVES), "clone")
    a = anchors.select("clone", *(F.col(c).alias(f"anchor_{c}") for c in ("chr", "start", "forward", "prob")))
    return a.join(counted, "clone")


def unbalanced(anchors: DataFrame, halves: DataFrame) -> DataFrame:
    """Evidence of halves without a partner: the only half, near its anchor; or each of several of one side."""
    got = anchored_halves(anchors, halves)
    near = X.anchored(F.col("anchor_chr"), F.col("anchor_start"), F.col("chr"), F.col("start"))
    one_sided = (F.col("n_first") == 0) | (F.col("n_first") == F.col("n"))
    return got.where(((F.col("n") == 1) & near) | ((F.col("n") > 1) & one_sided)).select(
        "clone", "chr", "start", "end", "forward", "is_first", "anchor_chr", "anchor_start", F.col("anchor_prob").alias("prob"), F.lit("UNBALANCEDINV").alias("svtype")
    )


def balanced(anchors: DataFrame, halves: DataFrame) -> DataFrame:
    """Evidence of first and second halves: near the anchor (of two halves the first, of more either), and apart.

    Fewer than MAX_HALVES halves bound what a clone can give.
    """
    counts = half_counts(halves).where((F.col("n") < MAX_HALVES) & (F.col("n_first") > 0) & (F.col("n_first") < F.col("n")))
    side = lambda first, k: halves.where(F.col("is_first") == F.lit(first)).select("clone", *(F.col(c).alias(f"{c}{k}") for c in ("chr", "start", "end", "forward")))
    a = anchors.select("clone", *(F.col(c).alias(f"anchor_{c}") for c in ("chr", "start", "forward", "prob")))
    got = counts.join(a, "clone").join(side(True, 1), "clone").join(side(False, 2), "clone")
    near = [X.anchored(F.col("anchor_chr"), F.col("anchor_start"), F.col(f"chr{k}"), F.col(f"start{k}")) for k in (1, 2)]
    apart = X.halves_apart(F.col("start1"), F.col("end1"), F.col("start2"), F.col("end2"))
    got = got.where(apart & (near[0] | ((F.col("n") > 2) & near[1])))
    kind = X.half_type(F.col("start1"), F.col("start2"), F.col("forward1"), F.col("forward2"))
    start, inner_start, inner_end, end = X.hull(F.col("start1"), F.col("end1"), F.col("start2"), F.col("end2"))
    return got.select(
        "clone", F.col("chr1").alias("chr"), start.alias("start"), inner_start.alias("inner_start"), inner_end.alias("inner_end"), end.alias("end"),
        kind.alias("svtype"), "anchor_chr", "anchor_start", F.col("anchor_prob").alias("prob"),
    )


def split_evidence(anchors: DataFrame, halves: DataFrame, counts: DataFrame) -> DataFrame:
    """Balanced and unbalanced evidence in the columns of pairs.pair_evidence. counts: (name, mapcount) of anchor reads."""
    two = balanced(anchors, halves).select(F.col("clone").alias("name"), "chr", "start", "inner_start", "inner_end", "end", "svtype", F.lit("split").alias("kind"), F.lit(None).cast("boolean").alias("forward"), "prob")
    one = unbalanced(anchors, halves).select(F.col("clone").alias("name"), "chr", "start", F.lit(None).cast("long").alias("inner_start"), F.lit(None).cast("long").alias("inner_end"), "end", "svtype", F.lit("unbalanced").alias("kind"), "forward", "prob")
    both = two.unionByName(one).join(counts, "name", "left")
    return both.withColumn("mapcount", F.coalesce("mapcount", F.lit(1).cast("long")))


def missing_anchors(reads: DataFrame) -> DataFrame:
    """Mates of split reads whose fragment has no anchor among the filtered rows: a semi-join on (rg, clone, other mate).

    ``reads``: all reads with is_split, is_anchor and kept (whether the filters kept the row).
    """
    kept = reads.where("kept")
    lacking = kept.groupBy("rg", "clone").agg(F.max("is_split").alias("s"), F.max("is_anchor").alias("a")).where("s and not a").select("rg", "clone")
    wanted = kept.where("is_split").join(lacking, ["rg", "clone"], "left_semi").select("rg", "clone", (3 - F.col("num")).alias("num")).distinct()
    return reads.where("not is_split").join(wanted, ["rg", "clone", "num"], "left_semi")
