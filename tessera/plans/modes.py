"""The two modes end to end: alignments to tables and a manifest; a manifest to calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schemas
from tessera.config import ClusterOptions, PairOptions
from tessera.functions import expr as X
from tessera.operators import cluster, cover, splits, stats
from tessera.plans import events
from tessera.sources import files
from tessera.session import materialize

#: Halves of split reads, aligned again: what an aligner makes of the FASTQ that ``preprocess`` writes.
HALVES = T.StructType([T.StructField(n, k) for n, k in (("clone", T.StringType()), ("chr", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("forward", T.BooleanType()), ("is_first", T.BooleanType()))])


def preprocess(reads: DataFrame, out: str, options: PairOptions) -> dict[str, int]:
    """Reads (see files.as_reads) -> folders under ``out``: pairs, halves (FASTQ), anchors, limits and manifest; returns the run's counters.

    Counters are observed by the jobs that write: reads of groups without limits (which are left
    out), split reads by what became of their halves, anchors and pairs. Aligned halves are
    expected at ``aligned/rg=...``, as the manifest tells.
    """
    r = reads if options.use_read_groups else reads.withColumn("rg", F.lit("D"))
    seen = {k: Observation(k) for k in ("groups", "halves", "anchors", "pairs")}
    found = events.detect(r, options, seen["groups"])
    limits = found["limits"]
    length = options.read_length
    if length is None:
        modes = stats.read_length_mode(r).collect()  # a row at most
        length = modes[0].len if modes else 100
    halves = splits.halve(found["splits"], int(length) // 2)
    states = [F.count_if(F.col("status") == s).alias(f"halves_{s}") for s in ("ok", "trimmed", "short", "error")]
    files.write_halves(halves.observe(seen["halves"], F.count("*").alias("split_reads"), *states), f"{out}/halves")
    anchors = found["anchors"].select("rg", "clone", "chr", F.col("pos").alias("start"), (F.col("orient") == "F").alias("forward"), X.map_probability(F.col("mapq")).alias("prob"))
    anchors.observe(seen["anchors"], F.count("*").alias("anchors")).write.mode("overwrite").partitionBy("rg").parquet(f"{out}/anchors")
    files.write_pairs(found["pairs"].observe(seen["pairs"], F.count("*").alias("pairs")), f"{out}/pairs")
    limits.write.mode("overwrite").parquet(f"{out}/limits")
    at = lambda kind: F.concat(F.lit(f"{out}/{kind}/rg="), "rg")
    manifest = limits.select(at("aligned").alias("splits"), at("pairs").alias("pairs"), at("anchors").alias("anchors"), F.col("mean").alias("insert_mean"), F.col("stdev").alias("insert_stdev"))
    files.write_manifest(manifest.coalesce(1), f"{out}/manifest")
    states = {0: "whole", 1: "without_first", 2: "without_second", 3: "without_both"}
    return {k: v for o in seen.values() for k, v in o.get.items()} | {f"fragments_{states[x.state]}": x.n for x in found["states"].collect()}


def _there(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def call(spark: SparkSession, manifest: str, out: str, options: ClusterOptions, gaps: str | None = None) -> DataFrame:
    """A manifest's libraries -> calls, written by event type under ``out`` (calls, support) and returned.

    Each library's evidence makes sets of its own, which are folded in the manifest's order.
    Folders that the manifest names but that are not there hold no rows.
    """
    excluded = None if gaps is None else files.read_bed(spark, gaps)
    none = lambda schema: spark.createDataFrame([], schema)
    evidence = []
    for row in files.read_manifest(spark, manifest).collect():  # a row a library
        pairs = files.read_pairs(spark, row.pairs) if _there(spark, row.pairs) else none(schemas.PAIRS)
        anchors = spark.read.parquet(row.anchors) if _there(spark, row.anchors) else none("clone string, chr string, start long, forward boolean, prob double")
        halves = spark.read.schema(HALVES).parquet(row.splits) if _there(spark, row.splits) else none(HALVES)
        evidence.append(materialize(events.evidence(pairs, anchors, halves, excluded, options)))
    made = cluster.evidence_sets(*evidence)
    taken = materialize(cover.greedy_cover(made.sets, cluster.set_members(made, options.unify_names), options.min_support, options.min_reads))
    calls = materialize(cover.calls(made.sets, taken, options.emit_all_types))
    files.write_calls(calls, f"{out}/calls")
    files.write_support(made.sets, made.members, taken, f"{out}/support")
    return cover.ranked(calls)
