"""Readers and writers of the text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators.splits import as_fastq


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Discordant pairs, plain or gzipped; rows without 14 columns are left out."""
    rows = spark.read.csv(path, sep="\t", schema=schemas.PAIRS, mode="DROPMALFORMED")
    return rows.where("concordant is not null")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schemas.MANIFEST)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """The first three columns of a BED file; track and comment lines are left out."""
    return spark.read.csv(path, sep="\t", schema=schemas.BED, comment="#", mode="PERMISSIVE").where("start is not null and end is not null")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines of SAM text: headers, short lines, rows under eleven fields and unequal sequence and quality are left out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where((F.length("value") >= 10) & ~F.col("value").startswith("@")).select(f.alias("f")).where(F.size("f") >= 11)
    at = lambda i, t: F.get("f", F.lit(i)).try_cast(t)
    kinds = {"name": (0, "string"), "flag": (1, "int"), "chr": (2, "string"), "pos": (3, "long"), "mapq": (4, "int"), "cigar": (5, "string"), "mate_chr": (6, "string"), "mate_pos": (7, "long"), "tlen": (8, "long"), "seq": (9, "string"), "qual": (10, "string")}
    rows = rows.select(*(at(*k).alias(n) for n, k in kinds.items()), F.slice("f", 12, F.size("f")).alias("tags"))
    return rows.where(F.length("seq") == F.length("qual"))


def as_reads(alignments: DataFrame, use_read_groups: bool = True) -> DataFrame:
    """Alignments (SAM or BAM) -> reads as the operators take them: rg, clone, num, chr, pos, orient, xa, ..."""
    from tessera.functions import expr as X

    tag = lambda key: F.regexp_extract(F.coalesce(F.get(F.filter("tags", lambda t: t.startswith(f"{key}:")), F.lit(0)), F.lit("")), rf"^{key}:.:(.*)$", 1)
    rg = F.when(tag("RG") != "", tag("RG")).otherwise("D") if use_read_groups else F.lit("D")
    d = alignments.select("*", rg.alias("rg"), X.clone_name(F.col("name")).alias("clone"), X.mate_number(F.col("name"), F.col("flag")).cast("long").alias("num"), tag("XA").alias("xa"), tag("NM").try_cast("long").alias("edits"))
    return d.withColumns({"orient": F.when(X.has_bits(F.col("flag"), X.REVERSE), "R").otherwise("F"), "len": F.length("seq").cast("long"), "mapq": F.col("mapq").cast("long"), "tlen": F.coalesce("tlen", F.lit(0))})


def write_pairs(pairs: DataFrame, path: str) -> None:
    """One folder a read group, in the layout of schemas.PAIRS; fields that pairs lack are empty."""
    given = set(pairs.columns)
    cols = [F.col(f.name) if f.name in given else F.lit(0 if f.name == "concordant" else None).cast(f.dataType).alias(f.name) for f in schemas.PAIRS]
    pairs.select("rg", *cols).write.mode("overwrite").partitionBy("rg").csv(path, sep="\t")


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select(schemas.MANIFEST.names).write.mode("overwrite").csv(path, sep="\t")


def write_halves(halves: DataFrame, path: str) -> None:
    """FASTQ text; the two halves of a read follow one another."""
    as_fastq(halves).write.mode("overwrite").text(path)


def write_split_reads(rows: DataFrame, path: str) -> None:
    """Parquet, sorted by name within each file."""
    rows.repartition("name").sortWithinPartitions("name").write.mode("overwrite").parquet(path)


def write_calls(calls: DataFrame, path: str) -> None:
    """One folder an event type, ranked by support within each chromosome's file."""
    ranked = calls.withColumn("event", F.lower("svtype")).repartition("event", "chr").sortWithinPartitions("event", "chr", F.desc(F.floor("weighted_support")), "start", "end")
    ranked.select(*schemas.CALLS.names, "event").write.mode("overwrite").partitionBy("event").csv(path, sep="\t")


def write_support(sets: DataFrame, members: DataFrame, taken: DataFrame, path: str) -> None:
    """Calls with the names that support them, joined by semicolons."""
    names = members.join(taken.select("set_id"), "set_id", "left_semi").groupBy("set_id").agg(F.concat_ws(";", F.array_sort(F.collect_set("name"))).alias("names"))
    rows = sets.join(names, "set_id").select("chr", "start", "inner_start", "inner_end", "end", "svtype", "disc_support", "split_support", "unbalanced_support", "names")
    rows.write.mode("overwrite").csv(path, sep="\t")


def support_rows(anchors: DataFrame, split_reads: DataFrame, pairs: DataFrame) -> DataFrame:
    """(kind, rg, clone): all rows that pair detection passes on."""
    of = lambda d, kind: d.select(F.lit(kind).alias("kind"), "rg", "clone")
    return of(anchors, "Anchor").unionByName(of(split_reads, "Split")).unionByName(of(pairs, "Disc"))
