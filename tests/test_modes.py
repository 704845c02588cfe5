"""Alignments to calls, through files."""

import json

from pyspark.sql import functions as F

from tessera import schemas
from tessera.config import ClusterOptions, PairOptions
from tessera.plans import modes
from tessera.sources import bam, files


def alignments():
    """Two libraries of proper pairs; ten of each lie across a deletion of 4 kb; one clone has a clipped read and an anchor; one group has no pair."""
    rows = []

    def pair(rg, name, left, right):
        for num, pos, flag, size in ((1, left, 0x1 | 0x2 | 0x40, right - left + 100), (2, right, 0x1 | 0x2 | 0x80 | 0x10, left - right - 100)):
            rows.append((name, flag, "chr1", pos, 60, "100M", "chr1", right if num == 1 else left, size, "A" * 100, "I" * 100, [f"RG:Z:{rg}"]))

    for rg in ("g1", "g2"):
        for i in range(150):
            pair(rg, f"{rg}n{i}", 1000 + 37 * i, 1300 + 37 * i + i % 9)
        for i in range(10):
            pair(rg, f"{rg}d{i}", 20_000 - 10 * i, 24_300 + 10 * i)
    rows.append(("split", 0x1 | 0x4 | 0x40, "chr1", 20_100, 0, "*", "chr1", 20_100, 0, "C" * 100, "I" * 100, ["RG:Z:g1"]))
    rows.append(("split", 0x1 | 0x8 | 0x80, "chr1", 20_100, 60, "100M", "chr1", 20_100, 0, "G" * 100, "I" * 100, ["RG:Z:g1"]))
    rows.append(("lone", 0x1 | 0x8, "chr1", 500, 60, "100M", "*", 0, 0, "G" * 100, "I" * 100, ["RG:Z:g9"]))
    return rows


def test_alignments_to_calls(spark, tmp_path):
    bam.register(spark)
    at = str(tmp_path / "in")
    spark.createDataFrame(alignments(), schemas.ALIGNMENTS).coalesce(1).write.format("bam").option("sequences", json.dumps([["chr1", 100_000]])).option("text", "@RG\tID:g1\n@RG\tID:g2\n").mode("append").save(at)
    reads = files.as_reads(spark.read.format("bam").option("split", 5_000).load(at))
    out = str(tmp_path / "out")
    counts = modes.preprocess(reads, out, PairOptions(use_read_groups=True, max_distance=50_000))
    assert counts["reads"] == 643 and counts["reads_without_limits"] == 1 and counts["pairs"] == 21  # the split clone's two rows are one, too
    assert (counts["split_reads"], counts["halves_ok"], counts["anchors"]) == (1, 1, 1)
    assert spark.read.text(f"{out}/halves").count() == 8
    assert spark.read.parquet(f"{out}/limits").count() == 2
    spark.createDataFrame([("split", "chr1", 20_050, 20_100, True, True), ("split", "chr1", 24_310, 24_360, False, False)], modes.HALVES).write.parquet(f"{out}/aligned/rg=g1")
    got = modes.call(spark, f"{out}/manifest", str(tmp_path / "called"), ClusterOptions(min_reads=2)).collect()
    assert len(got) == 1 and got[0].svtype == "DELETION"
    assert 19_000 < got[0].start < got[0].inner_start < 20_200 and 24_200 < got[0].inner_end < got[0].end < 24_600
    assert got[0].disc_support == 20 and got[0].split_support == 1
    written = spark.read.csv(str(tmp_path / "called" / "calls"), sep="\t", schema=schemas.CALLS)
    assert written.count() == 1
    names = spark.read.text(str(tmp_path / "called" / "support")).first().value.split("\t")[-1].split(";")
    assert len(names) == 21 and "split" in names
    gaps = str(tmp_path / "gaps.bed")
    with open(gaps, "w") as f:
        f.write("chr1\t20150\t20300\n")
    assert modes.call(spark, f"{out}/manifest", str(tmp_path / "none"), ClusterOptions(min_reads=2), gaps).count() == 0
    assert reads.agg(F.count_distinct("rg")).first()[0] == 3
