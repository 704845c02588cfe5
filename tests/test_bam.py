"""BAM files: splits, regions, headers and the sink."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.sources import bam

SEQUENCES = [["chr1", 100_000], ["chr2", 50_000]]
TEXT = "@HD\tVN:1.6\n@RG\tID:g1\tSM:s\n@RG\tID:g2\n"


def alignments(n=4000, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        length = rng.choice([50, 100, 101, 9000 if i % 500 == 0 else 75])
        c, m = ("chr1", "chr1") if i < n * 0.7 else ("chr2", rng.choice(["chr2", "*"]))
        seq, qual = "".join(rng.choice("ACGTN") for _ in range(length)), "".join(chr(33 + rng.randrange(60)) for _ in range(length))
        tags = [f"RG:Z:g{1 + i % 2}", f"NM:i:{i % 5}", "ZB:B:S,1,2"] + ["XS:f:0.5"] * (i % 3 == 0)
        out.append((f"r{i}", rng.choice([99, 147, 0]), c, 1 + i * 10, rng.randrange(60), f"{length}M", m, 1 + i * 10 if m != "*" else 0, rng.randrange(-500, 500), seq, qual, tags))
    return out


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    bam.register(spark)
    path = str(tmp_path_factory.mktemp("bam") / "out")
    rows = alignments()
    spark.createDataFrame(rows, schemas.ALIGNMENTS).coalesce(1).write.format("bam").option("sequences", json.dumps(SEQUENCES)).option("text", TEXT).mode("append").save(path)
    return path, sorted(rows)


def test_written_files_are_read_back_in_any_number_of_splits(spark, written):
    path, rows = written
    for split in (1 << 30, 200_000, 70_000, 9_000):
        d = spark.read.format("bam").option("split", split).load(path)
        assert sorted(tuple(r) for r in d.collect()) == rows
    assert spark.read.format("bam").option("split", 9_000).load(path).rdd.getNumPartitions() > 20


def test_splits_begin_at_every_place(written):
    """Wherever a file is cut in two, each record comes once."""
    path, rows = written
    file = glob.glob(f"{path}/*.bam")[0]
    rng = random.Random(3)
    for at in (1, 17, 18, 65_279, 65_280, *(rng.randrange(500_000) for _ in range(6))):
        got = [bam.record(data, names) for s in (bam.Split(file, 0, at), bam.Split(file, at, 1 << 40)) for data, names in bam.split_records(s)]
        assert sorted(got) == rows


def test_a_sequence_is_read_from_its_splits_only(spark, written, tmp_path):
    path, rows = written
    table = str(tmp_path / "regions.json")
    bam.write_regions(spark, path, table, split=20_000)
    load = lambda **o: spark.read.format("bam").options(split=20_000, regions=table, **o).load(path)
    some = load(chr="chr2")
    assert sorted(tuple(r) for r in some.collect()) == [r for r in rows if r[2] == "chr2"]
    assert 1 < some.rdd.getNumPartitions() < 0.5 * load().rdd.getNumPartitions()
    assert load(chr="none").count() == 0 and load().where("chr = 'chr2'").count() == some.count()
    inside = bam.contained_reads(spark, path, "chr1", 5_000, 10_000, table, 20_000)
    assert sorted(tuple(r) for r in inside.collect()) == [r for r in rows if r[2] == r[6] == "chr1" and r[3] >= 5_000 and r[3] + len(r[9]) - 1 <= 10_000]
    assert inside.rdd.getNumPartitions() < 0.5 * some.rdd.getNumPartitions() + 3


def test_header_tables(spark, written):
    path, _ = written
    got = {(r.kind, r.place, r.name, r.length) for r in spark.read.format("bam_header").load(path).collect()}
    assert got == {("sequence", 0, "chr1", 100_000), ("sequence", 1, "chr2", 50_000), ("read_group", 0, "g1", None), ("read_group", 1, "g2", None)}


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    bam.register(spark)
    bad = spark.createDataFrame([*alignments(50), ("x", 0, "chr1", 1, 0, "1M", "chr1", 1, 0, "A", "I", ["broken"])], schemas.ALIGNMENTS)
    with pytest.raises(Exception):
        bad.repartition(3).write.format("bam").option("sequences", json.dumps(SEQUENCES)).mode("append").save(str(tmp_path / "out"))
    assert not glob.glob(str(tmp_path / "out" / "*"))


def test_original_qualities_are_left_out(spark, tmp_path):
    bam.register(spark)
    row = alignments(1)[0]
    spark.createDataFrame([(*row[:-1], ["OQ:Z:II", "NM:i:1"])], schemas.ALIGNMENTS).write.format("bam").option("sequences", json.dumps(SEQUENCES)).mode("append").save(str(tmp_path / "o"))
    assert spark.read.format("bam").load(str(tmp_path / "o")).select(F.array_join("tags", ",")).first()[0] == "NM:i:1"
