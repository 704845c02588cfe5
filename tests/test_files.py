"""Text formats, BAM and the driver contract."""

import gzip
import struct
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from tessera import schemas
from tessera.sources import bam, files


def test_pairs_round_trip(spark, tmp_path):
    rows = [("g", "c1", "chr1", 1, 2, "F", "chr1", 5, 6, "R", "deletion", 0.9)]
    d = spark.createDataFrame(rows, "rg string, name string, chr1 string, start1 long, end1 long, orient1 string, chr2 string, start2 long, end2 long, orient2 string, svtype string, prob double")
    files.write_pairs(d, str(tmp_path / "p"))
    got = files.read_pairs(spark, str(tmp_path / "p")).first()
    assert (got.name, got.start2, got.svtype, got.prob, got.concordant, got.edits) == ("c1", 5, "deletion", 0.9, 0, None)
    (tmp_path / "z.tsv.gz").write_bytes(gzip.compress(b"a\tb\n" + b"\t".join([b"n", b"c", b"1", b"2", b"F", b"c", b"3", b"4", b"R", b"deletion", b"0", b"1", b"0.5", b"0"]) + b"\n"))
    assert [r.name for r in files.read_pairs(spark, str(tmp_path / "z.tsv.gz")).collect()] == ["n"]


def test_manifest_bed_and_calls(spark, tmp_path):
    m = spark.createDataFrame([("s", "p", "a", 400.5, 30.0)], schemas.MANIFEST)
    files.write_manifest(m, str(tmp_path / "m"))
    assert files.read_manifest(spark, str(tmp_path / "m")).first() == m.first()
    (tmp_path / "g.bed").write_text("track x\n#c\nchr1\t5\t9\textra\n")
    assert [tuple(r) for r in files.read_bed(spark, str(tmp_path / "g.bed")).collect()] == [("chr1", 5, 9)]
    calls = spark.createDataFrame([("chr1", 1, 2, 3, 4, "DELETION", 1, 0, 0, s) for s in (1.0, 3.5)], schemas.CALLS)
    files.write_calls(calls, str(tmp_path / "c"))
    text = "".join(p.read_text() for p in Path(tmp_path / "c" / "event=deletion").glob("*.csv"))
    assert [line.split("\t")[-1] for line in text.splitlines()] == ["3.5", "1.0"]


def test_sam_text(spark, tmp_path):
    good = "q/1\t99\tchr1\t7\t60\t4M\t=\t9\t2\tACGT\tIIII\tNM:i:1\tXA:Z:chr2,+5,4M,0;\tRG:Z:g1"
    (tmp_path / "a.sam").write_text(f"@HD\n{good}\nshort\na\tb\tc\td\te\tf\tg\nq\t0\tchr1\t1\t1\t4M\t=\t1\t1\tACGT\tIII\n")
    d = files.read_sam(spark, str(tmp_path / "a.sam"))
    r = files.as_reads(d).first()
    assert d.count() == 1 and (r.clone, r.num, r.rg, r.xa, r.orient, r.len) == ("q", 1, "g1", "chr2,+5,4M,0;", "F", 4)


def make_bam(path, reads):
    text = b"@HD\tVN:1.6\n@RG\tID:g1\n"
    out = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    for name, flag, pos, ops, seq, qual, tags in reads:
        codes = [bam.BASES.index(b) for b in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
        raw = struct.pack("<iiBBHHHiiii", 0, pos - 1, len(name) + 1, 60, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        raw += b"".join(struct.pack("<I", n << 4 | bam.OPERATIONS.index(o)) for n, o in ops) + packed + bytes(ord(q) - 33 for q in qual) + tags
        out += struct.pack("<i", len(raw)) + raw
    half = len(out) // 2
    path.write_bytes(gzip.compress(out[:half]) + gzip.compress(out[half:]))


def test_bam_source(spark, tmp_path):
    make_bam(tmp_path / "a.bam", [("r1", 65, 11, [(3, "S"), (2, "M")], "ACGTN", "IIII!", b"NMC\x02RGZg1\0"), ("r2", 129, 20, [], "AC", "II", b"XBBs\x01\0\0\0\x05\0ZAAq")])
    with gzip.open(tmp_path / "a.bam") as f:
        text, sequences = bam.header(f)
    assert bam.read_groups(text) == ["g1"] and sequences == [("chr1", 1000)]
    bam.register(spark)
    got = spark.read.format("bam").load(str(tmp_path / "a.bam")).orderBy("name").collect()
    assert (got[0].chr, got[0].pos, got[0].cigar, got[0].seq, got[0].qual, got[0].tags) == ("chr1", 11, "3S2M", "ACGTN", "IIII!", ["NM:i:2", "RG:Z:g1"])
    assert got[1].cigar == "*" and got[1].mate_chr == "*" and got[1].tags == ["XB:B:s,5", "ZA:A:q"]


def test_support_and_split_sinks(spark, tmp_path):
    sets = spark.createDataFrame([("s", "c", 1, 2, 3, 4, "DELETION", 1, 0, 0), ("t", "c", 1, 2, 3, 4, "DELETION", 1, 0, 0)], "set_id string, chr string, start long, inner_start long, inner_end long, end long, svtype string, disc_support long, split_support long, unbalanced_support long")
    members = spark.createDataFrame([("s", "b"), ("s", "a"), ("s", "b"), ("t", "c")], "set_id string, name string")
    files.write_support(sets, members, sets.where("set_id = 's'").select("set_id"), str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).first().value.endswith("\ta;b")
    files.write_split_reads(spark.createDataFrame([("b",), ("a",)], "name string"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    rows = spark.createDataFrame([("g", "c")], "rg string, clone string")
    assert {r.kind for r in files.support_rows(rows, rows, rows).collect()} == {"Anchor", "Split", "Disc"}


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    got = e.entry(spark)
    assert got.columns == ["set_id", "chr", "start", "inner_start", "inner_end", "end", "svtype", "disc_support", "split_support", "unbalanced_support", "weighted_support"]
    assert got.count() > 0
    r = e.queries()["sv_class"](spark, "/root/testdata/sf0.001")
    assert r.agg(F.sum("n")).first()[0] > 0


def test_entry_without_the_llm_folder(tmp_path):
    root = Path(__file__).parent.parent
    for p in root.rglob("*.py"):
        rel = p.relative_to(root)
        if "llm" in rel.parts or rel.name == "corpus_pipeline.py" or rel.parts[0] == "tests":
            continue
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(p.read_bytes())
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'calls' in e.queries(), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, timeout=100)
    assert out.stdout.split()[1:] == ["True", "False"], out.stderr
