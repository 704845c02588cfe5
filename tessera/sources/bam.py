"""Spark data sources for BAM files: ``bam`` (read and write), ``bam_header`` and ``bam_regions``.

BAM is blocks of at most 64 KB, each a gzip member that tells its own size, and records with
their length in front that run on across blocks. A file is read in splits of ``split`` bytes. A
split begins at the first block in it and, in that, at the first record: the first place from
which on plausible records follow one another. A record belongs to the split in which it begins.
Rows are made in batches, so memory depends neither on the file nor on the split.

``bam_regions`` has a row for each split and sequence: where its records start. Kept as a table
(``write_regions``), it lets the reader leave out splits that hold nothing of a region
(``contained_reads``). The region is an option, not a pushed filter: pushed filters of Python sources
stay with a DataFrame when it is used again without them, which loses rows (Spark 4.1).

A file that is one plain gzip stream is read as one split. Columns are those of schemas.ALIGNMENTS; positions are one-based, tags are TAG:type:value. Paths are
files, or folders of files that end in .bam, on storage that all executors mount.
"""

from __future__ import annotations

import gzip
import json
import os
import re
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessera import schemas

#: Fixed values of the format: bases, operations, sizes and struct codes of tag types.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def _take(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise EOFError("the file ends within a record")
    return data


def header(f) -> tuple[str, list[tuple[str, int]]]:
    """(header text, [(sequence name, length)]); leaves the file at its first record."""
    if _take(f, 4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = _take(f, struct.unpack("<i", _take(f, 4))[0]).rstrip(b"\0").decode()
    sequences = []
    for _ in range(struct.unpack("<i", _take(f, 4))[0]):
        name = _take(f, struct.unpack("<i", _take(f, 4))[0])[:-1].decode()
        sequences.append((name, struct.unpack("<i", _take(f, 4))[0]))
    return text, sequences


def read_groups(text: str) -> list[str]:
    fields = (line.split("\t")[1:] for line in text.splitlines() if line.startswith("@RG"))
    return [x[3:] for row in fields for x in row if x.startswith("ID:")]


def tags(data: bytes) -> list[str]:
    out, at = [], 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in NUMBERS:
            code = "<" + NUMBERS[kind]
            value = struct.unpack_from(code, data, at)[0]
            at += struct.calcsize(code)
            out.append(f"{name}:{'f' if kind == 'f' else 'i'}:{value}")
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{NUMBERS[sub]}", data, at + 5)
            at += 5 + struct.calcsize(f"<{n}{NUMBERS[sub]}")
            out.append(f"{name}:B:{sub}," + ",".join(map(str, values)))
        elif kind == "A":
            out.append(f"{name}:A:{chr(data[at])}")
            at += 1
        else:
            end = data.index(0, at)
            out.append(f"{name}:{kind}:{data[at:end].decode()}")
            at = end + 1
    return out


def record(data: bytes, names: list[str]) -> tuple:
    ref, pos, name_len, mapq, _, n_ops, flag, length, mate_ref, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32 + name_len
    name = data[32 : at - 1].decode()
    cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack_from(f"<{n_ops}I", data, at)) or "*"
    at += 4 * n_ops
    packed = data[at : at + (length + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:length]
    at += len(packed)
    qual = bytes(min(126, q + 33) for q in data[at : at + length]).decode("ascii")
    where = lambda i: names[i] if i >= 0 else "*"
    return name, flag, where(ref), pos + 1, mapq, cigar, where(mate_ref), mate_pos + 1, tlen, seq, qual, tags(data[at + length :])


SPLIT = 64 << 20
#: Records that have to follow one another at the start of a split; so many do where the loaded data end.
CHAIN, FEW = 16, 3
BATCH = 8192
#: Bytes in which the first record of a split is looked for at a time.
LOOK = 1 << 18
#: A record beyond a split's end that may have to be loaded to tell where its own ones begin.
LONGEST = 1 << 24
MAGIC = b"\x1f\x8b\x08\x04"
#: An empty block, as files end.
LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def files_of(path: str) -> list[str]:
    out = []
    for p in path.split(","):
        p = p.removeprefix("file://")
        out += sorted(os.path.join(p, x) for x in os.listdir(p) if x.endswith(".bam")) if os.path.isdir(p) else [p]
    return out


def block_size(head: bytes) -> int | None:
    """The length of the block that begins with these bytes (18 or more); None if none does."""
    if head[:4] != MAGIC or len(head) < 18:
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    return struct.unpack_from("<H", head, 16)[0] + 1 if extra >= 6 and head[12:16] == b"BC\x02\x00" else None


def next_block(f, at: int, size: int) -> int:
    """Where the first block at or after a place begins (the file's size if none does). The block after it has to be one, too."""
    while at < size:
        f.seek(at)
        data = f.read(1 << 17)
        for m in re.finditer(re.escape(MAGIC), data):
            place = at + m.start()
            f.seek(place)
            n = block_size(f.read(18))
            if n:
                f.seek(place + n)
                if place + n == size or block_size(f.read(18)):
                    return place
        at += max(1, len(data) - 3)
    return size


def plausible(data: bytes, at: int, sequences: int) -> int | None:
    """The length, with its four bytes, of what may be a record here; None if it can't be one; 0 if the data end before that is known."""
    if at + 36 > len(data):
        return 0
    n, ref, pos, name, _, _, ops, _, length, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if n < 33 or not -1 <= ref < sequences or not -1 <= mate < sequences or pos < -1 or mate_pos < -1 or not name or length < 0 or 32 + name + 4 * ops + (length + 1) // 2 + length > n:
        return None
    end = at + 36 + name
    return (None if data[end - 1] or 0 in data[at + 36 : end - 1] else n + 4) if end <= len(data) else 0


def first_record(data: bytes, sequences: int, limit: int, whole: bool) -> int | None:
    """The first place before ``limit`` from which on records follow one another: CHAIN of them, FEW up to where the data end, or all to the end of the file (``whole``)."""
    for at in range(limit):
        here, seen = at, 0
        while seen < CHAIN and here < len(data):
            n = plausible(data, here, sequences)
            if not n:
                break
            seen, here = seen + 1, here + n
        else:
            n = 0
        if seen >= CHAIN or seen >= FEW and n == 0 or whole and seen and here == len(data):
            return at
    return None


@dataclass
class Split(InputPartition):
    path: str
    low: int
    high: int


def split_records(split: Split, chr: str | None = None) -> Iterator[tuple[bytes, list[str]]]:
    """(record, names of the sequences) of the records that begin in a split; of one sequence only, where it is named."""
    with gzip.open(split.path) as f:
        names = [n for n, _ in header(f)[1]]
        begin = f.tell()
    wanted = None if chr is None else struct.pack("<i", names.index(chr)) if chr in names else b""
    size = os.path.getsize(split.path)
    with open(split.path, "rb") as f:
        blocked = block_size(f.read(18)) is not None
    if not blocked:  # plain gzip can't be split
        with gzip.open(split.path) as f:
            if split.low == 0:
                header(f)
                while head := f.read(4):
                    data = _take(f, struct.unpack("<i", head)[0])
                    if wanted is None or data[:4] == wanted:
                        yield data, names
        return
    data, own, mine = bytearray(), 0, True  # loaded; how much of it are the split's own blocks; whether the last one was
    with open(split.path, "rb") as f:
        at, stop = next_block(f, split.low, size), next_block(f, split.high, size)

        def load() -> bool:
            nonlocal at, own, mine
            if at >= size:
                return False
            f.seek(at)
            n = block_size(f.read(18))
            if n is None:
                raise ValueError(f"{split.path}: no block at {at}")
            f.seek(at)
            plain = zlib.decompress(f.read(n), 31)
            mine = at < stop
            data.extend(plain)
            own, at = own + (len(plain) if mine else 0), at + n
            return True

        place = begin if split.low == 0 else None
        while place is None and at < size and (at < stop or len(data) < own + LONGEST):
            ready = len(data) + LOOK
            while len(data) < ready and load():
                pass
            place = first_record(bytes(data), len(names), own, at >= size)
        while place is not None and len(data) < place and load():
            pass
        if place is None:
            return
        here = place
        while True:
            while here >= own:
                if not mine or not load():
                    return
            while len(data) - here < 4 or len(data) - here < (n := struct.unpack_from("<i", data, here)[0] + 4):
                if not load():
                    raise EOFError("the file ends within a record")
            if wanted is None or data[here + 4 : here + 8] == wanted:
                yield bytes(data[here + 4 : here + n]), names
            here += n
            if here > LOOK:
                del data[:here]
                own, here = own - here, 0


ARROW = pa.schema([("name", pa.string()), ("flag", pa.int32()), ("chr", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("mate_chr", pa.string()), ("mate_pos", pa.int64()), ("tlen", pa.int64()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.list_(pa.string()))])


def _splits(options: dict) -> list[Split]:
    step = int(options.get("split", SPLIT))
    return [Split(p, at, at + step) for p in files_of(options["path"]) for at in range(0, os.path.getsize(p), step)]


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.chr = options, options.get("chr")

    def partitions(self) -> list[InputPartition]:
        splits = _splits(self.options)
        table, first, last = self.options.get("regions"), int(self.options.get("first", 1)), self.options.get("last")
        if table and self.chr is not None:
            with open(table.removeprefix("file://")) as f:
                rows = [json.loads(line) for line in f]
            have = {(r["path"], r["low"]) for r in rows if r["chr"] == self.chr and r["last"] >= first and (last is None or r["first"] <= int(last))}
            splits = [s for s in splits if (s.path, s.low) in have]
        return splits or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for data, names in split_records(split, self.chr) if split.path else ():
            held.append(record(data, names))
            if len(held) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), ARROW)], schema=ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), ARROW)], schema=ARROW)


CODES = {x: i for i, x in enumerate(BASES)}


def encode_tag(text: str) -> bytes:
    name, kind, value = text.split(":", 2)
    if kind == "i":
        return name.encode() + b"i" + struct.pack("<i", int(value))
    if kind == "f":
        return name.encode() + b"f" + struct.pack("<f", float(value))
    if kind == "B":
        sub, *values = value.split(",")
        return name.encode() + b"B" + sub.encode() + struct.pack(f"<i{len(values)}{NUMBERS[sub]}", len(values), *(float(v) if sub == "f" else int(v) for v in values))
    return name.encode() + kind.encode() + value.encode() + (b"" if kind == "A" else b"\0")


def encode(row, index: dict[str, int]) -> bytes:
    """A row as a record, without its bin (4680, as for places unknown) and without the tag of original qualities."""
    ops = [] if row["cigar"] in (None, "*") else [(int(n) << 4) | OPERATIONS.index(o) for n, o in re.findall(rf"(\d+)([{OPERATIONS}])", row["cigar"])]
    name, seq, qual = row["name"].encode() + b"\0", row["seq"] or "", row["qual"] or ""
    codes = [CODES.get(c, 15) for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    fixed = struct.pack("<iiBBHHHiiii", index.get(row["chr"], -1), row["pos"] - 1, len(name), row["mapq"], 4680, len(ops), row["flag"], len(seq), index.get(row["mate_chr"], -1), row["mate_pos"] - 1, row["tlen"])
    tail = b"".join(encode_tag(t) for t in row["tags"] or () if not t.startswith("OQ:"))
    data = fixed + name + struct.pack(f"<{len(ops)}I", *ops) + packed + bytes(ord(q) - 33 for q in qual) + tail
    return struct.pack("<i", len(data)) + data


def block(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class BamWriter(DataSourceWriter):
    """A file a task, in a hidden folder of the job until that commits. Options: sequences (JSON, [[name, length], ...]), text (of the header)."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].removeprefix("file://"), overwrite
        self.sequences, self.text = json.loads(options.get("sequences", "[]")), options.get("text", "")
        # Made here and not by the tasks, so one that outlives a failed job finds no folder.
        self.hidden = os.path.join(self.path, f"_{uuid.uuid4().hex}")
        os.makedirs(self.hidden)

    def write(self, rows: Iterator) -> Written:
        name = f"part-{uuid.uuid4().hex}.bam"
        done = Written(os.path.join(self.hidden, name), os.path.join(self.path, name))
        index = {n: i for i, (n, _) in enumerate(self.sequences)}
        text = self.text.encode()
        data = bytearray(b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.sequences)))
        for n, length in self.sequences:
            data += struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", length)
        with open(done.temporary, "wb") as f:
            for row in rows:
                data += encode(row, index)
                while len(data) >= 0xFF00:
                    f.write(block(bytes(data[:0xFF00])))
                    del data[:0xFF00]
            f.write(block(bytes(data)) + LAST)
        return done

    def commit(self, messages: list) -> None:
        new = [m for m in messages if m]
        for p in files_of(self.path) if self.overwrite and os.path.isdir(self.path) else []:
            os.remove(p)
        for m in new:
            os.replace(m.temporary, m.final)
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


class BamDataSource(DataSource):
    """Options: path, split (bytes); chr: only this sequence's records; with regions (a file of write_regions), first, last: only splits with records that start there."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self):
        return schemas.ALIGNMENTS

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(dict(self.options), overwrite)


class HeaderReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with gzip.open(partition.value) as f:
            text, sequences = header(f)
        yield from ((partition.value, "sequence", k, n, length) for k, (n, length) in enumerate(sequences))
        yield from ((partition.value, "read_group", k, n, None) for k, n in enumerate(read_groups(text)))


class HeaderDataSource(BamDataSource):
    """(path, kind, place, name, length): the sequences and read groups of the files' headers."""

    @classmethod
    def name(cls) -> str:
        return "bam_header"

    def schema(self):
        return "path string, kind string, place int, name string, length long"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(files_of(self.options["path"]))


class RegionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return _splits(self.options)

    def read(self, split: Split) -> Iterator[tuple]:
        seen: dict[str, list[int]] = {}
        for data, names in split_records(split):
            ref, pos = struct.unpack_from("<ii", data)
            r = seen.setdefault(names[ref] if ref >= 0 else "*", [pos + 1, pos + 1, 0])
            r[:] = min(r[0], pos + 1), max(r[1], pos + 1), r[2] + 1
        yield from ((split.path, split.low, c, *r) for c, r in seen.items())


class RegionDataSource(BamDataSource):
    """(path, low, chr, first, last, records): a row for each split and sequence."""

    @classmethod
    def name(cls) -> str:
        return "bam_regions"

    def schema(self):
        return "path string, low long, chr string, first long, last long, records long"

    def reader(self, schema) -> RegionReader:
        return RegionReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (BamDataSource, HeaderDataSource, RegionDataSource):
        spark.dataSource.register(source)


def write_regions(spark: SparkSession, path: str, table: str, split: int = SPLIT) -> None:
    """Writes the regions of a file's splits as JSON lines: a row a split and sequence, so a few for 64 MB."""
    rows = spark.read.format("bam_regions").option("split", split).load(path)
    with open(table.removeprefix("file://"), "w") as f:
        f.writelines(json.dumps(r.asDict()) + "\n" for r in rows.toLocalIterator())


def contained_reads(spark: SparkSession, path: str, chr: str, start: int = 1, end: int | None = None, regions: str | None = None, split: int = SPLIT) -> DataFrame:
    """Alignments that lie in a region with all their bases, and whose mates start in it; with ``regions``, from its splits only (of the same ``split``)."""
    reader = spark.read.format("bam").option("split", split).option("chr", chr).option("first", start)
    reader = reader if regions is None else reader.option("regions", regions)
    reads = (reader if end is None else reader.option("last", end)).load(path)
    span = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), 1), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    inside = reads.where((F.col("chr") == chr) & (F.col("mate_chr") == chr) & (F.col("pos") >= start) & (F.col("mate_pos") >= start))
    return inside if end is None else inside.where((F.col("pos") + F.greatest(span, F.lit(1)) - 1 <= end) & (F.col("mate_pos") <= end))
