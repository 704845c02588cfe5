"""Column layouts of the text formats that are read and written."""

from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (field.split() for field in text.split(", "))])


#: A discordant pair, tab-separated, no header.
PAIRS = _struct("name string, chr1 string, start1 long, end1 long, orient1 string, chr2 string, start2 long, end2 long, orient2 string, svtype string, edits double, quality double, prob double, concordant int")
#: A library of one read group: where its tables are, and its insert size.
MANIFEST = _struct("splits string, pairs string, anchors string, insert_mean double, insert_stdev double")
BED = _struct("chr string, start long, end long")
#: The columns of the calls tables.
CALLS = _struct("chr string, start long, inner_start long, inner_end long, end long, svtype string, disc_support long, split_support long, unbalanced_support long, weighted_support double")
ALIGNMENTS = _struct("name string, flag int, chr string, pos long, mapq int, cigar string, mate_chr string, mate_pos long, tlen long, seq string, qual string, tags array<string>")
