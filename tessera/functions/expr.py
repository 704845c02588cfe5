"""Column functions on alignments, pairs and intervals; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import ANCHOR_REACH, MIN_HALF_GAP, PROPER_CLIP, SPLIT_CLIP

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, FIRST, SECOND, SECONDARY = 0x1, 0x2, 0x4, 0x8, 0x10, 0x40, 0x80, 0x100
#: Evidence types by the name of a pair's class; anything else is MAXDIST.
TYPES = {"insertion": "INSERTION", "deletion": "DELETION", "insinv": "INSINV", "delinv": "DELINV", "eversion": "EVERSION", "inversion": "INVERSION", "transchr": "TRANSCHR"}


def has_bits(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) == bits


def clone_name(name: Column) -> Column:
    """The fragment's name: without a mate suffix _1, _2, /1 or /2."""
    return F.regexp_replace(name, "(.)[_/][12]$", "$1")


def mate_number(name: Column, flag: Column) -> Column:
    """1 or 2, by the flags or else by the suffix; 0 if neither tells."""
    suffix = F.regexp_extract(name, "[_/]([12])$", 1)
    return F.when(has_bits(flag, FIRST), 1).when(has_bits(flag, SECOND), 2).when(suffix != "", suffix.cast("int")).otherwise(0)


def soft_clip(cigar: Column) -> Column:
    """Bases clipped at either end, from a CIGAR string."""
    parts = F.regexp_extract_all(cigar, F.lit("([0-9]+)S"), F.lit(1))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x.cast("int"))


def map_probability(mapq: Column) -> Column:
    return 1 - F.pow(F.lit(10.0), -mapq / 10)


def mean_quality(qual: Column) -> Column:
    """Mean Phred+33 quality; null for an empty string."""
    codes = F.transform(F.split(qual, ""), lambda c: F.ascii(c))
    return F.when(F.length(qual) > 0, F.aggregate(codes, F.lit(0), lambda a, x: a + x) / F.length(qual) - 33)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def is_placed_unless_both_lost(flag: Column) -> Column:
    return ~has_bits(flag, UNMAPPED | MATE_UNMAPPED)


def is_proper(flag: Column, insert: Column, clip: Column, length: Column, lower: Column, upper: Column) -> Column:
    """Paired as expected: within the thresholds, little clipped, and flagged so."""
    return has_bits(flag, PAIRED) & (F.abs(insert) > lower) & (F.abs(insert) < upper) & (clip < length * PROPER_CLIP) & has_bits(flag, PROPER)


def is_split(flag: Column, clip: Column, length: Column) -> Column:
    lost = has_bits(flag, UNMAPPED) & ~has_bits(flag, MATE_UNMAPPED)
    return (lost | (clip > length * SPLIT_CLIP)) & ~has_bits(flag, SECONDARY)


def is_anchor(flag: Column, chrom: Column, clip: Column, length: Column) -> Column:
    return ~has_bits(flag, UNMAPPED) & has_bits(flag, MATE_UNMAPPED) & (chrom != "*") & ~(clip > length * SPLIT_CLIP)


def is_everted(orient1: Column, orient2: Column, start1: Column, start2: Column) -> Column:
    outward = (orient1 == "R") & (orient2 == "F")
    mirrored = (orient1 == "F") & (orient2 == "R")
    return F.when(start1 < start2, outward).otherwise(mirrored)


def pair_class(chr1, start1, end1, orient1, chr2, start2, end2, orient2, lower, upper, max_distance) -> Column:
    """What a pair says about its fragment, by its span against the library's thresholds."""
    span = F.greatest(start1, end1, start2, end2) - F.least(start1, end1, start2, end2) + 1
    everted, alike = is_everted(orient1, orient2, start1, start2), orient1 == orient2
    near = F.when(everted, "eversion").when(~alike, "insertion").otherwise("insinv")
    # Everted reads differ in orientation, so a wide everted pair with equal ones can't occur.
    far = F.when(~everted, "deletion").otherwise("eversion")
    expected = F.when(alike, "inversion").when(everted, "eversion").otherwise("concordant")
    return F.when(chr1 != chr2, "transchr").when(span > max_distance, "maxdist").when(span < lower, near).when(span > upper, far).otherwise(expected)


def evidence_type(name: Column) -> Column:
    named = F.lit("MAXDIST")
    for k, v in TYPES.items():
        named = F.when(name == k, v).otherwise(named)
    return named


def type_family(svtype: Column) -> Column:
    """Types that support one another have one family."""
    return F.when(svtype == "DELINV", "DELETION").when(svtype == "INSINV", "INSERTION").when(svtype == "TANDEM", "EVERSION").otherwise(svtype)


def half_type(start1: Column, start2: Column, forward1: Column, forward2: Column) -> Column:
    """The evidence type of a read's first and second half, by the strands of the left and the right one.

    Halves on one strand are an inversion if they face against their order, else (and where
    both start at one place) an inverted deletion.
    """
    swapped = start1 > start2
    left, right = F.when(swapped, forward2).otherwise(forward1), F.when(swapped, forward1).otherwise(forward2)
    facing = F.when(~left & right, "EVERSION").when(left & ~right, "DELETION").when(left == swapped, "INVERSION").otherwise("DELINV")
    return F.when(start1 == start2, "DELINV").otherwise(facing)


def hull(*coords: Column) -> tuple[Column, Column, Column, Column]:
    """The four coordinates in order: start, inner start, inner end, end."""
    ordered = F.array_sort(F.array(*coords))
    return tuple(ordered.getItem(i) for i in range(4))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names for helper columns, with underscores put before them until no column has one of them."""
    taken = {c.lower() for c in columns}
    while taken & {n.lower() for n in names}:
        names = tuple(f"_{n}" for n in names)
    return list(names)


def overlaps(start_a, end_a, start_b, end_b) -> Column:
    return (start_a < end_b) & (end_a > start_b)


def shared_share(start_a, end_a, start_b, end_b) -> Column:
    """The part that two intervals share, as a share of the longer one; 0 if they don't overlap."""
    common = F.least(end_a, end_b) - F.greatest(start_a, start_b)
    longer = F.greatest(end_a - start_a, end_b - start_b)
    return F.when(common > 0, common / longer).otherwise(0.0)


def closest_ends(start1, end1, start2, end2) -> Column:
    return F.least(F.abs(start1 - end2), F.abs(start2 - end1))


def halves_apart(start1, end1, start2, end2) -> Column:
    return closest_ends(start1, end1, start2, end2) > MIN_HALF_GAP


def anchored(anchor_chr, anchor_start, chrom, start) -> Column:
    return (anchor_chr == chrom) & (F.abs(start - anchor_start) < ANCHOR_REACH)
