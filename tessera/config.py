"""Options and constants of the two processing modes."""

from __future__ import annotations

from dataclasses import dataclass

#: A pair reaches a set if its region is at most this many read lengths wide.
PAIR_REACH = 6
#: Sets merge if a region of both is at most this wide.
SET_REACH = 20_000
#: An anchor and a split half belong together within this distance.
ANCHOR_REACH = 1_000_000
#: Halves of one read stand further apart than this.
MIN_HALF_GAP = 5
#: A read with this many split halves or more is repetitive.
MAX_HALVES = 30
#: Values from median + MAD_CUT * MAD on are left out of the statistics; thresholds are mean +- DEVIATIONS * stdev.
MAD_CUT, DEVIATIONS = 20, 3
#: Soft-clipped shares of a read below which it is proper, and above which it is split.
PROPER_CLIP, SPLIT_CLIP = 0.20, 0.30
#: Width of the finest bins of interval joins.
BIN = 16_384


@dataclass(frozen=True)
class PairOptions:
    """Options of pair detection."""

    use_read_groups: bool = False
    read_length: int | None = None
    max_distance: int = 1_000_000
    sample: int = 10_000

    def __post_init__(self) -> None:
        if self.read_length is not None and self.read_length < 50:
            raise ValueError("reads of less than 50 bases can't be split")


@dataclass(frozen=True)
class ClusterOptions:
    """Options of event calling. unify_names: let pairs and splits of one fragment count as one name."""

    chromosome: str | None = None
    min_probability: float = 0.0001
    min_support: float = 1.0
    min_reads: int = 2
    unify_names: bool = False
    emit_all_types: bool = False
