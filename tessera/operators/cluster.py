"""Clustering of evidence into sets, as sweeps along the chromosomes.

A piece of evidence joins the first set that it agrees with, and moves that set's borders, so the
result depends on the order; the order here is that of ``ORDER``. Three sweeps make the sets:

* pairs among themselves (``pair_sets``);
* split reads among themselves, then halves without a partner onto their sets (``split_sets``);
* the sets of one table after another into those that are there (``merge_sets``, ``fold_sets``): of
  every file's pairs first, then of every file's split reads. Sets of one table merge, too.

Rows are dealt out by units that can't meet, sorted, and read as a stream. A sweep holds only sets
that a later row can still reach; others are passed on at once, and memberships as they are made,
each a row. So neither a unit nor a set has to fit into memory. Units are cut by what a sweep's
pieces can reach: pairs meet at their left regions, a read length wide or so, so their units are
short however far the pairs themselves reach.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import PAIR_REACH, SET_REACH
from tessera.functions.expr import type_family
from tessera.operators.intervals import islands
from tessera.session import materialize

FAMILIES = {"DELINV": "DELETION", "INSINV": "INSERTION", "TANDEM": "EVERSION"}
ORDER = ["start", "end", "inner_start", "inner_end", "kind", "name", "svtype", "forward", "mapcount"]
PIECE = ["chr", *ORDER]
#: Sets of one start are of one unit, where their numbers are in the order of making.
SET_ORDER = ["start", "number", "set_id"]
STEP = pa.struct([*((c, pa.int64()) for c in ("start", "inner_start", "inner_end", "end")), ("forward", pa.bool_())])
#: What a set is made of, beside its borders.
SET = ["set_id", "number", "chr", "start", "inner_start", "inner_end", "end", "svtype", "disc_support", "split_support", "unbalanced_support", "steps"]
#: Rows of a sweep: sets, memberships (set_id, name, kind, mapcount), and sets that went into another (null: into none).
ROWS = {
    "tag": pa.string(), "set_id": pa.string(), "number": pa.int64(), "chr": pa.string(), "start": pa.int64(), "inner_start": pa.int64(), "inner_end": pa.int64(), "end": pa.int64(), "svtype": pa.string(),
    "disc_support": pa.int64(), "split_support": pa.int64(), "unbalanced_support": pa.int64(), "steps": pa.list_(STEP), "name": pa.string(), "kind": pa.string(), "mapcount": pa.int64(), "into": pa.string(),
}
SCHEMA = (
    "tag string, set_id string, number long, chr string, start long, inner_start long, inner_end long, end long, svtype string, disc_support long, split_support long, unbalanced_support long,"
    " steps array<struct<start: long, inner_start: long, inner_end: long, end: long, forward: boolean>>, name string, kind string, mapcount long, into string"
)
#: Rows that are passed on together.
BATCH = 4096


class Piece(NamedTuple):
    chr: str
    start: int
    end: int
    inner_start: int | None
    inner_end: int | None
    kind: str
    name: str | None
    svtype: str
    forward: bool | None
    mapcount: int


def _family(svtype: str) -> str:
    return FAMILIES.get(svtype, svtype)


def _width(*coords: int) -> int:
    return max(coords) - min(coords)


@dataclass(slots=True)
class EvidenceSet:
    """Sets' borders are (start, inner_start) on the left and (inner_end, end) on the right.

    ``steps`` is what moving them again takes: the hull of the pieces with a partner, then those
    without one, in order (after merging, several such rows).
    """

    set_id: str
    number: int
    chr: str
    svtype: str
    start: int
    inner_start: int
    inner_end: int
    end: int
    disc: int = 0
    split: int = 0
    unbalanced: int = 0
    steps: list[list] = field(default_factory=list)

    @classmethod
    def of(cls, set_id: str, number: int, e: Piece) -> EvidenceSet:
        new = cls(set_id, number, e.chr, e.svtype, e.start, e.inner_start, e.inner_end, e.end)
        new._count(e)
        return new

    def _count(self, e: Piece) -> None:
        self.disc += e.kind == "disc"
        self.split += e.kind == "split"
        self.unbalanced += e.kind == "unbalanced"
        if e.kind != "unbalanced" and self.steps and self.steps[-1][4] is None:
            last = self.steps[-1]
            last[:4] = min(last[0], e.start), max(last[1], e.inner_start), min(last[2], e.inner_end), max(last[3], e.end)
        else:
            self.steps.append([e.start, e.inner_start, e.inner_end, e.end, e.forward if e.kind == "unbalanced" else None])

    def _widen(self, left: tuple[int, int], right: tuple[int, int]) -> None:
        left, right = (self.start, self.inner_start, *left), (self.inner_end, self.end, *right)
        self.start, self.inner_start = min(left), max(left)
        self.inner_end, self.end = min(right), max(right)

    def _face(self, start: int, end: int, forward: bool) -> None:
        """A piece without a partner moves only the inner border that it faces, and only a deletion's."""
        if self.svtype == "DELETION":
            at_start = abs(start - self.start) < abs(end - self.end)
            if forward and at_start and start < self.inner_end:
                self.inner_start = start
            elif not forward and not at_start and end > self.inner_start:
                self.inner_end = end

    def agrees(self, e: Piece) -> bool:
        """Whether a piece of evidence belongs to the same event."""
        if e.kind == "unbalanced":
            if self.svtype != "DELETION" or not (e.start < self.end and e.end > self.start) or not (self.disc or self.split):
                return False
            reach = PAIR_REACH * (self.inner_start - self.start)
            return min(_width(self.start, self.inner_start, e.start, e.end), _width(self.inner_end, self.end, e.start, e.end)) <= reach
        reach = PAIR_REACH * (e.inner_start - e.start)
        if max(_width(self.start, self.inner_start, e.start, e.inner_start), _width(self.inner_end, self.end, e.inner_end, e.end)) > reach:
            return False
        if _family(self.svtype) != _family(e.svtype):
            return False
        if e.kind == "disc":
            left = self.start <= e.inner_start and self.inner_start >= e.start
            right = self.inner_end <= e.end and self.end >= e.inner_end
            return left and right and e.inner_start < self.inner_start and e.inner_end > self.inner_end
        inside = self.inner_start < e.inner_start < e.inner_end < self.inner_end and self.disc > 0 and not self.split
        around = e.start < self.inner_start and self.inner_end < e.end and self.start < e.inner_start and self.end > e.inner_end and self.split > 0
        return inside or around or (self.inner_start, self.inner_end) == (e.inner_start, e.inner_end)

    def add(self, e: Piece) -> None:
        if e.kind != "unbalanced":
            self._widen((e.start, e.inner_start), (e.inner_end, e.end))
        else:
            self._face(e.start, e.end, e.forward)
        self._count(e)

    def meets(self, other: EvidenceSet) -> bool:
        if not (self.inner_start < other.inner_end and self.inner_end > other.inner_start) or _family(self.svtype) != _family(other.svtype):
            return False
        return max(_width(self.start, self.inner_start, other.start, other.inner_start), _width(self.inner_end, self.end, other.inner_end, other.end)) <= SET_REACH

    def absorb(self, other: EvidenceSet) -> None:
        """Takes another set's borders and then its pieces, in their order."""
        a = sorted((other.start, other.end, other.inner_start, other.inner_end))
        self._widen((a[0], a[1]), (a[2], a[3]))
        for start, inner_start, inner_end, end, forward in other.steps:
            if forward is None:
                self._widen((start, inner_start), (inner_end, end))
            else:
                self._face(start, end, forward)
        self.steps += other.steps
        self.disc, self.split, self.unbalanced = self.disc + other.disc, self.split + other.split, self.unbalanced + other.unbalanced

    def row(self) -> dict:
        borders = {"start": self.start, "inner_start": self.inner_start, "inner_end": self.inner_end, "end": self.end}
        steps = [dict(zip(("start", "inner_start", "inner_end", "end", "forward"), s)) for s in self.steps]
        return {"tag": "set", "set_id": self.set_id, "number": self.number, "chr": self.chr, **borders, "svtype": self.svtype, "disc_support": self.disc, "split_support": self.split, "unbalanced_support": self.unbalanced, "steps": steps}


class Shelf:
    """Live sets by number, found by the bins in which they start and end. ``bits``: of a bin's width; a search should touch few bins."""

    def __init__(self, bits: int = 10) -> None:
        self.bits = bits
        self.sets: dict[int, EvidenceSet] = {}
        self.at: dict[int, tuple[int, int]] = {}
        self.cells: dict[tuple[int, int], set[int]] = {}
        self.left: dict[int, set[int]] = {}
        self.right: dict[int, set[int]] = {}

    def put(self, i: int, s: EvidenceSet) -> None:
        """To be called with a new set, and when a set's borders have moved."""
        now = (s.start >> self.bits, s.end >> self.bits)
        if self.at.get(i) != now:
            self.drop(i)
            self.sets[i], self.at[i] = s, now
            for table, key in ((self.cells, now), (self.left, now[0]), (self.right, now[1])):
                table.setdefault(key, set()).add(i)

    def drop(self, i: int) -> None:
        was = self.at.pop(i, None)
        if was is not None:
            del self.sets[i]
            for table, key in ((self.cells, was), (self.left, was[0]), (self.right, was[1])):
                table[key].discard(i)
                if not table[key]:
                    del table[key]

    def _along(self, table: dict, low: int, high: int) -> set[int]:
        low, high = low >> self.bits, high >> self.bits
        keys = range(low, high + 1) if high - low < len(table) else [k for k in table if low <= k <= high]
        return set().union(*(table.get(k, ()) for k in keys))

    def within(self, left: tuple[int, int], right: tuple[int, int]) -> Iterator[tuple[int, EvidenceSet]]:
        """Sets that start in one range and end in the other (and some beside), each once, in no order."""
        (a, b), (c, d), sets = *[(x >> self.bits, y >> self.bits) for x, y in (left, right)], self.sets
        if (b - a + 1) * (d - c + 1) <= len(self.cells):
            for x in range(a, b + 1):
                for y in range(c, d + 1):
                    for i in self.cells.get((x, y), ()):
                        yield i, sets[i]
        else:
            for i in self._along(self.left, *left):
                if c <= self.at[i][1] <= d:
                    yield i, sets[i]

    def beside(self, left: tuple[int, int], right: tuple[int, int]) -> list[int]:
        """Sets that start in one range or end in the other, in order."""
        return sorted(self._along(self.left, *left) | self._along(self.right, *right))


class Sweep:
    """Clusters one unit's pieces that have a partner. ``out`` takes rows (dicts with keys of ROWS)."""

    def __init__(self, unit: str, out: list[dict]):
        self.unit, self.out, self.shelf = unit, out, Shelf()
        self.made = 0
        #: (inner start, number) of the live sets; inner starts may have grown since.
        self.reach: list[tuple[int, int]] = []

    def feed(self, e: Piece) -> None:
        self.pass_by(e.start)
        self.place(e)

    def end(self) -> None:
        self.pass_by(None)

    def _join(self, shelf: Shelf, i: int, e: Piece) -> None:
        s = shelf.sets[i]
        s.add(e)
        shelf.put(i, s)
        self.out.append({"tag": "member", "set_id": s.set_id, "name": e.name, "kind": e.kind, "mapcount": e.mapcount})

    def place(self, e: Piece) -> int | None:
        """Adds a piece to the first set that agrees, else opens one, whose number is returned.

        A piece that agrees but would turn the set's inner borders round is swallowed.
        """
        inner_start, inner_end = e.inner_start, e.inner_end
        reach = PAIR_REACH * (inner_start - e.start)
        near = self.shelf.within((inner_start - reach, e.start + reach), (e.end - reach, inner_end + reach))
        if e.kind == "disc":  # what ``agrees`` asks of most sets first
            near = (x for x in near if x[1].inner_start > inner_start and x[1].inner_end < inner_end)
        i = min((i for i, s in near if s.agrees(e)), default=None)
        if i is not None:
            if inner_end > self.shelf.sets[i].inner_start:
                self._join(self.shelf, i, e)
            return None
        i, self.made = self.made, self.made + 1
        s = EvidenceSet.of(f"{self.unit}:{e.kind[0]}{i}", i, e)
        self.shelf.put(i, s)
        heapq.heappush(self.reach, (s.inner_start, i))
        self.out.append({"tag": "member", "set_id": s.set_id, "name": e.name, "kind": e.kind, "mapcount": e.mapcount})
        return i

    def pass_by(self, x: int | None) -> None:
        """Sets whose left region lies before x (None: all) are settled: no later piece with a partner can join."""
        while self.reach and (x is None or self.reach[0][0] < x):
            _, i = heapq.heappop(self.reach)
            inner = self.shelf.sets[i].inner_start
            if x is not None and inner >= x:
                heapq.heappush(self.reach, (inner, i))
            else:
                self.settled(i)

    def settled(self, i: int) -> None:
        self.out.append(self.shelf.sets[i].row())
        self.shelf.drop(i)


class SplitSweep(Sweep):
    """Also places pieces without a partner, which open no set.

    One waits until no set that it may belong to can still change by others. Settled deletions are
    kept on a shelf of their own until what comes next lies beyond them.
    """

    def __init__(self, unit: str, out: list[dict]):
        super().__init__(unit, out)
        self.waiting: deque[Piece] = deque()
        self.open: deque[int] = deque()  # in the order of their starts; some are settled
        self.closed: set[int] = set()
        self.deletions = Shelf()
        self.ends: list[tuple[int, int]] = []
        self.widest = 0

    def feed(self, e: Piece) -> None:
        self.pass_by(e.start)
        if e.kind == "unbalanced":
            self.waiting.append(e)
        self.serve(e.start)
        if e.kind != "unbalanced":
            i = self.place(e)
            if i is not None:
                self.open.append(i)

    def end(self) -> None:
        self.pass_by(None)
        self.serve(None)

    def settled(self, i: int) -> None:
        self.closed.add(i)
        s = self.shelf.sets[i]
        if s.svtype != "DELETION":
            return super().settled(i)
        self.shelf.drop(i)
        self.deletions.put(i, s)
        self.widest = max(self.widest, s.inner_start - s.start)
        heapq.heappush(self.ends, (s.end, i))

    def serve(self, x: int | None) -> None:
        """Places the waiting pieces that may be, and passes on deletions that end before whatever may come."""
        while self.open and self.open[0] in self.closed:
            self.closed.discard(self.open.popleft())
        free = None if not self.open else self.shelf.sets[self.open[0]].start
        while self.waiting and (x is None or self.waiting[0].end <= x) and (free is None or self.waiting[0].end <= free):
            e = self.waiting.popleft()
            reach = PAIR_REACH * self.widest
            for i in self.deletions.beside((e.end - reach, e.end), (e.start, e.start + reach)):
                s = self.deletions.sets[i]
                if s.agrees(e):
                    self._join(self.deletions, i, e)
                    self.widest = max(self.widest, s.inner_start - s.start)
                    break
        bound = self.waiting[0].start if self.waiting else x
        while self.ends and (bound is None or self.ends[0][0] <= bound):
            i = heapq.heappop(self.ends)[1]
            self.out.append(self.deletions.sets[i].row())
            self.deletions.drop(i)


class Fold:
    """Merges sets of a table (``later``) into the first set that they meet, of those that were there; one that meets none is there for the next ones."""

    LATER = 1 << 60

    def __init__(self, out: list[dict]):
        self.out, self.shelf = out, Shelf(SET_REACH.bit_length())
        self.queue: deque[EvidenceSet] = deque()
        self.starts: list[tuple[int, int]] = []
        self.made = 0

    def feed(self, later: bool, s: EvidenceSet) -> None:
        self.pass_by(s.start)
        if later:
            self.queue.append(s)
        else:
            self._keep(self.made, s)

    def _keep(self, i: int, s: EvidenceSet) -> None:
        self.made += 1
        self.shelf.put(i, s)
        heapq.heappush(self.starts, (s.start, i))

    def end(self) -> None:
        self.pass_by(None)

    def pass_by(self, x: int | None) -> None:
        """A set is merged once all that it may meet have come, and is done once all that may meet it have."""
        while self.queue and (x is None or self.queue[0].start + SET_REACH < x):
            self.fold(self.queue.popleft())
        bound = self.queue[0].start if self.queue else x
        while self.starts and (bound is None or self.starts[0][0] + SET_REACH < bound):
            i = heapq.heappop(self.starts)[1]
            self.out.append(self.shelf.sets[i].row())
            self.shelf.drop(i)

    def fold(self, other: EvidenceSet) -> None:
        left, right = sorted((other.start, other.inner_start)), sorted((other.inner_end, other.end))
        near = self.shelf.within((left[1] - SET_REACH, left[0] + SET_REACH), (right[1] - SET_REACH, right[0] + SET_REACH))
        i = min((i for i, s in near if s.meets(other)), default=None)
        if i is not None:
            s = self.shelf.sets[i]
            joins = other.inner_end > s.inner_start
            if joins:
                s.absorb(other)
                self.shelf.put(i, s)
            self.out.append({"tag": "fold", "set_id": other.set_id, "into": s.set_id if joins else None})
            return
        self._keep(self.LATER + self.made, other)


def sweep(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[tuple, list[dict]], object], feed: Callable[[object, tuple], None]) -> DataFrame:
    """Deals rows out by ``keys``, sorts them by ``order``, and sends each key's through a sweep of its own.

    ``start`` makes a key's sweep, ``feed`` gives it a row (the values of ``columns``).
    """
    both = list(dict.fromkeys([*keys, *columns, *order]))
    dealt = rows.select(both).repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], t) for c, t in ROWS.items()], list(ROWS))
            out.clear()
            return made

        group, current = None, None
        for b in batches:
            own = zip(*(b.column(both.index(k)).to_pylist() for k in keys))
            for now, row in zip(own, zip(*(b.column(both.index(c)).to_pylist() for c in columns))):
                if now != group:
                    if current is not None:
                        current.end()
                    group, current = now, start(now, out)
                feed(current, row)
                if len(out) >= BATCH:
                    yield batch()
        if current is not None:
            current.end()
        yield batch()

    return dealt.mapInArrow(run, SCHEMA)


class SetTables(NamedTuple):
    """Sets (columns of SET, family, raw_reads) and their members (set_id, name, kind, mapcount), a row each."""

    sets: DataFrame
    members: DataFrame


def _tables(rows: DataFrame) -> SetTables:
    total = F.col("disc_support") + F.col("split_support") + F.col("unbalanced_support")
    sets = rows.where("tag = 'set'").select(*SET, type_family(F.col("svtype")).alias("family"), total.alias("raw_reads"))
    return SetTables(sets, rows.where("tag = 'member'").select("set_id", "name", "kind", "mapcount"))


def _clustered(evidence: DataFrame, reach: Column, kind: type[Sweep], prefix: str) -> SetTables:
    family = F.when(F.col("kind") == "unbalanced", "DELETION").otherwise(type_family(F.col("svtype")))
    keys = ["chr", "family", "unit"]
    placed = islands(evidence.select(*PIECE, family.alias("family")).withColumn("reach", reach), keys[:2], "start", "reach").withColumnRenamed("island", "unit")
    rows = sweep(placed, keys, ORDER, PIECE, lambda key, out: kind(prefix + ":".join(map(str, key)), out), lambda s, row: s.feed(Piece(*row)))
    return _tables(materialize(rows))


def pair_sets(evidence: DataFrame, prefix: str = "") -> SetTables:
    """Sets of the pairs (kind ``disc``). A set_id is made of ``prefix`` (which tells files apart), chromosome, family, the unit's start and a number."""
    return _clustered(evidence.where("kind = 'disc'"), F.col("inner_start"), Sweep, prefix)


def split_sets(evidence: DataFrame, prefix: str = "") -> SetTables:
    """Sets of split reads, with the halves without a partner that belong to them; those that belong to none are left out.

    Halves without a partner can only join deletions, anywhere along them, so these are cut where none reaches across.
    """
    whole = (type_family(F.col("svtype")) == "DELETION") | (F.col("kind") == "unbalanced")
    return _clustered(evidence.where("kind in ('split', 'unbalanced')"), F.when(whole, F.col("end")).otherwise(F.col("inner_start")), SplitSweep, prefix)


def merge_sets(first: SetTables | None, second: SetTables) -> SetTables:
    """The second table's sets, in order of position, merged into the first's (None: an empty one) and into one another; members follow their sets.

    Sets merge if their inner regions overlap and their left and right ones lie within SET_REACH.
    A set that meets one but would turn its borders round is swallowed, with its members. All
    set_ids have to differ.
    """
    later = second.sets.withColumn("later", F.lit(True))
    both = later if first is None else first.sets.withColumn("later", F.lit(False)).unionByName(later)
    # Units: chains of sets of the second table that start within reach, with those of the first near them.
    far = F.when(F.col("later"), SET_REACH).otherwise(0)
    keys = ["chr", "family", "unit"]
    placed = islands(both.withColumns({"low": F.col("start") - far, "high": F.col("start") + far}), keys[:2], "low", "high").withColumnRenamed("island", "unit")
    columns = ["later", *SET]

    def feed(fold: Fold, row: tuple) -> None:
        r = dict(zip(columns, row))
        steps = [[*x.values()] for x in r["steps"]]
        fold.feed(r["later"], EvidenceSet(r["set_id"], r["number"], r["chr"], r["svtype"], r["start"], r["inner_start"], r["inner_end"], r["end"], r["disc_support"], r["split_support"], r["unbalanced_support"], steps))

    rows = materialize(sweep(placed, keys, SET_ORDER, columns, lambda key, out: Fold(out), feed))
    went = rows.where("tag = 'fold'").select("set_id", "into", F.lit(True).alias("went"))
    moved = second.members.join(went, "set_id", "left").where("went is null or into is not null").select(F.coalesce("into", "set_id").alias("set_id"), "name", "kind", "mapcount")
    return SetTables(_tables(rows).sets, moved if first is None else first.members.unionByName(moved))


def fold_sets(tables: list[SetTables]) -> SetTables:
    """The tables in order, each merged into what those before it gave."""
    return reduce(merge_sets, tables, None)


def evidence_sets(*files: DataFrame) -> SetTables:
    """Evidence (see pairs.pair_evidence, splits.split_evidence) of one or several files -> sets and members.

    Each file's pairs and split reads make sets of their own, which are folded in order: pairs of
    all files, then splits of all files.
    """
    names = [f"{k}:" if len(files) > 1 else "" for k in range(len(files))]
    return fold_sets([make(e, k) for make in (pair_sets, split_sets) for e, k in zip(files, names)])


def set_members(tables: SetTables, unify_names: bool = False) -> DataFrame:
    """(set_id, name, mapcount), distinct. Pairs' and splits' names of one fragment differ unless unified."""
    name = F.col("name") if unify_names else F.concat(F.when(F.col("kind") == "disc", "p:").otherwise("s:"), "name")
    return tables.members.select("set_id", name.alias("name"), "mapcount").groupBy("set_id", "name").agg(F.max("mapcount").alias("mapcount"))
