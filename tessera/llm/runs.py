"""Periodic runs of words, by longest common extensions in suffix trees.

A run is a longest stretch with a smallest period. Its candidates are Lyndon roots: for either
order of the words, the longest Lyndon word from each place on, which ends where the next smaller
suffix begins; every run of two periods or more has such a word as its root (Bannai et al., "The
runs theorem", 2017). Each root is extended in both directions by the longest common extension of
its two ends, which is the depth of the lowest common ancestor of two leaves: in the suffix tree
of the stretch to the right, in the tree of its reversal to the left. Both trees are built online
(Ukkonen 1995) and asked by range minima over their Euler tours.

Trees are not built where no run can be: from the second period on, each few words of a run of
period q came q words before at the latest (see ``stretches``), which leaves little of prose and
loses no run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import load_documents

#: A run has so many periods and so many words at least.
PERIODS, WORDS = 4, 6
#: Times that stretches are cut; what is left goes to the trees.
CUTS = 24


def suffix_tree(s: list[int]) -> tuple[list[int], list[int], list[dict | None]]:
    """Edges' starts and lengths and the children (by first symbol) of each node; node 0 is the root, leaves have no children.

    The last symbol of ``s`` has to occur once. One symbol is added at a time, with suffix links.
    """
    n = len(s)
    start, end, link, kids = [0], [0], [0], [{}]
    node = edge = length = pending = 0
    for i, c in enumerate(s):
        last = 0
        pending += 1
        while pending:
            if not length:
                edge = i
            own = kids[node]
            child = own.get(s[edge])
            if child is None:
                own[s[edge]] = len(start)
                start.append(i), end.append(n), link.append(0), kids.append(None)
                if last:
                    link[last] = node
                    last = 0
            else:
                at = start[child]
                span = end[child] - at
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if s[at + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                split = len(start)
                own[s[edge]] = split
                start.append(at), end.append(at + length), link.append(0), kids.append({s[at + length]: child, c: split + 1})
                start[child] = at + length
                start.append(i), end.append(n), link.append(0), kids.append(None)
                if last:
                    link[last] = split
                last = split
            pending -= 1
            if not node and length:
                length -= 1
                edge = i - pending + 1
            else:
                node = link[node]
    return start, [e - b for b, e in zip(start, end)], kids


class Extensions:
    """Longest common extensions of the suffixes of a row of symbols, all above 0; 0 is put at its end."""

    def __init__(self, s: list[int]):
        n = len(s) + 1
        _, spans, self.kids = suffix_tree([*s, 0])
        kids = self.kids
        tour: list[int] = []
        place = [0] * n
        depth = [0] * len(spans)
        leaves: list[int] = []
        stack = [0]
        pop, push, visit = stack.pop, stack.append, tour.append
        while stack:
            v = pop()
            if v < 0:  # back in a node after one of its children
                visit(depth[~v])
                continue
            own, d = kids[v], depth[v]
            if own is None:
                place[n - d] = len(tour)
                leaves.append(n - d)
                visit(d)
                continue
            visit(d)
            back = None
            for symbol in sorted(own, reverse=True):
                if back is not None:
                    push(back)
                back = ~v
                child = own[symbol]
                depth[child] = d + spans[child]
                push(child)
        self.tour, self.place, self.leaves, self.depth, self.n = np.array(tour, np.int32), np.array(place, np.int64), leaves, depth, n

    def reversed_leaves(self) -> list[int]:
        """Suffixes in order if the order of the symbols is turned round; the end stays smallest."""
        out, stack, n = [], [0], self.n
        while stack:
            v = stack.pop()
            own = self.kids[v]
            if own is None:
                out.append(n - self.depth[v])
                continue
            stack += [own[x] for x in sorted(own) if x]
            if 0 in own:
                stack.append(own[0])
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes from a and from b have in common; a and b differ.

        The depth of a lowest common ancestor: the least depth on the tour between the two leaves,
        from two overlapping windows of a power of two. One power's windows are held at a time.
        """
        lo, hi = np.minimum(self.place[a], self.place[b]), np.maximum(self.place[a], self.place[b])
        power = np.log2(hi - lo + 1).astype(np.int64)
        out = np.zeros(len(lo), np.int64)
        level, width = self.tour, 1
        for k in range(int(power.max(initial=-1)) + 1):
            mine = np.flatnonzero(power == k)
            out[mine] = np.minimum(level[lo[mine]], level[hi[mine] - width + 1])
            level = np.minimum(level[:-width], level[width:])
            width *= 2
        return out


def lyndon_ends(leaves: list[int]) -> np.ndarray:
    """For each place but the end's, where the longest Lyndon word from there on ends: at the next smaller suffix."""
    n = len(leaves)
    rank = [0] * n
    for r, i in enumerate(leaves):
        rank[i] = r
    ends, stack = [n - 1] * (n - 1), []
    for i in range(n):
        while stack and rank[stack[-1]] > rank[i]:
            ends[stack.pop()] = i
        stack.append(i)
    return np.array(ends, np.int64)


def tree_runs(s: list[int], periods: int = PERIODS, words: int = WORDS) -> np.ndarray:
    """Rows (start, length, period), sorted, of the runs of a row of symbols above 0; periods: 2 or more."""
    n = len(s)
    if n < 2:
        return np.empty((0, 3), np.int64)
    right, left = Extensions(s), Extensions(s[::-1])
    found = []
    for leaves in (right.leaves, right.reversed_leaves()):
        ends = lyndon_ends(leaves)
        at = np.arange(n)
        at, end = at[ends < n], ends[ends < n]
        after = right.common(at, end)
        before = np.zeros(len(at), np.int64)
        inner = np.flatnonzero(at > 0)
        before[inner] = left.common(n - at[inner], n - end[inner])
        found.append(np.stack([at - before, end + after - at + before, end - at], 1))
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[rows[:, 1] >= np.maximum(words, periods * rows[:, 2])]


def stretches(ids: np.ndarray, periods: int = PERIODS, words: int = WORDS) -> list[tuple[int, int]]:
    """Where the rows of k words, k half of ``words``, that begin after the first period of a run may begin.

    From its second period on, each k words of a run of period q came q words before at the
    latest. So the run has m such places in a row, m + k - 1 being (periods - 1) q or more, none of
    whose rows came longer before than that. Longest stretches of which this holds are returned.
    Words and rows are told by hashes: two that meet only make a stretch longer than it need be.
    """
    k = (words + 1) // 2
    n = len(ids) - k + 1
    key = np.zeros(n, np.uint64)
    for j in range(k):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n].view(np.uint64)
    order = np.argsort(key, kind="stable")
    gap = np.full(n, len(ids) * periods)
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    gap[order[again + 1]] = order[again + 1] - order[again]
    good = gap * periods <= len(ids)
    least = min(max(words, periods * q) - q for q in range(1, words + 1)) - k + 1
    for _ in range(CUTS):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], good.view(np.int8), [0]])))
        size = edges[1::2] - edges[::2]
        inside, here = np.flatnonzero(good), np.repeat(size, size)
        keep = (gap[inside] * (periods - 1) <= here + k - 1) & (here >= least)
        if keep.all():
            break
        good[inside[~keep]] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[0], good.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def word_runs(words: list, periods: int = PERIODS, least: int = WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a row of words, by start and period. periods: 2 or more."""
    if len(words) < least:
        return []
    out, more = [], (least + 1) // 2 - 1
    for lo, hi in stretches(np.fromiter(map(hash, words), np.int64, len(words)), periods, least):
        begin = max(0, lo - (hi - lo + more) // (periods - 1))
        number: dict = {}
        part = [number.setdefault(w, len(number) + 1) for w in words[begin : hi + more]]
        for start, length, period in tree_runs(part, periods, least).tolist():
            # Others belong to the stretch before, and may be cut here.
            if begin + start + period >= lo:
                out.append((begin + start, length, period))
    return sorted(out)


def without_repeats(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, periods: int = PERIODS, words: int = WORDS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, runs: array of (start, length, period), collapsed: the text without the repeated periods.

    Words are what stands between space and U+0009 to U+000D; runs are by start and period. Null
    and empty texts have no words and an empty collapsed text. Every row is judged by itself, so
    repeated and null ids are no special case; an empty table gives an empty table; extra columns
    are ignored. A text is held in one task; the trees take some 600 bytes a word of the stretches
    in which runs may be, beside the words themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, runs, kept = [], [], []
            for text in b.column(1):
                row = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                found = word_runs(row, periods, words)
                n.append(len(row))
                runs.append([{"start": x, "length": y, "period": z} for x, y, z in found])
                kept.append(b" ".join(without_repeats(row, found)))
            out = [b.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


#: White space between words, as a pattern for split.
SPACES = r"[ \t-\r]+"


def plant(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by crc32 of the id, the words from a place on repeat with a period. Rows without an id stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    d = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).cast("long").alias("g"))
    d = d.select("*", F.expr("if(size(w) > 0, g % size(w), 0)").alias("a"))
    d = d.select("*", F.expr("1 + (size(w) - a) div (3 + g % 8)").alias("p"))
    planted = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, get(w, cast(a + (i - a) % p as int)))), ' ')")
    return d.select("doc_id", F.when(F.expr("size(w) > 0"), planted).otherwise(F.col("text")).alias("text"))


def strongest(runs: str) -> Column:
    """The run with most periods, exactly; the first of equal ones (null without any)."""
    more = "aggregate(slice({0}, 2, greatest(size({0}) - 1, 0)), get({0}, 0), (b, r) -> if(r.length * b.period > b.length * r.period, r, b))"
    return F.expr(more.format(runs))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    d = periodic_runs(plant(load_documents(spark, sf_dir)))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"], F.lit("\n")))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest("runs").alias("best"), digest(listed).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLES: dict[str, str] = {}
