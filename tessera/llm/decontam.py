"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items and documents are normalised to lower-cased words. The automaton runs over word
numbers and holds anchors: of an item of ``window`` words or more, every ``STEP``-th run of
``ANCHOR`` words, of a shorter one all its words. Any ``window`` words of an item hold an anchor
whole, so each place where a document can match is found in one scan; the match is then
extended word by word both ways and counts if it is as long as a window. Of an anchor that stands at more than
``BUSY`` places (the start of a template) the windows that hold it are keys instead, each with its
items: such a match needs no extension, and a text lists a key's items once. Matches are mapped to
word numbers and, on demand, to character offsets of the original text.

The automaton takes about 15 bytes for each byte of the benchmark. What a task holds is bounded:
a benchmark of more than ``BLOCK_BYTES`` is dealt into blocks by the hash of its items, and each
block is built, sent and scanned for by itself, the documents being scanned once for each block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import alnum_words, load_documents, table
from tessera.session import materialize

WINDOW = 10
ANCHOR = 5
#: Places of an anchor up to which matches are extended from it.
BUSY = 16
#: Bytes of benchmark text for one automaton.
BLOCK_BYTES = 16 << 20
#: The words as they stand in the original text.
ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Benchmark:
    """The items' words as numbers in one row, zeros between items, and the automaton of their anchors.

    items: (id or None, text). An item without id can hit words but is no item of a result.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        row, starts = [0], []
        places: dict[tuple, list[int]] = {}  # anchors: places in the row
        whole: dict[tuple, list[int]] = {}  # windows and short items: the items that have them
        anchor = min(ANCHOR, window)
        step = window - anchor + 1
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in alnum_words(text)]
            if not words:
                continue
            at = len(row)
            starts.append(at)
            self.ids.append(item)
            row += [*words, 0]
            if len(words) < window:
                whole.setdefault(tuple(words), []).append(len(starts) - 1)
            for i in range(0, len(words) - anchor + 1 if len(words) >= window else 0, step):
                places.setdefault(tuple(words[i : i + anchor]), []).append(at + i)
        self.row = np.array(row, np.int32)
        self.starts = np.array(starts, np.int64)
        self.ends = np.append(self.starts[1:], len(row)) - 1 if starts else np.zeros(0, np.int64)
        for key in [k for k, at in places.items() if len(at) > BUSY]:
            at = np.array(places.pop(key))
            for p, item in zip(at.tolist(), (np.searchsorted(self.starts, at, "right") - 1).tolist()):
                for i in range(max(starts[item], p - step + 1), min(p, int(self.ends[item]) - window) + 1):
                    having = whole.setdefault(tuple(row[i : i + window]), [])
                    if not having or having[-1] != item:
                        having.append(item)
        keys = list(dict.fromkeys([*places, *whole]))
        self.sizes = [len(k) for k in keys]
        self.places, self.cuts = _joined(places, keys)
        self.having, self.having_cuts = _joined(whole, keys)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, key in enumerate(keys):
            self.automaton.add_word(key, k)
        if keys:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[int]]:
        """(number of words, flags of the words hit, ids of the items that occur)."""
        words = alnum_words(text)
        if not words or not len(self.starts):
            return len(words), np.zeros(0, bool), set()
        get = self.number.get
        # A word that no item has stands for itself only: the number after the last.
        none = len(self.number) + 1
        numbers = tuple([get(w, none) for w in words])
        doc, steps, items = None, None, set()
        done: dict[int, int] = {}  # diagonal -> where its last match ends, so that a long match is extended once
        seen: set[int] = set()  # keys whose items are listed already
        for end, k in self.automaton.iter(numbers):
            if doc is None:
                doc = np.array([-1, *numbers, -1], np.int32)  # words stand one place later
                steps = np.zeros(len(words) + 1, np.int64)
            at = end + 2 - self.sizes[k]
            if self.having_cuts[k] < self.having_cuts[k + 1]:
                steps[at - 1] += 1
                steps[end + 1] -= 1
                if k not in seen:
                    seen.add(k)
                    items.update(self.having[self.having_cuts[k] : self.having_cuts[k + 1]].tolist())
            for place in self.places[self.cuts[k] : self.cuts[k + 1]].tolist():
                if done.get(place - at, -1) > at:
                    continue
                a, z = self._extend(doc, at, place, self.sizes[k])
                done[place - at] = z
                if z - a >= self.window:
                    steps[a - 1] += 1
                    steps[z - 1] -= 1
                    items.add(int(np.searchsorted(self.starts, place, "right")) - 1)
        if steps is None:
            return len(words), np.zeros(0, bool), set()
        return len(words), np.cumsum(steps)[:-1] > 0, {self.ids[i] for i in items} - {None}

    def _extend(self, doc: np.ndarray, at: int, place: int, size: int) -> tuple[int, int]:
        """The match doc[a:z] that holds doc[at : at + size] = row[place : ...]; the zeros between items and the ends of doc match nothing."""
        a, z = at, at + size
        shift = place - at
        while doc[a - 1] == self.row[a - 1 + shift]:
            a -= 1
        while doc[z] == self.row[z + shift]:
            z += 1
        return a, z


def _joined(lists: dict[tuple, list[int]], keys: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The lists of the keys in one array, and where each begins and ends."""
    cuts = np.cumsum([0, *(len(lists.get(k, ())) for k in keys)])
    return np.fromiter((x for k in keys for x in lists.get(k, ())), np.int64, int(cuts[-1])), cuts


def built(held: dict, window: int) -> Benchmark:
    """The automaton of a broadcast {"items": ...}, built once in a worker process: tasks that share it share the dict, too."""
    if "made" not in held:
        held["made"] = Benchmark(held.pop("items"), window)
    return held["made"]


def hit_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges [start, end) of the original text that the hit words cover."""
    spans: list[tuple[int, int]] = []
    before = -2
    for k, m in enumerate(ORIGINAL_WORD.finditer(text)):
        if k < len(hit) and hit[k]:
            spans.append((spans.pop()[0] if before == k - 1 else m.start(), m.end()))
            before = k
    return spans


def ranges(hit: np.ndarray) -> list[dict]:
    """The words hit as ranges [start, end) of word numbers."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": a, "end": z} for a, z in zip(edge[::2].tolist(), edge[1::2].tolist())]


def flags(spans: list[dict], size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    for s in spans:
        out[s["start"] : s["end"]] = True
    return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's items in blocks of about ``block_bytes``, one at a time; an item is never divided, equal ones come once.

    The driver holds one block. Its size is counted first; a benchmark of one block is one list.
    """
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // block_bytes)
    if count > 1:
        items = materialize(items)
    for k in range(count):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).toLocalIterator()]


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
SPANS_SQL = "array<struct<start: int, end: int>>"


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (text, ...) and, added: __n (words), __hit (ranges of words), __items (sorted ids as strings). One scan for each block."""
    spark = docs.sparkSession
    names = docs.columns
    found = None
    for block in blocks(benchmark, block_bytes):
        sent = spark.sparkContext.broadcast({"items": block})
        first = found is None

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first: bool = first) -> Iterator[pa.RecordBatch]:
            items = built(sent.value, window)
            for b in batches:
                count, hit, ids = [], [], []
                for k, t in enumerate(b.column("text")):
                    n, h, i = items.scan(t.as_py())
                    if not first:
                        h = flags(b.column("__hit")[k].as_py(), n) | (h if len(h) else False)
                        i = set(b.column("__items")[k].as_py()) | set(map(str, i))
                    count.append(n), hit.append(ranges(h)), ids.append(sorted(map(str, i)))
                added = [pa.array(count, pa.int64()), pa.array(hit, SPANS), pa.array(ids, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *added], [*names, "__n", "__hit", "__items"])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"__n long, __hit {SPANS_SQL}, __items array<string>"])
        # Further blocks go on from a written table, so that only one automaton is held at a time.
        found = (docs if first else materialize(found)).mapInArrow(run, schema)
    if found is not None:
        return found

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            added = [pa.array([len(alnum_words(t.as_py())) for t in b.column("text")], pa.int64()), pa.array([[]] * b.num_rows, SPANS), pa.array([[]] * b.num_rows, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *added], [*names, "__n", "__hit", "__items"])

    return docs.mapInArrow(count, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"__n long, __hit {SPANS_SQL}, __items array<string>"]))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text, ...) and (item_id, text) -> a row for each document.

    Columns: doc_id, n_words, n_hit, items (sorted ids as strings), spans (character ranges
    of the original text). Null, empty and wordless texts have no words and no hits; items
    without words match nothing, those without id hit words but are not listed; repeated items
    count once; an empty benchmark hits nothing; extra columns are ignored.
    """
    found = hits(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, window, block_bytes)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, hit = [], []
            for t, n, h in zip(b.column("text"), b.column("__n").to_pylist(), b.column("__hit").to_pylist()):
                hit.append(sum(s["end"] - s["start"] for s in h))
                out.append([{"start": a, "end": z} for a, z in hit_spans(t.as_py(), flags(h, n))] if h else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__n"), pa.array(hit, pa.int64()), b.column("__items"), pa.array(out, SPANS)], ["doc_id", "n_words", "n_hit", "items", "spans"])

    return found.mapInArrow(spans, f"doc_id long, n_words long, n_hit long, items array<string>, spans {SPANS_SQL}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` (text, ...), all columns, that no window occurs in."""
    return hits(docs, benchmark, window, block_bytes).where("size(__hit) = 0").select(*docs.columns)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    found = hits(load_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("__hit", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", F.col("__n").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def digest(items: list[int]) -> str:
    """What items_sha256 holds for a list of items."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


QUERIES = {"op9_decontamination": op9_decontamination}
ORACLES: dict[str, str] = {}
