"""Line dedup: winnowed line fingerprints, matches extended by window hashes, later repeated runs deleted.

A line here is ``LINE`` words in a row, and every word starts one: lines as they are written end
anywhere, so a passage inside of them would have no line of its own. Line hashes are winnowed:
the smallest of every window of ``min_words`` - 2 words is a fingerprint, so texts that have such
a window in common share one. A fingerprint's row also carries hashes of the windows around it,
every third word; fingerprints of one text only are dropped, and windows of the others are
compared for equality with the earliest text that has them, so every earlier text counts and
no two texts are compared as a pair. Covered words are deleted; the first occurrence stays.

So a run of ``min_words`` or more that an earlier text has is always found, nothing shorter than
``min_words`` - 2 goes, and at most two words stay behind at each end of a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.text import LOWER, load_documents
from tessera.session import materialize

MIN_WORDS = 50
LINE, STEP = 8, 3
#: Parts that the rows of one fingerprint are dealt to, a power of two.
SALTS = 64
COUNTS = ("line_words", "line_removed", "line_runs")
#: Bytes of text that are hashed at once: each takes some 50 bytes of arrays meanwhile.
CHUNK = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ODD = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_PLACE = np.uint64((1 << 24) - 1)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, as long as was needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), CHUNK + 4096)
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _UNBASE)]))
        return self.up[:n], self.down[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Spans:
    """Hashes of spans of a row of numbers, the same wherever the span stands."""

    def __init__(self, values: np.ndarray, powers: _Powers):
        up, self.down = powers.to(len(values))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up)])

    def hash(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        return _mix((self.total[after] - self.total[first]) * self.down[first])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` values in a row, by doubling."""
    low, have = values, 1
    while 2 * have <= width:
        low, have = np.minimum(low[:-have], low[have:]), 2 * have
    rest = width - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


class Words:
    """The words of some texts, hashed, and where each text's words and bytes begin."""

    def __init__(self, texts: list[bytes], powers: _Powers):
        joined = b"\n".join(texts)
        self.origin = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t) + 1 for t in texts])])
        data = np.frombuffer(joined.translate(LOWER), np.uint8)
        blank = np.concatenate([[True], _BLANK[data], [True]])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        self.byte_at = edges[::2]
        self.doc_at = np.searchsorted(self.byte_at, self.origin)
        hashes = _Spans(_ODD[data], powers).hash(self.byte_at, edges[1::2]) if len(edges) else np.zeros(0, np.uint64)
        self.spans = _Spans(hashes, powers)

    def windows(self, at: np.ndarray, words: int) -> np.ndarray:
        return self.spans.hash(at, at + words)

    def winnowed(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, hash, first, last) of each fingerprint: of the windows that begin at first to last its line is the smallest."""
        n = len(self.byte_at)
        counts = np.maximum(0, np.diff(self.doc_at) - window + 1)
        if not counts.sum():
            return (*[np.zeros(0, np.int64)] * 2, np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
        line = self.windows(np.arange(n - LINE + 1), LINE)
        low = _sliding_min((line & ~_PLACE) | (np.arange(len(line)).astype(np.uint64) & _PLACE), window - LINE + 1)
        doc = np.repeat(np.arange(len(counts)), counts)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + self.doc_at[:-1][doc]
        place = start + ((low[start] - start.astype(np.uint64)) & _PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
        last = np.concatenate([new[1:] - 1, [len(place) - 1]])
        return doc[new], place[new], line[place[new]], start[new], start[last]

    def repeated(self, k: int, window: int) -> np.ndarray:
        """Where in text k a window begins that stands earlier in it, and ends before this one begins."""
        lo, hi = int(self.doc_at[k]), int(self.doc_at[k + 1])
        h = self.windows(np.arange(lo, hi - window + 1), window)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        return lo + np.flatnonzero(first[which] + window <= np.arange(len(h)))


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts as UTF-8) in chunks of about CHUNK bytes; null is empty."""
    first, group, size = 0, [], 0
    for k, t in enumerate(texts):
        s = t.as_py()
        group.append(s.encode("utf-8", "surrogatepass") if s else b"")
        size += len(group[-1])
        if size >= CHUNK:
            yield first, group
            first, group, size = k + 1, [], 0
    if group:
        yield first, group


def fingerprints(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text) -> (fp, doc_id, at, back, h): fingerprints, and 32 bits of the hashes of windows around them.

    at: the fingerprint's word; the windows begin back words before it and then every STEP words.
    Two neighbouring hashes stand for one window of min_words - 2 words: the window without its
    last and without its first STEP words. Equal rows of one text are given once.
    """
    window = min_words - STEP + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            ids = b.column(0).to_numpy()
            for base, texts in _chunks(b.column(1)):
                words = Words(texts, powers)
                doc, place, fp, first, last = words.winnowed(window)
                end = np.minimum(np.minimum(last + STEP - 1, place), words.doc_at[doc + 1] - window)
                far, near = (place - first) // STEP, -((end - place) // STEP)
                some = far >= near
                doc, place, fp, far, near = doc[some], place[some], fp[some], far[some], near[some]
                sizes = far - near + 2
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                at = np.arange(cuts[-1]) - np.repeat(cuts[:-1], sizes)
                h = (words.windows(np.repeat(place - STEP * far, sizes) + STEP * at, window - STEP) >> np.uint64(32)).astype(np.uint32)
                # Equal rows of a text: by their fingerprint and all its hashes.
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(h.astype(np.uint64) + at.astype(np.uint64) * _BASE))])
                same = np.stack([doc, fp.view(np.int64), (total[cuts[1:]] - total[cuts[:-1]]).view(np.int64)], 1)
                order = np.lexsort((place, same[:, 2], same[:, 1], same[:, 0]))
                again = np.zeros(len(order), bool)
                again[order[1:]] = (same[order][1:] == same[order][:-1]).all(1)
                rows = pa.RecordBatch.from_arrays(
                    [pa.array(fp.view(np.int64)), pa.array(ids[base + doc]), pa.array((place - words.doc_at[doc]).astype(np.int32)), pa.array((STEP * far).astype(np.int32)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(h.view(np.int32)))],
                    ["fp", "doc_id", "at", "back", "h"],
                )
                yield rows.filter(pa.array(~again))

    return docs.select("doc_id", "text").mapInArrow(run, "fp long, doc_id long, at int, back int, h array<int>")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text) -> (doc_id, starts): for each document the words at which windows begin that a document of smaller id has too.

    The rows of a fingerprint are dealt to SALTS parts and counted there first; only counts meet.
    """
    found = fingerprints(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text"), min_words)
    dealt = found.withColumn("salt", F.hash("doc_id").bitwiseAND(SALTS - 1)).repartition("fp", "salt")
    # With used, both readers of the exchange need the same columns, so it is made once.
    shared = dealt.groupBy("fp").agg(F.count("*").alias("n"), F.expr("bit_or(shiftleft(1L, salt))").alias("salts"), F.max(F.size("h") + F.col("at") + F.col("back")).alias("used"))
    shared = shared.where("n > 1 and used >= 0").select("fp", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> getbit(salts, s) = 1)")).alias("salt"))
    kept = dealt.join(shared.hint("shuffle_hash"), ["fp", "salt"]).select("fp", "doc_id", "at", "back", "h")
    each = materialize(kept.mapInArrow(_single, "key long, doc_id long, start int"))
    first = each.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("final")).where("first < final").select("key", "first")
    return each.join(first.hint("shuffle_hash"), "key").where("doc_id > first").groupBy("doc_id").agg(F.collect_list("start").alias("starts"))


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``fingerprints`` -> (key, doc_id, start): a row for each window, known by its fingerprint, its place to it and its two hashes."""
    for b in batches:
        fp, doc, at, back, h = b.columns
        cuts, h = h.offsets.to_numpy().astype(np.int64), h.values.to_numpy().view(np.uint32).astype(np.uint64)
        sizes = np.diff(cuts) - 1
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        one = cuts[:-1][row] + place
        off = back.to_numpy()[row] - STEP * place
        key = _mix(_mix(fp.to_numpy().view(np.uint64)[row] + _mix((h[one] << np.uint64(32)) | h[one + 1])) + off.astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc.to_numpy()[row]), pa.array((at.to_numpy()[row] - off).astype(np.int32))], ["key", "doc_id", "start"])


def removed(words: Words, starts: list, window: int) -> list[tuple[int, int, int, int]]:
    """(text, first byte, byte after, words) of each run of covered words. starts: for each text, of its repeated windows, or None."""
    mark = np.zeros(len(words.byte_at) + len(starts) + 1, np.int64)
    doc, _, fp, _, _ = words.winnowed(window)
    order = np.lexsort((fp, doc))
    twice = set(doc[order[1:][(fp[order][1:] == fp[order][:-1]) & (doc[order][1:] == doc[order][:-1])]].tolist())
    for k, given in enumerate(starts):
        if not given and k not in twice:
            continue
        at = [np.asarray(given, np.int64) + words.doc_at[k]] if given else []
        if k in twice:
            at.append(words.repeated(k, window))
        begun = np.unique(np.concatenate(at))
        # A word's place in mark is its number and, so that texts stay apart, its text's.
        np.add.at(mark, begun + k, 1)
        np.add.at(mark, begun + k + window, -1)
    flags = np.concatenate([[0], (np.cumsum(mark) > 0).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(flags))
    out = []
    place = words.doc_at[:-1] + np.arange(len(starts))
    for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()):
        k = int(np.searchsorted(place, a, "right")) - 1
        a, z = a - k, z - k
        end = int(words.byte_at[z]) if z < words.doc_at[k + 1] else int(words.origin[k + 1]) - 1
        out.append((k, int(words.byte_at[a] - words.origin[k]), end - int(words.origin[k]), z - a))
    return out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents (doc_id, text, ...) -> the same rows and columns without later repeated runs, and three counts.

    Added: line_words (words of the text), line_removed (words deleted), line_runs (runs deleted).
    Runs are found across documents (the one with the smallest doc_id keeps its own) and within
    a document. Null texts stay null; empty texts have no lines. Rows that share a doc_id
    count as one document: neither loses what the other has. Rows without doc_id are only
    compared with themselves. Columns named like the counts are replaced; others are kept.
    """
    docs = docs.drop(*COUNTS)
    names, text_at = docs.columns, docs.columns.index("text")
    found = repeats(docs, min_words).select(F.col("doc_id").alias("__of"), F.col("starts").alias("__starts"))
    joined = docs.join(found, docs["doc_id"].cast("long") == found["__of"], "left").select(*[docs[n] for n in names], found["__starts"])
    schema = StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in COUNTS)])
    window = min_words - STEP + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            texts, words_of, gone, cuts = [], [], [], []
            starts = b.column(len(names))
            for base, group in _chunks(b.column(text_at)):
                words = Words(group, powers)
                runs: dict[int, list] = {}
                for k, a, z, n in removed(words, [starts[base + k].as_py() for k in range(len(group))], window):
                    runs.setdefault(k, []).append((a, z, n))
                for k, raw in enumerate(group):
                    at, kept = 0, []
                    for a, z, _ in runs.get(k, ()):
                        kept.append(raw[at:a])
                        at = z
                    kept.append(raw[at:])
                    texts.append(b"".join(kept).decode("utf-8", "surrogatepass"))
                    words_of.append(int(words.doc_at[k + 1] - words.doc_at[k]))
                    gone.append(sum(r[2] for r in runs.get(k, ())))
                    cuts.append(len(runs.get(k, ())))
            out = [b.column(i) for i in range(len(names))]
            was = b.column(text_at)
            out[text_at] = pa.array([t if was[i].is_valid else None for i, t in enumerate(texts)], was.type)
            yield pa.RecordBatch.from_arrays([*out, *(pa.array(x, pa.int64()) for x in (words_of, gone, cuts))], [*names, *COUNTS])

    return joined.mapInArrow(run, schema)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup_lines(load_documents(spark, sf_dir))
    return done.select(
        "doc_id", F.col("line_words").alias("n_words"), F.col("line_removed").alias("n_removed"), F.col("line_runs").alias("n_runs"),
        F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES: dict[str, str] = {}
