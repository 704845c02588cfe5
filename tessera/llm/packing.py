"""Best-fit packing by length patterns.

Documents are tokenised whole, cut into pieces of at most ``capacity`` tokens, and only the
histogram of piece lengths (at most ``capacity`` numbers, however large the corpus) goes to
the driver. There, patterns of a few lengths that fill a sequence are enumerated, their
repeat counts are fitted to the histogram by non-negative least squares, rounded, and
the residual lengths are packed best-fit. Pieces then learn their place from their rank
among the pieces of their length, which is counted in salted groups.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.text import load_documents
from tessera.session import cut

CAPACITY = 1024
END = 2
#: Pieces of one length in one numbering group.
GROUP = 50_000
#: Tokens that a fitted pattern may leave free.
SLACK = 8


def tokenizer(path: str):
    """The byte-level BPE at ``path`` (.json, or the same vocabulary as .tiktoken ranks), strings of special tokens as plain text."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def default_vocabulary() -> str:
    """The vocabulary of byte_bpe_50k.json in its .tiktoken form, which gives the same ids about four times as fast."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, text) -> a row for each piece: doc_id, piece, start, length, ids_crc32 [, ids].

    A document is its ids and one end id. Documents of more than ``capacity`` ids are cut
    into pieces of ``capacity``; what is left over is the first piece. Null and empty texts
    are one piece with the end id alone. Repeated rows are packed as often as they occur.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary or default_vocabulary())
        for b in batches:
            who, num, start, length, crc, all_ids = [], [], [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END], "<u4")
                lo, k = 0, 0
                hi = len(ids) % capacity or min(capacity, len(ids))
                while lo < len(ids):
                    part = ids[lo:hi]
                    who.append(doc), num.append(k), start.append(lo), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        all_ids.append(part.astype(np.int32))
                    lo, hi, k = hi, hi + capacity, k + 1
            out = [pa.array(who, pa.int64()), pa.array(num, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            out += [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def patterns(lengths: np.ndarray, capacity: int, per_length: int = 24) -> list[tuple[int, ...]]:
    """Patterns of one to four of the given lengths (repeats allowed) that fill a sequence, or nearly.

    For each length: its repeats, its best partner, and with each of ``per_length`` second
    lengths spread over the range the best third and fourth. The number depends on the
    number of distinct lengths only.
    """
    have = np.sort(lengths)
    best = np.zeros(capacity + 1, np.int64)  # the largest length that fits into a room
    best[have] = have
    best = np.maximum.accumulate(best)
    out = set()
    for a in have.tolist():
        out.add(tuple([a] * (capacity // a)) if capacity // a <= 8 else (a,))
        second = have[have <= capacity - a]
        if not len(second):
            out.add((a,))
            continue
        for b in {int(best[capacity - a]), *second[np.unique(np.linspace(0, len(second) - 1, per_length).astype(int))].tolist()}:
            room = capacity - a - b
            c = int(best[room]) if room else 0
            out.add(tuple(x for x in sorted((a, b, c), reverse=True) if x))
            if room >= 2 and (half := int(best[room // 2])):
                d = int(best[room - half])
                out.add(tuple(x for x in sorted((a, b, half, d), reverse=True) if x))
    return sorted(out)


def fit(counts: np.ndarray, choices: list[tuple[int, ...]], rounds: int = 60, entering: int = 128) -> np.ndarray:
    """Non-negative least squares by an active set: repeats of each pattern, so that all use up the histogram.

    In each round the patterns that promise most (by the gradient; no two with a common length) enter,
    and those that the least squares of all in use would make negative leave. At most as many stay in use as there
    are lengths, so that repeats are few and large. Each row of the matrix is a length, scaled by its count, so
    that rare lengths weigh as much as frequent ones. What is left
    unfitted is packed like all residuals.
    """
    width = max(map(len, choices))
    slots = np.array([[*c, *[0] * (width - len(c))] for c in choices])
    want = counts.astype(float)
    want[0] = 0
    scale = np.where(want > 0, 1 / np.maximum(want, 1), 0)
    x, used = np.zeros(len(choices)), np.zeros(0, np.int64)
    columns = np.zeros((len(counts), 0))

    def column(k: np.ndarray) -> np.ndarray:
        out = np.zeros((len(counts), len(k)))
        np.add.at(out, (slots[k], np.arange(len(k))[:, None]), 1)
        return out * scale[:, None]

    goal = scale * want
    kept, least, idle = x.copy(), float(goal @ goal), 0
    for _ in range(rounds):
        missing = goal - columns @ x[used]
        gain = (scale * missing)[slots].sum(1) / np.sqrt((scale[slots] ** 2).sum(1))
        gain[used] = 0
        new, touched = [], set()
        for k in np.argsort(-gain, kind="stable").tolist():
            if gain[k] < 1e-6 or len(new) == entering:
                break
            if touched.isdisjoint(choices[k]):
                new.append(k)
                touched.update(choices[k])
        if not new:
            break
        columns, used = np.hstack([columns, column(np.array(new))]), np.append(used, new)
        while len(used):
            best = np.linalg.solve(columns.T @ columns + 1e-9 * np.eye(len(used)), columns.T @ goal)
            stays = best > 1e-9
            x[used] = np.maximum(best, 0)
            columns, used = columns[:, stays], used[stays]
            if stays.all():
                break
        missing = goal - columns @ x[used]
        error = float(missing @ missing)
        idle = 0 if error < 0.99 * least else idle + 1
        if error < least:
            kept, least = x.copy(), error
        if idle == 3 or least < 1e-6 * float(goal @ goal):
            break
    return kept


def fitted(counts: np.ndarray, choices: list[tuple[int, ...]], x: np.ndarray, least: float) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(pattern, repeats) of the fitted, rounded repeats, and the pieces that these leave.

    Whole repeats come first, then one more of each pattern with a fraction of ``least`` or more, the
    largest first, as long as its pieces last.
    """
    left, out = counts.copy(), []
    whole = np.floor(x + 1e-6)
    for repeats, order in ((whole, np.argsort(-x, kind="stable")), (x - whole >= least, np.argsort(whole - x, kind="stable"))):
        for k in order.tolist():
            need = Counter(choices[k])
            n = min(int(repeats[k]), *(int(left[a]) // m for a, m in need.items()))
            if n > 0:
                out.append((choices[k], n))
                for a, m in need.items():
                    left[a] -= m * n
    return out, left


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): the longest piece, then whatever fills the room best, as often as it all lasts."""
    left, out = counts.copy(), []
    while left.any():
        pattern, room, rest = [], capacity, left.copy()
        while len(fits := np.flatnonzero(rest[: room + 1])):
            a = int(fits[-1])
            pattern.append(a)
            rest[a] -= 1
            room -= a
        n = min(int(left[a]) // pattern.count(a) for a in set(pattern))
        out.append((tuple(pattern), n))
        for a in set(pattern):
            left[a] -= pattern.count(a) * n
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every piece of the histogram exactly once.

    Fractions are rounded up from a half on, or, where that takes fewer sequences (histograms
    of a few pieces a length), not at all.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    out = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    lengths = np.flatnonzero(left)
    # Looser patterns are left to the residual packing.
    choices = [c for c in patterns(lengths, capacity) if sum(c) >= capacity - SLACK] if len(lengths) else []
    if not choices:
        return out + best_fit(left, capacity)
    x = fit(left, choices)
    ways = []
    for least in (0.5, 1.0):
        used, rest = fitted(left, choices, x, least)
        ways.append(used + best_fit(rest, capacity))
    return out + min(ways, key=lambda way: sum(n for _, n in way))


def places(packed: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, offset), by rank; ranks of a row go to consecutive sequences."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, n in packed:
        offset = 0
        for a in pattern:
            rows.setdefault(a, []).append((taken.get(a, 0), sequence, offset))
            taken[a] = taken.get(a, 0) + n
            offset += a
        sequence += n
    return {a: np.array(r) for a, r in rows.items()}


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with a length of 1 to ``capacity`` -> the same rows and sequence_id, offset.

    Every sequence is filled from offset 0 without gaps. An empty table gives an empty table.
    """
    spark = found.sparkSession
    names = found.columns
    found = cut(found.withColumn("salt", F.xxhash64("doc_id", "piece", "ids_crc32")))
    histogram = {int(r[0]): r[1] for r in found.groupBy("length").count().collect()}
    groups = {a: -(-n // GROUP) for a, n in histogram.items()}
    most = max(groups.values(), default=1)
    salted = found.withColumn("salt", F.pmod("salt", F.lit(most)))
    sizes = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(sizes, ["length", "salt"])
    ranked = ranked.select(*names, (F.col("rank") + F.col("before")).alias("rank"))
    sent = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select(names).schema) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = sent.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for a in np.unique(length).tolist():
                mine = np.flatnonzero(length == a)
                rows = where[a]
                at = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                sequence[mine], offset[mine] = at[:, 1] + rank[mine] - at[:, 0], at[:, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(pieces(docs, vocabulary, capacity), capacity)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(load_documents(spark, sf_dir))


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
