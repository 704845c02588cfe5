"""Resampling of documents by importance for a target distribution.

Texts are bags of hashed word runs. Two histograms over ``buckets`` numbers, of the documents
and of the target texts, give every bucket a gain (thousandths of the smoothed log ratio), an
array that travels to the tasks; a document's weight is the sum of its features' gains, looked
up in the array. Weight plus Gumbel noise, drawn from a hash of the id, is its score: taking the
highest scores samples without replacement in proportion to the exponential of the weights.

The highest scores are drawn by weighted median-of-medians selection over the written keys. Each
partition tells the median and the number of its keys that are still in question; the median of
these medians, weighted by the numbers, has at least a quarter of the keys in question on either
side, so each round discards a quarter or more, until the cutoff key itself is met. The driver sees
one row a partition in each round. Only the winners are sorted, by ranges.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.text import ALNUM, load_documents, table
from tessera.session import cut, materialize

BUCKETS, LOW, HIGH = 10_000, 1, 1
SEED, MIN_WORDS, PERCENT = 2024, 20, 10
#: Bytes of a text that are split into words at a time.
PART = 1 << 20
#: A key: ascending order is the order of drawing. The last column tells equal rows apart.
KEY = ["low_score", "id_order", "n_features", "row"]
LAST_ID = (1 << 63) - 1


def features(text: str | None, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of their runs) of a text, part by part; runs of ``low`` to ``high`` words, joined by a space."""
    data = text.encode("utf-8", "surrogatepass").translate(ALNUM) if text else b""
    at, tail = 0, []
    while at < len(data):
        end = data.find(b" ", at + PART)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        for n in range(low, high + 1):
            row = tail[max(0, len(tail) - n + 1) :] + words if n > 1 else words
            runs = row if n == 1 else [b" ".join(row[i : i + n]) for i in range(len(row) - n + 1)]
            yield (len(words) if n == low else 0), np.fromiter(map(crc32, runs), np.int64, len(runs)) % buckets
        tail = (tail + words)[-(high - 1) :] if high > 1 else []
        at = end


def histograms(docs: DataFrame, target: DataFrame, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the features of all texts by bucket: documents, target. A task passes on a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for b in batches:
            for side, text in zip(b.column(0).to_pylist(), b.column(1)):
                for _, found in features(text.as_py(), low, high, buckets):
                    counts[side] += np.bincount(found, minlength=buckets)
        side, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(side.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[side, bucket])], ["side", "bucket", "n"])

    both = docs.select(F.lit(0).alias("side"), "text").union(target.select(F.lit(1).alias("side"), "text"))
    out = np.zeros((2, buckets), np.int64)
    for r in both.mapInArrow(run, "side int, bucket int, n long").groupBy("side", "bucket").agg(F.sum("n").alias("n")).collect():
        out[r.side, r.bucket] = r.n
    return out[0], out[1]


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket the smoothed log ratio in thousandths, rounded down."""
    k, s, t = len(source), float(source.sum()), float(target.sum())
    ratio = lambda a, b: ((b + 1.0) * (s + k)) / ((a + 1.0) * (t + k))
    return np.array([math.floor(1000 * math.log(ratio(float(a), float(b)))) for a, b in zip(source, target)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a hash of the id (none: of an empty one)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, low: int = LOW, high: int = HIGH, seed: int = SEED) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_features, weight, score."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = n = weight = 0
                for w, found in features(text.as_py(), low, high, len(gain)):
                    words, n, weight = words + w, n + len(found), weight + int(gain[found].sum())
                rows.append((doc_id, words, n, weight, weight + noise(doc_id, seed)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def _medians(keys: DataFrame, low: tuple | None, high: tuple | None, pivot: tuple | None) -> list:
    """A row a partition: of its keys between low and high, the numbers below the pivot, at it and above it, and the medians of those below and above.

    The first column's bounds are pushed down to the sorted files, so keys out of question are hardly read.
    """
    kept = keys.select(*KEY)
    for bound, keep in ((low, F.col(KEY[0]).__ge__), (high, F.col(KEY[0]).__le__)):
        kept = kept if bound is None else kept.where(keep(bound[0]))

    def compare(cols: list[np.ndarray], key: tuple) -> np.ndarray:
        sign = np.zeros(len(cols[0]), np.int8)
        for c, x in zip(reversed(cols), reversed(key)):
            sign = np.where(c == x, sign, np.where(c < x, -1, 1)).astype(np.int8)
        return sign

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(len(KEY))]
            inside = np.ones(len(cols[0]), bool)
            if low is not None:
                inside &= compare(cols, low) > 0
            if high is not None:
                inside &= compare(cols, high) < 0
            parts.append([c[inside] for c in cols])
        cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * len(KEY)
        side = np.ones(len(cols[0]), np.int8) if pivot is None else compare(cols, pivot)
        row: list = [int((side == 0).sum())]
        for want in (-1, 1):
            mine = [c[side == want] for c in cols]
            n = len(mine[0])
            middle = np.lexsort(mine[::-1])[(n - 1) // 2] if n else None
            row += [n, None if middle is None else [int(c[middle]) for c in mine]]
        if row[0] or row[1] or row[3]:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64(), *[pa.int64(), pa.list_(pa.int64())] * 2])], ["same", "below", "below_median", "above", "above_median"])

    return kept.mapInArrow(run, "same long, below long, below_median array<long>, above long, above_median array<long>").collect()


def weighted_median(medians: list[tuple[list[int], int]]) -> tuple:
    """The first of the sorted keys at which half of the weight is reached."""
    half, so_far = sum(n for _, n in medians) / 2, 0
    for key, n in sorted(medians):
        so_far += n
        if so_far >= half:
            return tuple(key)
    raise ValueError("no keys")


def cutoff(keys: DataFrame, k: int) -> tuple[tuple, int]:
    """(the k-th smallest key, rounds it took). ``keys`` has the columns of KEY, none null, and at least k rows, no two alike."""
    low = high = pivot = None
    rounds = 0
    while True:
        found = _medians(keys, low, high, pivot)
        rounds += 1
        below, same = sum(r.below for r in found), sum(r.same for r in found)
        if pivot is not None and below < k <= below + same:
            return pivot, rounds
        if pivot is not None and k <= below:
            high, side = pivot, [(r.below_median, r.below) for r in found if r.below]
        else:
            k -= below + same
            low, side = pivot or low, [(r.above_median, r.above) for r in found if r.above]
        pivot = weighted_median(side)


def sort_winners(rows: DataFrame) -> DataFrame:
    """Adds ``rank``, from 1, in order of KEY: ranges are numbered by themselves, and each adds the sizes of those before it."""
    dealt = cut(rows.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").count()
    before = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    here = F.row_number().over(Window.partitionBy("part").orderBy(*KEY))
    return dealt.withColumn("at", here).join(F.broadcast(before), "part").withColumn("rank", F.col("at") + F.col("before")).select(*rows.columns, "rank")  # a row a range


def resample(docs: DataFrame, target: DataFrame, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text), (text) -> doc_id, n_words, n_features, weight, score, rank for every document.

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred (rounded down)
    are drawn and numbered from the highest score; of equal scores the smaller doc_id comes first,
    a null one last, then fewer features; of rows equal in all this any. The others' rank is null.
    Null and empty texts have no features and weight 0. Repeated rows are judged each by itself.
    An empty target or few documents are no special case; an empty table gives an empty table.
    Extra columns are ignored.
    """
    source, wanted = histograms(docs, target, low, high, buckets)
    d = scores(docs, gains(source, wanted), low, high, seed)
    d = d.select("*", (-F.col("score")).alias(KEY[0]), F.coalesce("doc_id", F.lit(LAST_ID)).alias(KEY[1]), F.monotonically_increasing_id().alias(KEY[3]))
    # Written in order within each file, so that later rounds skip what is out of question. Rows are known by the written number.
    d = materialize(d.sortWithinPartitions(*KEY))
    shown = ["doc_id", "n_words", "n_features", "weight", "score"]
    allowed = d.where(F.col("n_words") >= min_words)
    k = percent * allowed.count() // 100
    if not k:
        return d.select(*shown, F.lit(None).cast("long").alias("rank"))
    last, _ = cutoff(allowed, k)
    won = (F.col("n_words") >= min_words) & (F.struct(*KEY) <= F.struct(*(F.lit(x).cast("long").alias(n) for n, x in zip(KEY, last))))
    winners = sort_winners(d.where(won)).select(*shown, F.col("rank").cast("long").alias("rank"))
    return winners.union(d.where(~won).select(*shown, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; doc_id has to be unique."""
    return docs.join(judged.where("rank is not null").select("doc_id"), "doc_id", "left_semi")


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(load_documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES = {"op11_resampling": op11_resampling}
ORACLES: dict[str, str] = {}
