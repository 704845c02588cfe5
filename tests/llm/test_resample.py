"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import resample as R

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
EXTRA = ", score long, rank string, n_words long, row long, part int"


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs_of(words, low, high):
    return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, low=1, high=1, buckets=10_000, seed=2024, min_words=20, percent=10):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in runs_of(words_of(t), low, high))
    source, wanted = count(t for _, t in docs), count(target)
    s, t = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log(((wanted[b] + 1) * (s + buckets)) / ((source[b] + 1) * (t + buckets))))
    rows = []
    for doc_id, text in docs:
        w = words_of(text)
        f = runs_of(w, low, high)
        weight = sum(gain(zlib.crc32(x.encode()) % buckets) for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    allowed = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1]))
    for k, r in enumerate(allowed[: percent * len(allowed) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def texts(seed=3, n=300):
    rng = random.Random(seed)
    out = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    return [*out, None, "", " \n", "É日本 x\ty", "A-b,C" * 30, "word " * 300_000, *out[:20]]


@pytest.mark.parametrize("low,high,percent", [(1, 1, 10), (1, 3, 40), (2, 2, 100)])
def test_resampling_is_brute_force(spark, low, high, percent):
    docs = list(enumerate(texts()))
    docs += [(None, docs[3][1]), (5, docs[5][1]), (5, docs[5][1]), (7, docs[9][1])]
    target = ["aa b ccc d", "e f gg", None, "E F", "zz zz"]
    frame = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in docs], "doc_id long, text string" + EXTRA).repartition(5)
    want = spark.createDataFrame([(t, 1) for t in target], "text string, side int")
    got = R.resample(frame, want, low, high, percent=percent).drop("n_words").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, target, low, high, percent=percent)


def test_resampling_of_little(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(none, none.select("text")).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = R.resample(one, none.select("text")).first()
    assert (r.n_features, r.rank) == (2, None)


def test_repeated_rows_are_drawn_to_the_number(spark):
    """Rows that are equal in all: as many as are wanted, not all or none."""
    text = " ".join(f"w{i}" for i in range(25))
    d = spark.createDataFrame([(1, text)] * 90 + [(2, text)] * 10, "doc_id long, text string").repartition(7)
    got = [r.rank for r in R.resample(d, d.select("text").limit(1), percent=33).collect() if r.rank]
    assert sorted(got) == list(range(1, 34))


def test_selection_finds_the_exact_key_in_few_rounds(spark):
    rng = random.Random(8)
    keys = [(rng.randrange(50), rng.randrange(1000), 0, i) for i in range(4000)]
    d = spark.createDataFrame(keys, "low_score long, id_order long, n_features long, row long").repartition(6).cache()
    for k in (1, 2, 1999, 4000):
        found, rounds = R.cutoff(d, k)
        assert found == sorted(keys)[k - 1] and rounds <= 2 + math.log(4000) / math.log(4 / 3)


def test_target_texts_are_preferred(spark):
    rng = random.Random(4)
    text = lambda words: " ".join(rng.choice(words) for _ in range(40))
    like, unlike = [f"m{i}" for i in range(50)], [f"q{i}" for i in range(50)]
    docs = spark.createDataFrame([(i, text(like if i % 10 == 0 else unlike)) for i in range(400)], "doc_id long, text string")
    drawn = R.drawn_documents(docs, R.resample(docs, spark.createDataFrame([(text(like),) for _ in range(20)], "text string")))
    assert sorted(r.doc_id for r in drawn.collect()) == list(range(0, 400, 10))


def test_resampling_query(spark):
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.001"
    docs = [tuple(r.values()) for r in pq.read_table(f"{path}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    target = pq.read_table(f"{path}/benchmark.parquet").column("text").to_pylist()
    got = R.op11_resampling(spark, path)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, target)
