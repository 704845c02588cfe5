"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import runs as R


def brute_runs(w, periods=4, least=6):
    n, out = len(w), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if j > i and len(s) >= max(least, periods * q) and not any(s[d:] == s[:-d] for d in range(1, q)):
                out.append((i, len(s), q))
            i = j + 1
    return sorted(out)


def planted(doc_id, text):
    w, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def brute(doc_id, text):
    w = planted(doc_id, text)
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *told, sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("periods,least", [(4, 6), (2, 2), (3, 5)])
def test_word_runs_are_brute_force(periods, least):
    rng = random.Random(periods)
    for _ in range(600):
        n, k = rng.randrange(70), rng.choice([1, 2, 3, 5, 40])
        w = [b"%d" % rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3) if n else 0):
            a = rng.randrange(n)
            p = 1 + (n - a) // (3 + rng.randrange(8))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert R.word_runs(w, periods, least) == brute_runs(w, periods, least)


def test_suffix_trees_hold_all_suffixes_and_answer_extensions():
    rng = random.Random(2)
    for _ in range(100):
        s = [rng.randrange(1, 4) for _ in range(rng.randrange(2, 60))]
        e = R.Extensions(s)
        full = [*s, 0]
        assert e.leaves == sorted(range(len(full)), key=lambda i: full[i:])
        assert e.reversed_leaves() == sorted(range(len(full)), key=lambda i: [-x if x else -9 for x in full[i:]])
        a, b = np.array([(i, j) for i in range(len(s)) for j in range(i + 1, len(full))]).T
        want = [next(k for k in range(len(full)) if j + k >= len(full) or full[i + k] != full[j + k]) for i, j in zip(a, b)]
        assert e.common(a, b).tolist() == want


def test_long_run_texts():
    """Trees of long stretches: a period, and Fibonacci words, whose runs are many."""
    w = [b"x", *([b"%d" % (i % 7) for i in range(40_000)]), b"y"]
    assert R.word_runs(w) == [(1, 40_000, 7)]
    a, b = "a", "ab"
    while len(b) < 2000:
        a, b = b, b + a
    assert R.word_runs(list(b), 2, 2) == brute_runs(list(b), 2, 2)


def test_runs_of_tables(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(150)]
    docs = [*enumerate(texts), (3, texts[3]), (3, texts[3]), (None, "a a a a a a a"), *((900 + i, t) for i, t in enumerate([None, "", " \t\n", "w", "日 " * 50, "A\x0ba " * 9, "x y " * 6, "la " * 20_000]))]
    frame = spark.createDataFrame([(*d, 1, "s", [1]) for d in docs], "doc_id long, text string, w long, collapsed string, runs array<int>")
    got = R.plant(frame)
    found = R.periodic_runs(got)
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs]) for r in found.collect()), key=repr) == sorted(((d, brute_runs(planted(d, t))) for d, t in docs), key=repr)
    assert R.periodic_runs(frame.limit(0)).count() == 0
    row = R.periodic_runs(frame.where("doc_id = 907")).first()
    assert (row.n_words, [tuple(x) for x in row.runs], row.collapsed) == (20_000, [(0, 20_000, 1)], "la")


def test_runs_query(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    docs = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    docs += [(10_000 + i, t) for i, t in enumerate(["a b " * 9 + "c d e " * 12, None, "", "q q q q q q z q q q q q q"])] + [(None, "k k k k k k")]
    pq.write_table(pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": [t for _, t in docs]}), tmp_path / "documents.parquet")
    got = R.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((brute(*d) for d in docs), key=repr)
