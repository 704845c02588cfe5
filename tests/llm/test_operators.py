"""The ten operators against brute force on small inputs with nulls, blanks, long texts, ties, repeats and clashing columns."""

import hashlib
import random
import time
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontam, licenses, linededup, lm, omh, packing, simhash, toxicity, urlfilter, warc
from tessera.llm.text import space_words, space_words_of

EXTRA = ", row long, sig string, n int, w string, k string, score double, line_doc long, matches int, gone long, line_runs string"
BLANKS = [None, "", "   ", "\n\t"]


def docs_of(spark, texts, ids=None, extra=True):
    rows = [(i if ids is None else ids[i], t) for i, t in enumerate(texts)]
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    return spark.createDataFrame([(*r, 1, "s", 2, "w", "k", 0.5, 3, 4, 5, "r") for r in rows], "doc_id long, text string" + EXTRA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("." if rng.random() < 0.12 else "") for _ in range(n))


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(n)]
    near = texts[3].split()
    near[len(near) // 2] = "changed"
    return [*texts, " ".join(near), texts[5], texts[5], texts[6].upper(), *BLANKS, "one", "ONE", prose(rng, 6000), "ab " * 9000, "é" * 3000, "日本語 テキスト"]


def simhash_brute(text, k=4):
    words = re.findall(r"[^ \x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_brute(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_is_brute_force(spark):
    texts = corpus()
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    fp = {i: simhash_brute(t) for i, t in enumerate(texts)}
    links = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    want = components_brute(list(fp), links)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fp.items()}
    assert {i: r.component_id for i, r in got.items()} == want


def test_simhash_hot_signatures_lose_no_link(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    values = {base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(50)}
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(sorted(values))]
    nodes = spark.createDataFrame(rows, "node long, f0 long")
    want = {(a, b) for a, x in rows for b, y in rows if a < b and ((x ^ y) & (1 << 64) - 1).bit_count() <= 4}
    for hot in (1, 5, 10_000):
        got = [tuple(r) for r in simhash.similar_pairs(nodes, 4, 3, hot=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("hot", [1, 20, 10_000])
def test_simhash_contracted_links_are_brute_force(spark, hot):
    rng = random.Random(14)
    values = set()
    for _ in range(6):
        # Chains of near copies, each a few bits from one before it.
        chain = [rng.getrandbits(64)]
        for _ in range(60):
            chain.append(rng.choice(chain) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))))
        values |= set(chain)
    values |= {rng.getrandbits(64) for _ in range(60)}
    values = list(values)
    rng.shuffle(values)
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    nodes = spark.createDataFrame(rows, "node long, f0 long")
    links = [(a, b) for a, x in enumerate(values) for b in range(a) if (x ^ values[b]).bit_count() <= 4]
    got = {r.node: r.component for r in simhash.linked_fingerprints(nodes, 4, 3, hot=hot).collect()}
    assert got == components_brute(list(range(len(values))), links)
    # Within a bundle of copies that leaders link, no pair is left.
    bundle = [values[0], *(values[0] ^ 1 << b for b in range(40))]
    named = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v, 0, 41) for i, v in enumerate(bundle)], "node long, f0 long, component long, size long")
    assert simhash.similar_pairs(named, 4, 3, hot=hot).count() == 0


def test_simhash_leaders_and_hot_signatures_take_one_shuffle(spark):
    rng = random.Random(24)
    base = rng.getrandbits(64)
    values = sorted({base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(90)} | {rng.getrandbits(64) for _ in range(60)})
    nodes = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "node long, f0 long")
    plan = simhash.leader_links(nodes, 4, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(sig") == 1
    keys = [r.sig for r in simhash.signatures(nodes, 3).collect()]
    for hot in (20, 2000):
        rows = simhash.leader_links(nodes, 4, 3, hot=hot).collect()
        assert {r.hot_sig for r in rows} - {None} == {s for s in keys if keys.count(s) > hot}
        links = [(r.u, r.v) for r in rows if r.hot_sig is None]
        assert len(links) == len(set(links)) and all(v < u and (values[u] ^ values[v]).bit_count() <= 4 for u, v in links)
        # Few pairs are left to the join of two components.
        root = components_brute(range(len(values)), links)
        near = [(a, b) for a, x in enumerate(values) for b in range(a) if (x ^ values[b]).bit_count() <= 4]
        assert near and sum(root[a] == root[b] for a, b in near) >= 0.95 * len(near)


def test_simhash_empty_repeated_and_null_ids(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    got = simhash.near_duplicates(docs_of(spark, ["a b c d e", "a b c d e", "x y"], [7, 7, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, None), (7, 7), (7, 7)]


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(2)
    texts = [prose(rng, 300, 5000) for _ in range(12)]
    near = texts[0].split()
    near[150] = "changed"
    docs = docs_of(spark, [*texts, texts[1], " ".join(near), *BLANKS])
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == [*range(12), 14]


def shingles_brute(text, k=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {" ".join(words)} - {""}


@pytest.mark.parametrize("busy", [3, 10_000])
def test_near_dedup_links_every_similar_pair(spark, busy):
    rng = random.Random(31)
    texts = []
    for _ in range(40):
        base = prose(rng, rng.randrange(60, 300), 10**6).split()
        texts.append(" ".join(base))
        for share in (0.80, 0.82, 0.85, 0.9, 0.95):
            # The similarity of a copy that lacks the end is the share of shingles left.
            texts.append(" ".join(base[: 4 + int(np.ceil(share * (len(base) - 4)))]) if rng.random() < 0.5 else " ".join(base[:-1] + ["x"] * rng.randrange(1, 9)))
            # Changed words at random places.
            copy = list(base)
            for at in rng.sample(range(len(base)), max(1, round((1 - share) / (1 + share) * len(base) / 5))):
                copy[at] = f"c{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    sets = [shingles_brute(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in simhash.similar_components(docs_of(spark, texts, extra=False), busy=busy).collect()}
    assert len(links) > 100 and got == components_brute(list(range(len(texts))), links)


def test_near_dedup_pairs_alone(spark):
    rng = random.Random(32)
    texts = []
    for share in (0.80, 0.85, 0.9, 0.95):
        for _ in range(25):
            base = prose(rng, rng.randrange(80, 300), 10**6).split()
            texts += [" ".join(base), " ".join(base[: 4 + int(np.ceil(share * (len(base) - 4)))])]
    got = {r.doc_id: r.component_id for r in simhash.similar_components(docs_of(spark, texts, extra=False)).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_near_dedup_sketches_lose_no_similar_pair(spark):
    """Sets of 0.8 and more always pass, whatever their sizes; unlike ones hardly ever, so their hashes aren't moved."""
    rng = np.random.default_rng(35)
    sets, alike, unlike = [], [], []
    for n in [1, 2, 5, 10, 63, 64, 65, 127, 129, 300, 1000, 5000] * 6:
        base = rng.integers(0, 1 << 63, n, np.uint64)
        lost = rng.integers(0, n // 5 + 1)  # of the larger set, so n - lost of n are shared
        at = len(sets)
        sets += [np.unique(base), np.unique(base[lost:]), np.unique(np.concatenate([base[: n // 2], rng.integers(0, 1 << 63, n, np.uint64)]))]
        alike.append((at, at + 1))
        unlike += [(at, at + 2), (at + 2, at + 1)] if n > 50 else []
    assert all(len(sets[b]) >= 0.8 * len(sets[a]) for a, b in alike)
    sketches = spark.createDataFrame([(v, len(h), simhash.parity_sketch(h).tolist()) for v, h in enumerate(sets)], "v long, n int, sketch array<long>")
    got = {(r.a, r.b) for r in simhash.maybe_similar(spark.createDataFrame(alike + unlike, "a long, b long"), sketches, 0.8).collect()}
    assert got >= set(alike) and len(got & set(unlike)) <= 0.05 * len(unlike)


def test_near_dedup_of_many_equal_sets(spark, monkeypatch):
    """Where repeated sets are too many to be broadcast; ids repeat or are null."""
    rng = random.Random(36)
    base = [prose(rng, 120, 10**6) for _ in range(4)]
    texts, ids = [*base, *base, *base, base[0][:-40], base[1]], [10, 11, 12, 13, 4, 5, 6, 7, 10, 11, 9, None, 20, None]
    want = [4, 5, 6, 7, 4, 5, 6, 7, 4, 5, 6, 7, 4, 5]
    for most in (simhash.BROADCAST_IDS, 0):
        monkeypatch.setattr(simhash, "BROADCAST_IDS", most)
        got = simhash.similar_components(docs_of(spark, texts, ids, extra=False)).collect()
        assert sorted((r.doc_id or -1, r.component_id) for r in got) == sorted((i or -1, c) for i, c in zip(ids, want))


def test_near_dedup_links_by_fingerprints_first(spark, monkeypatch):
    """Pairs within four bits come from signatures and are verified; only pairs of two components are left to the exact join."""
    rng = random.Random(34)
    texts = []
    for _ in range(20):
        base = prose(rng, 400, 10**6).split()
        texts += [" ".join(base), " ".join([*base[:-1], f"c{rng.randrange(10**6)}"])]
    filler = "| " * 900
    texts += [filler + prose(rng, 100, 10**6) for _ in range(3)]
    met = []
    real = simhash.neighbour_pairs
    monkeypatch.setattr(simhash, "neighbour_pairs", lambda *args: met.append(real(*args)) or met[-1])
    got = {r.doc_id: r.component_id for r in simhash.similar_components(docs_of(spark, texts, extra=False)).collect()}
    fp = [simhash.majority_bits(simhash.shingle_hashes(t, 5)) & (1 << 64) - 1 for t in texts]
    want = {frozenset((x, y)) for x in fp for y in fp if 0 < (x ^ y).bit_count() <= 4}
    assert {frozenset(v & (1 << 64) - 1 for v in r) for r in met[0].collect()} == want and len(want) >= 15
    assert len(set(fp[-3:])) == 1 and got == {i: i - i % 2 if i < 40 else i for i in range(len(texts))}
    # Without the exact join (no shingle is a key), the same links but for pairs further apart.
    monkeypatch.setattr(F, "posexplode", lambda column, real=F.posexplode: real(F.slice(column, 1, 0)))
    got = {r.doc_id: r.component_id for r in simhash.similar_components(docs_of(spark, texts, extra=False)).collect()}
    assert got == components_brute(list(range(len(texts))), [(i, i + 1) for i in range(0, 40, 2) if (fp[i] ^ fp[i + 1]).bit_count() <= 4])


def test_near_dedup_filler_does_not_merge_different_texts(spark):
    rng = random.Random(33)
    filler = "| " * 400
    texts = [filler + prose(rng, 100, 10**6), filler + prose(rng, 100, 10**6), "- " * 300 + prose(rng, 60, 10**6), "- " * 300 + prose(rng, 60, 10**6)]
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(docs_of(spark, texts)).collect())
    assert kept == [0, 1, 2, 3]


def omh_brute(text):
    """Fingerprints by the definition: for each mark of the circle the next two numbered k-mers."""
    t = re.split(omh.SPACES, re.sub(rf"(\S{{{omh.PIECE}}}|[^\x00-\u2E7F])", r"\1 ", text, flags=re.A).strip(" \t\n\x0b\f\r"))
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def h(*parts):
        seed = 42
        for p in parts:
            raw = p.encode() if isinstance(p, str) else p[0].to_bytes(p[1], "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed)
        return signed(seed)

    seen, ring = Counter(), []
    for i in range(max(1, len(t) - 1)):
        key = h(*t[i : i + 2]) >> omh.PLACE_BITS
        number = h((key, 8), (seen[key], 4)) if seen[key] else key << omh.PLACE_BITS
        ring.append(((number & (1 << 63) - 1) >> omh.PLACE_BITS, i))
        seen[key] += 1
    ring.sort()
    out = []
    for b in range(omh.BINS):
        at = sum(v << omh.PLACE_BITS < b << omh.SHIFT for v, _ in ring)
        two = [ring[(at + j) % len(ring)] for j in (0, 1)] if len(ring) > 1 else ring * 2
        out.append(1 + h(*((v, 8) for v, _ in sorted(two, key=lambda x: x[1]))) % 65535)
    return out


def alike(a, b):
    return sum(x == y for x, y in zip(a, b)) / omh.BINS


def test_order_minhash_is_brute_force(spark):
    texts = [t for t in corpus(3, 20)] + ["x" * 40, "to be or not to be " * 60, "日本語のテキスト" * 5, "a b"]
    got = {r.doc_id: r for r in omh.edit_likeness(docs_of(spark, texts)).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for at, i in enumerate(order):
        follower_id = order[(at + 1) % len(order)]
        text, follower = texts[i] or "", texts[follower_id] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follower[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.next_id) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), follower_id)
        assert r.fp == omh_brute(text) and r.edited_fp == omh_brute(edited), i
        assert r.near_edited == alike(r.fp, r.edited_fp) and r.near_next == alike(r.fp, got[follower_id].fp)
    assert got[5].fp == got[21].fp == got[22].fp


def test_order_minhash_rows_of_one_id(spark):
    assert omh.edit_likeness(docs_of(spark, [])).count() == 0
    one = omh.edit_likeness(docs_of(spark, ["abc def"])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()
    same = omh.edit_likeness(docs_of(spark, ["a", "b", "c"], [1, 1, None])).collect()
    assert len(same) == 3
    texts, ids = ["abcdef", "abcdef", "abcdef", "ghijkl", "mnopqr"], [5, 5, 5, 2, 9]
    rows = omh.edit_likeness(docs_of(spark, texts, ids)).collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((r.doc_id, r.edited_sha256) for r in rows) == sorted([(9, digest("mnopab")), (5, digest("abcdab")), (5, digest("abcdab")), (5, digest("abcdgh")), (2, digest("ghijmn"))])


def test_order_minhash_sees_order_at_every_length(spark):
    """Swapped halves hold the same words: a signature of the set would stay near 1."""
    rng = random.Random(5)
    words = [[f"u{rng.randrange(10**6)}" for _ in range(n)] for n in [12] * 20 + [40] * 20 + [400] * 5]
    rows = omh.order_minhash(docs_of(spark, [" ".join(w[len(w) // 2 * s :] + w[: len(w) // 2 * s]) for w in words for s in (0, 1)], extra=False), "text", "fp").orderBy("doc_id").collect()
    near = [alike(rows[2 * i].fp, rows[2 * i + 1].fp) for i in range(len(words))]
    for part in (near[:20], near[20:40], near[40:]):
        assert 0.2 < sum(part) / len(part) < 0.7
    assert sum(near[:20]) / 20 < 0.5  # about 80 characters


def test_order_minhash_likeness_is_steady_over_lengths(spark):
    """Texts that keep their first two thirds have about the same likeness whatever their length."""
    rng = random.Random(6)
    for a, b in ((600, 405), (500, 540), (60, 60), (120, 120), (2577, 2577)):
        near = []
        texts = []
        for _ in range(40):
            base = " ".join(f"u{rng.randrange(10**6)}" for _ in range(800))
            texts += [base[:a], base[: a - a // 3] + " ".join(f"v{rng.randrange(10**6)}" for _ in range(800))[: b - (a - a // 3)]]
        rows = omh.order_minhash(docs_of(spark, texts, extra=False), "text", "fp").orderBy("doc_id").collect()
        near = [alike(rows[i].fp, rows[i + 1].fp) for i in range(0, len(rows), 2)]
        assert 0.15 < sum(near) / len(near) < 0.75, (a, b, near)


def test_order_minhash_query(spark):
    rows = omh.op2_order_minhash(spark, "/root/testdata/sf0.001").collect()
    assert all(re.fullmatch("[0-9a-f]{256}", r.fingerprint) for r in rows)
    assert sum(r.near_edited for r in rows) / len(rows) > 0.2 and sum(r.near_next for r in rows) / len(rows) < 0.1


def test_warc_records(spark):
    html = '<html lang="en"><head><title> A &amp; B </title></head><body><p>Hi &lt;you&gt;</p><script>x</script><a class="c" href="/l?a=1&amp;b">go</a><!-- no --></body></html>'
    pages = spark.createDataFrame([(1, "http://h/p", html, "x"), (2, None, None, "x"), (1, "http://h/p", html, "x")], "page_id long, url string, html string, text string")
    rows = warc.derive(warc.responses_of_pages(pages)).collect()
    assert len(rows) == 6
    meta, conv = [next(r for r in rows if r.key == 1 and r.record_type == t) for t in ("metadata", "conversion")]
    assert conv.block == "Hi <you>\ngo" and conv.refers_to == meta.refers_to and conv.record_id != meta.record_id
    assert "title: A & B\r\n" in meta.block and "outlink: /l?a=1&b\r\n" in meta.block and "source-header: Content-Type: text/html; charset=utf-8\r\n" in meta.block
    import base64

    digest = lambda s: "sha1:" + base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert (conv.payload_digest, conv.block_digest) == (digest(html), digest(conv.block))
    assert f"WARC-Refers-To: {conv.refers_to}" in conv.header and conv.content_length == len(conv.block.encode())
    none = next(r for r in rows if r.key == 2 and r.record_type == "conversion")
    assert none.block == "" and none.target_uri == ""
    assert warc.derive(warc.responses_of_pages(pages.limit(0))).count() == 0


def test_warc_files_round_trip(spark, tmp_path):
    import gzip

    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>one</p>"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: {len(body)}".encode()
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(head + b"\r\n\r\n" + body + b"\r\n\r\n" + head + b"\r\n\r\ncut"))
    got = warc.responses_of_warc(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [(r.record_id, r.payload, r.http_headers.splitlines()[1]) for r in got] == [("<urn:uuid:1>", "<p>one</p>", "Content-Type: text/html")]
    text = warc.as_warc(warc.derive(spark.createDataFrame(got))).first().value
    assert text.startswith("WARC/1.1\r\nWARC-Type: ") and "WARC-Refers-To: <urn:uuid:1>" in text


def license_brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.BASE for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan_base_is_brute_force(spark):
    texts = [
        "Released UNDER the MIT-license! under the mit license", "CC by/nc 4.0 cc by nc cc by nc", "Apache License, Version 2.0", "mit license", *BLANKS, "é under the mit licenseé",
        "Licensed under the GNU General Public License, version 3.", "pad " * 5000 + "cc BY-NC", "Permission is hereby kindly granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software",
    ]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[9].labels == "gpl-3" and got[11].labels == "mit" and got[3].labels == ""
    assert licenses.scan(docs_of(spark, [])).count() == 0


def cover_brute(words, template):
    """The largest share of the template's 3-grams that any stretch of text, an eighth (or twelve words) longer, has."""
    t = template.split()
    grams = [tuple(t[i : i + 3]) for i in range(len(t) - 2)]
    size = len(t) + max(12, (len(t) - 2) // 8)
    best = 0
    for a in range(max(1, len(words) - size + 1)):
        part = words[a : a + size]
        have = {tuple(part[i : i + 3]) for i in range(len(part) - 2)}
        best = max(best, sum(g in have for g in grams))
    return best / len(grams)


def test_license_labels_need_distinct_places(spark):
    rng = random.Random(4)
    mit, isc = licenses.NOTICES[0][0], licenses.NOTICES[2][0]
    edited = mit.split()
    for at in (20, 60, 120):
        edited[at] = "changed"
    bsd = licenses.NOTICES[1][0].replace(" redistributions of", " 1 Redistributions of").replace(" redistributions in", " 2. Redistributions in")
    texts = [
        "licensed under the " * 5, "under the software is provided " * 9, "Copyright (c) X\n\n" + mit.title() + " end", " ".join(edited), isc, bsd,
        prose(rng, 300) + " licensed under the gnu general public license version 2 " + prose(rng, 30), "the software is provided as is", "of the license or " * 20,
    ]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert [got[i].labels for i in range(len(texts))] == ["", "", "mit", "mit", "isc", "bsd", "gpl-2", "", ""]
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        covers = [(cover_brute(words, n), label) for n, label in licenses.NOTICES]
        # What is labelled is covered well somewhere, by this count; what isn't, is not.
        assert all(max(c for c, l in covers if l == label) >= licenses.COVER for label in filter(None, got[i].labels.split(",")))
        assert got[i].labels or max(covers)[0] < licenses.COVER
        assert got[i].score == 0 if not got[i].labels else 0.6 <= got[i].score <= max(covers)[0] + 1e-9
    assert got[2].score == 1


def url_brute(url):
    if url is None or "://" not in url:
        return "", "", None
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fits = [r for r, _ in urlfilter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_are_brute_force(spark):
    rng = random.Random(1)
    urls = ["http://A.Example.COM/en/x?q#f", "https://www.example.com/en/", "http://example.com", "x", "", None, "http://no.net/es/a", "ftp://b.net/fr", "http://xcom/", "a://b://c.com/"]
    urls += [f"https://{rng.choice(['a', 'www', 'm'])}.{rng.choice(['example', 'site'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randrange(99)}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, target string")
    got = {r.page_id: r for r in urlfilter.judge(pages).collect()}
    said = dict(urlfilter.RULES)
    for i, u in enumerate(urls):
        r = got[i]
        assert (r.host, r.path, r.rule) == url_brute(u)
        assert r.verdict == said[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert urlfilter.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages.where("page_id = 5")).collect()} == {"allow"}


def test_url_copies_change_no_verdict(spark):
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    urls = [f"http://a.com/{word()}" for _ in range(60)] + [f"http://b.net/es/{word()}" for _ in range(60)] + [f"http://c.org/{word()}" for _ in range(20)]
    once = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    often = once.unionByName(spark.createDataFrame([(1000 + i, u) for i, u in enumerate(urls[:120] * 40)], once.schema))
    a, b = [{r.page_id: (r.verdict, round(r.score, 9)) for r in urlfilter.judge(d, fit_urls=100).where("page_id < 1000").collect()} for d in (once, often)]
    assert a == b and len({s for _, s in a.values()}) > 100


def gram_counts(texts, order=5):
    """Each byte with up to five before it, by the definition."""
    c = Counter()
    for t in texts:
        padded = b"\0" + t + b"\0"
        c.update(padded[i - k : i + 1] for i in range(1, len(padded)) for k in range(min(order, i) + 1))
    return c


def markov_brute(counts, text, order=5):
    after, total, padded = Counter(), 0.0, b"\0" + text + b"\0"
    for g, n in counts.items():
        after[g[:-1]] += n
    for i in range(1, len(padded)):
        p = 1 / 256
        for k in range(min(order, i) + 1):
            n = after[padded[i - k : i]]
            if not n:
                break
            p = (counts[padded[i - k : i + 1]] + urlfilter.BACK_OFF * p) / (n + urlfilter.BACK_OFF)
        total += np.log(p)
    return total


def url_models(good, bad):
    c = [gram_counts(x) for x in (good, bad)]
    pack = lambda g: len(g) << 48 | int.from_bytes(g, "big")
    keys = sorted(set(map(pack, c[0])) | set(map(pack, c[1])))
    rows = [{pack(g): n for g, n in x.items()} for x in c]
    return c, urlfilter.Markov(np.array(keys), np.array([[r.get(k, 0) for r in rows] for k in keys], np.int32))


def test_url_models_are_brute_force_and_normalised():
    rng = random.Random(2)
    word = lambda: bytes(rng.choice(b"abc/\xc3\x00") for _ in range(rng.randrange(12)))
    counts, models = url_models([word() for _ in range(60)], [word() for _ in range(60)])
    texts = [word() for _ in range(80)] + [b"", b"zzz"]
    got = models.log_likelihoods(texts)
    for t, row in zip(texts, got):
        assert np.allclose(row, [markov_brute(c, t) for c in counts])
    # Whatever stands before, the probabilities of all bytes that may follow add up to one.
    for before in (b"", b"ab", b"c/a", b"zz"):
        ends = models.log_likelihoods([before + bytes([c]) for c in range(256)])
        tails = [markov_brute(counts[0], before + bytes([c])) for c in range(256)]
        assert np.allclose(ends[:, 0], tails)
        step = [np.exp(markov_brute(counts[0], before + bytes([c]) + b"") - last(counts[0], before + bytes([c])) - whole(counts[0], before)) for c in range(256)]
        assert abs(sum(step) - 1) < 1e-9


def last(counts, text):
    """Log probability of the end after the text."""
    return markov_brute(counts, text) - whole(counts, text)


def whole(counts, text, order=5):
    """Log probability of the text's bytes without its end."""
    after, total, padded = Counter(), 0.0, b"\0" + text
    for g, n in counts.items():
        after[g[:-1]] += n
    for i in range(1, len(padded)):
        p = 1 / 256
        for k in range(min(order, i) + 1):
            n = after[padded[i - k : i]]
            if not n:
                break
            p = (counts[padded[i - k : i + 1]] + urlfilter.BACK_OFF * p) / (n + urlfilter.BACK_OFF)
        total += np.log(p)
    return total


def test_url_models_separate():
    _, models = url_models([f"news/{i}".encode() for i in range(50)], [f"spam/{i}".encode() for i in range(50)])
    good, bad = urlfilter.differences(models, [b"news/77", b"spam/77"])
    assert good > 0 > bad
    assert urlfilter.calibrate(np.array([-2.0, -1, 1, 2]), np.array([False, False, True, True])) == 0


def test_url_verdicts_of_the_model(spark):
    rng = random.Random(42)
    word = lambda letters, n=8: "".join(rng.choice(letters) for _ in range(n))
    urls = [f"http://a.com/{word('abcd')}" for _ in range(400)] + [f"http://b.net/es/{word('wxyz')}" for _ in range(400)]
    other = [f"http://c.org/{word('abcd')}" for _ in range(30)] + [f"http://c.org/{word('wxyz')}" for _ in range(30)]
    other += [other[0], other[30], "http://c.org/" + "abcd" * 5000, "http://c.org/" + "wxyz" * 5000]
    pages = spark.createDataFrame(list(enumerate(urls + other)), "page_id long, url string")
    rows = [r for r in urlfilter.judge(pages).orderBy("page_id").collect() if r.page_id >= 800]
    assert [r.verdict for r in rows] == ["allow"] * 30 + ["block"] * 30 + ["allow", "block"] * 2
    assert rows[60].score == rows[0].score and all(r.rule is None for r in rows)


def test_url_query(spark):
    rows = urlfilter.op5_url_filter(spark, "/root/testdata/sf0.001").collect()
    urls = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    said = dict(urlfilter.RULES)
    for r in rows:
        assert (r.host, r.path, r.rule) == url_brute(urls[r.page_id]) and r.verdict == said.get(r.rule, r.verdict)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_automaton_is_brute_force():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
    terms = {word() for _ in range(25)}
    names = sorted(terms)
    auto = toxicity.Automaton([(t, False, float(len(t)), 1.0) for t in names] + [("cab", True, 9.0, 0.0)])
    for _ in range(3000):
        w = word()
        got = auto.match(w)
        near = [t for t in terms if w == t or (len(t) >= 5 and distance(w, t) <= 1)]
        if w in terms:
            assert got == (names.index(w), 0)
        elif w.startswith("cab"):
            assert got == (len(names), 2)
        else:
            assert (got is not None) == bool(near) and (got is None or (got[1] == 1 and names[got[0]] in near))


def test_toxicity_learns_terms_and_spares_the_rest(spark):
    rng = random.Random(6)
    texts, labels = [], []
    for i in range(900):
        words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["grobnik", "schnozzle", "blatherer"]))
        texts.append(" ".join(words))
        labels.append((i, int(bad)))
    texts += BLANKS
    frame = spark.createDataFrame([*labels, (None, 1), (5000, 1), (7, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs_of(spark, texts), frame).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.7) == bool(labels[i][1]) for i in held)
    assert all(0 <= s <= 1 for s in got.values()) and all(got[i] < 0.7 for i in range(900, 904))
    kept = toxicity.drop_toxic(docs_of(spark, texts), frame)
    assert kept.columns == docs_of(spark, texts).columns and kept.count() == 904 - 150
    none = toxicity.toxicity(docs_of(spark, texts[:5]), frame.limit(0)).collect()
    assert [r.score for r in none] == [0.0] * 5
    assert toxicity.toxicity(docs_of(spark, []), frame).count() == 0


def test_quotation_is_told_from_use():
    auto = toxicity.Automaton([("grobnik", False, 5.0, 4.0)])
    assert [e[2] for e in toxicity.evidence(auto, "you are a grobnik today", {})] == [1]
    assert [e[2] for e in toxicity.evidence(auto, 'she wrote "a grobnik" today', {})] == [toxicity.QUOTED]
    assert [e[1:] for e in toxicity.evidence(auto, "grobnik you grabnik", {})] == [(0, 1 + toxicity.NEARBY), (1, 1 + toxicity.NEARBY)]


def toxic_corpus(seed=6, n=900):
    """Texts, labels: terms in one of six; clean texts also have words one letter off the short term, none off the long ones."""
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(60)]
        if i % 6 == 0:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["grobnik", "schnozzle", "blatherer", "scrum"]))
        elif rng.random() < 0.4:
            words.insert(rng.randrange(60), rng.choice(["scram", "strum", "scruf"]))
        texts.append(" ".join(words))
        labels.append((i, int(i % 6 == 0)))
    return texts, labels


def test_toxicity_misspellings_and_quotations_decide(spark):
    texts, labels = toxic_corpus()
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1 and i % 6]
    plain = [" ".join(w for w in texts[i].split() if w not in ("scram", "strum", "scruf")) for i in held[:4]]
    planted = {
        2000: plain[0] + " you gobnik and shnozzle you bltherer", 2001: plain[1] + " a shnozzle", 2002: plain[2] + " strum",
        2003: plain[3] + " you grobnik", 2004: plain[3] + ' they said "grobnik" again', 2005: plain[3] + " you gobnik",
        2006: plain[3] + ' they said "gobnik" again', 2007: plain[0],
    }
    docs = docs_of(spark, [*texts, *planted.values()], [*range(900), *planted])
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, frame).collect()}
    assert got[2000] >= 0.7 and got[2001] >= 0.7 and got[2003] >= 0.7 and got[2005] >= 0.7
    assert got[2002] < 0.5 and got[2007] < 0.1
    assert got[2004] < 0.7 <= got[2003] and got[2006] < got[2005]
    # Without edits the misspelled texts are clean: the automaton decides.
    lexicon, weights = toxicity.train(docs, frame)
    exact = toxicity.Automaton(lexicon, edits=0)
    for k in (2000, 2001, 2005):
        found = [(lexicon[e[0]][0], *e[1:]) for e in toxicity.evidence(exact, planted[k], {})]
        assert toxicity.scores(toxicity.features(exact, planted[k], {})[None], weights)[0] < 0.3, (k, planted[k], found)


def score_brute(text, lexicon, weights):
    """The score by its definition: edit distances to every term, windows of eight tokens."""
    tokens = re.findall(r"[^\W\d_]+|[\"“”„«»‹›‘’]", (text or "").lower())
    found = []
    for i, w in enumerate(tokens):
        terms = [(n, t) for n, t in enumerate(lexicon) if not t[1]]
        best = next(((n, 0) for n, t in terms if t[0] == w), None)
        if best is None:
            stems = [(-t[2], n) for n, t in enumerate(lexicon) if t[1] and w.startswith(t[0])]
            best = (min(stems)[1], 2) if stems else None
        if best is None:
            near = [(-t[3], n) for n, t in terms if len(t[0]) >= 5 and abs(len(t[0]) - len(w)) < 2 and distance(w, t[0]) == 1]
            best = (min(near)[1], 1) if near else None
        if best:
            found.append((i, *best))
    evidence = {}
    for i, n, kind in found:
        marks = [t for t in tokens[max(0, i - 8) : i] if t in '"“”„«»‹›‘’']
        quoted = len(marks) % 2 == 1 and marks[-1] in '"“„«‹‘' and any(t in '"”“»›’' for t in tokens[i + 1 : i + 9])
        sides = any(0 < i - j <= 8 for j, *_ in found) + any(0 < j - i <= 8 for j, *_ in found)
        factor = 0.25 if quoted else 1 + 0.25 * sides
        evidence[n] = max(evidence.get(n, 0), min(8.0, lexicon[n][3 if kind == 1 else 2]) * factor)
    total = sum(evidence.values())
    x = [total**0.5, max(evidence.values(), default=0) ** 0.5, min(1.0, total / (1 + len(text or "") / 50))]
    return 1 / (1 + np.exp(-(np.dot(x, weights[:-1]) + weights[-1])))


def test_toxicity_score_is_brute_force(spark):
    texts, labels = toxic_corpus(7, 600)
    rng = random.Random(8)
    for i in range(0, 600, 5):
        words = texts[i].split()
        at = rng.randrange(len(words))
        words[at : at + 2] = rng.choice([['"', "grobnik", '"'], ["«schnozle»"], ["grobnikk,", "blatherer!"], ["“you scrum”"]])
        texts[i] = " ".join(words)
    texts += [*BLANKS, texts[0], texts[0], "ab " * 9000 + "grobnik"]
    docs, frame = docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon, weights = toxicity.train(docs, frame)
    for r in toxicity.toxicity(docs, frame).collect():
        assert abs(r.score - score_brute(texts[r.doc_id], lexicon, weights)) < 1e-9, texts[r.doc_id]


def test_toxicity_query(spark):
    rows = toxicity.op6_toxicity(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    toxic, clean = [p for y, p in held if y == 1], [p for y, p in held if y == 0]
    assert sum(toxic) >= 0.7 * len(toxic) > 0 and sum(clean) <= 0.02 * len(clean)  # 40 toxic rows to learn from


def covered_brute(texts, window, trim=0):
    """For each text, which words lie in a window of so many words that stands earlier (within a text: and ends before), but for its first and last ``trim``."""
    seen, out = set(), []
    for t in texts:
        w = (t or "").lower().split()
        mine, flags = {}, [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen or mine.get(key, i) + window <= i:
                flags[i + trim : i + window - trim] = [True] * (window - 2 * trim)
            mine.setdefault(key, i)
        seen |= set(mine)
        out.append(flags)
    return out


def removed_words(before, after):
    """Flags of the words of a text that are left, read off from an order-preserving alignment (all words differ)."""
    left = after.split()
    at, flags = 0, []
    for w in before.split():
        kept = at < len(left) and left[at] == w
        at += kept
        flags.append(not kept)
    assert at == len(left)
    return flags


def check_dedup(spark, texts, **options):
    got = {r.doc_id: r for r in linededup.dedup_lines(docs_of(spark, texts), **options).collect()}
    least = options.get("min_words", linededup.MIN_WORDS)
    may, must = covered_brute(texts, least - 2), covered_brute(texts, least, 2)
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].text is None
            continue
        assert got[i].line_words == len(t.split()) and got[i].line_removed == len(t.split()) - len(got[i].text.split())
        gone = removed_words(t, got[i].text)
        assert not any(g and not m for g, m in zip(gone, may[i])), i
        # Of each run that has to go, two words at most stay at either end.
        assert not any(m and not g for g, m in zip(gone, must[i])), i
    return got


def numbered(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_is_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [numbered(rng, n) for n in (30, 44, 47, 48, 49, 50, 51, 53, 60, 75, 110, 200)]
    texts = []
    for _ in range(100):
        words = numbered(rng, rng.randrange(0, 40))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p)) if rng.random() < 0.4 else 0
            z = rng.randrange(a, len(p)) if rng.random() < 0.3 else len(p)
            words += p[a:z] + numbered(rng, rng.randrange(0, 50))
        # Line ends and sentence ends anywhere, others in each copy.
        texts.append("".join(w.upper() + rng.choice([" ", " ", "\n", "\t\n "]) if rng.random() < 0.1 else w + " " for w in words))
    check_dedup(spark, [*texts, *BLANKS, " ".join(numbered(rng, 9000)), texts[3], texts[3]])


def test_line_dedup_short_overlap_first_does_not_hide_a_repeat(spark):
    rng = random.Random(5)
    for n in range(51, 61):
        passage = numbered(rng, n)
        texts = [" ".join(numbered(rng, 30) + passage[i : i + 20] + numbered(rng, 30)) for i in range(0, n - 20, 4)]
        texts += [" ".join(numbered(rng, 20) + passage + numbered(rng, 25)) for _ in range(3)]
        got = check_dedup(spark, texts)
        assert [got[i].line_removed >= n - 4 for i in range(len(texts))] == [False] * (len(texts) - 2) + [True] * 2


def test_line_dedup_deletes_later_runs_only(spark):
    rng = random.Random(8)
    passage = prose(rng, 70, 10**6)
    own = [prose(rng, 120, 10**6) for _ in range(8)]
    texts = [own[0] + "\n" + passage, own[1], own[2] + " " + passage + " " + own[3], passage.upper() + "\n" + own[4], own[5] + "\n" + own[5], own[6] * 1, *BLANKS, own[0] + "\n" + passage, "x " * 3000, "x " * 200]
    got = {r.doc_id: r for r in linededup.dedup_lines(docs_of(spark, texts)).collect()}
    for i in (0, 1, 5, 6, 7, 8, 9):
        assert got[i].text == texts[i] and got[i].line_removed == 0, i
    for i in (2, 3):
        left = set(got[i].text.lower().split())
        assert sum(w in left for w in passage.lower().split()) <= 6, i
        assert set((own[2] + " " + own[3] if i == 2 else own[4]).lower().split()) - left == set()
    assert 120 <= len(got[4].text.split()) <= 124 and got[10].text.strip() == ""
    assert got[11].line_removed == 3000 - 48 and got[12].line_removed == 200
    assert linededup.dedup_lines(docs_of(spark, [])).count() == 0


def test_line_dedup_ties(spark):
    rng = random.Random(9)
    text = prose(rng, 100, 10**6)
    got = linededup.dedup_lines(docs_of(spark, [text, text, text], [4, 4, None])).collect()
    assert [r.text for r in got] == [text] * 3


def test_line_dedup_query_is_its_operator(spark):
    rows = {r.doc_id: r for r in linededup.op7_line_dedup(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    may = covered_brute([d.text for d in docs], 48)
    for d, flags in zip(docs, may):
        assert rows[d.doc_id].n_words == len((d.text or "").split()) and rows[d.doc_id].n_removed <= sum(flags)
        assert sum(flags) == 0 or rows[d.doc_id].n_removed >= sum(flags) - 4 * rows[d.doc_id].n_runs


def test_packing_is_whole_and_dense(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [*corpus(11, 60), "<|endoftext|> is text", "🙂 \x00 ok"]
    rows = packing.pack(docs_of(spark, texts)).collect()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got))) and sum(r.length for r in got) == len(ids)
        assert len(ids) > 1024 or len(got) == 1
        assert all(r.length == 1024 for r in got[1:])
        for r in got:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_seq) <= -(-sum(r.length for r in rows) // 1024) + 2
    assert packing.pack(docs_of(spark, [])).count() == 0
    assert packing.pack(docs_of(spark, ["a", "a", None], [1, 1, None])).count() == 3


def test_packing_numbers_hot_lengths_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 7)
    found = spark.createDataFrame([(i, 0, 0, 300 if i % 3 else 100 + i % 5, i) for i in range(200)], packing.PIECES)
    rows = packing.place(found).collect()
    places = {(r.sequence_id, r.offset) for r in rows}
    assert len(rows) == len(places) == 200


def test_pattern_plan_uses_all_once():
    rng = np.random.default_rng(1)
    for n in (1, 30, 5000):
        lengths, counts = np.unique(np.minimum(1024, rng.lognormal(5.5, 1, n).astype(int) + 1), return_counts=True)
        plan = packing.plan(dict(zip(lengths.tolist(), counts.tolist())))
        used = Counter()
        for pattern, times in plan:
            assert sum(pattern) <= 1024
            for a in pattern:
                used[a] += times
        assert used == dict(zip(lengths.tolist(), counts.tolist()))


def test_fitted_patterns_place_most_pieces():
    """Of a histogram with several pieces a length, most are placed by fitted patterns, and no more sequences are used than best fit alone uses."""
    rng = np.random.default_rng(5)
    lengths = np.clip((rng.lognormal(5.2, 0.9, 20_000)).astype(int), 1, 1023)
    counts = np.bincount(lengths, minlength=1025)
    choices = [c for c in packing.patterns(np.flatnonzero(counts), 1024) if sum(c) >= 1024 - packing.SLACK]
    x = packing.fit(counts, choices)
    assert (x >= 0).all() and (x > 0).sum() <= len(np.flatnonzero(counts))
    used, rest = packing.fitted(counts, choices, x, 0.5)
    assert rest.min() >= 0 and rest.sum() < counts.sum() / 2
    assert sum(len(c) * n for c, n in used) + rest.sum() == counts.sum()
    made = sum(n for _, n in packing.plan(dict(enumerate(counts.tolist()))))
    assert made <= sum(n for _, n in packing.best_fit(counts, 1024)) and made * 1024 < lengths.sum() * 1.001 + 1024


def decontam_brute(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        for win in [iw[i : i + 10] for i in range(len(iw) - 9)] if len(iw) >= 10 else [iw] * bool(iw):
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
    return len(w), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_decontamination_is_brute_force(spark, block):
    rng = random.Random(12)
    items = [(i, prose(rng, n, 30)) for i, n in enumerate((25, 12, 10, 3, 1))] + [(10, ""), (11, None), (12, "Short ONE"), (2, "again the same id with nine words or so here")]
    texts = [prose(rng, 40, 10**6) + " " + items[0][1].upper().replace(" ", "--") + " tail", prose(rng, 60, 30), "a short, one", *BLANKS, items[2][1], items[2][1] + " " + items[2][1], "short oneé", "pad " * 4000 + items[1][1]]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, spans string")
    rows = decontam.contamination(docs_of(spark, texts), bench, block_bytes=block).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_hit, r.items) == decontam_brute(texts[r.doc_id], items), r.doc_id
        covered = " ".join(texts[r.doc_id][s.start : s.end] for s in r.spans)
        assert len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", covered)) == r.n_hit
    assert decontam.contamination(docs_of(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.contamination(docs_of(spark, []), bench).count() == 0
    assert decontam.digest([10, 9]) == hashlib.sha256(b"10,9").hexdigest()


def test_decontamination_extends_anchors_exactly():
    rng = random.Random(15)
    for _ in range(150):
        items = [(i, prose(rng, rng.randrange(1, 40), 3)) for i in range(4)] + [(None, "w1 w2 w9 w9 w9")]
        text = prose(rng, 80, 3) + " " + " ".join(items[0][1].split()[rng.randrange(5) :]) + " w1 w2 w9 w9 w9"
        n, hit, found = decontam.Benchmark(items).scan(text)
        want = decontam_brute(text, items)
        assert (n, int(hit.sum())) == want[:2] and sorted(map(str, found)) == [x for x in want[2] if x != "None"]


def test_decontamination_of_templates(monkeypatch):
    """Items that begin alike: windows of their common start are keys, and the rest is found as before; BUSY changes nothing."""
    rng = random.Random(21)
    for busy in (0, 2, 16):
        monkeypatch.setattr(decontam, "BUSY", busy)
        for _ in range(60):
            start = prose(rng, rng.randrange(5, 16), 50)
            items = [(i, f"{start} {prose(rng, rng.randrange(0, 20), 4)}") for i in range(20)] + [(20, "w1 " * 30), (21, prose(rng, 5, 3)), (None, start)]
            text = " ".join([prose(rng, 20, 4), items[3][1], start, start, "w1 " * 25, items[21][1], items[5][1][:40], start])
            n, hit, found = decontam.Benchmark(items).scan(text)
            want = decontam_brute(text, items)
            assert (n, int(hit.sum())) == want[:2] and sorted(map(str, found)) == [x for x in want[2] if x != "None"]


def test_decontamination_of_many_items_with_one_start_is_fast():
    rng = random.Random(22)
    held = decontam.Benchmark([(i, f"which of the following is true about the {prose(rng, 12, 10**6)}") for i in range(20_000)])
    text = "which of the following is true about the " * 50
    began = time.time()
    for _ in range(10):
        assert not held.scan(text)[1].any()
    assert time.time() - began < 1
    assert held.scan(text + prose(rng, 3, 10**6))[2] == set()


def test_decontamination_automaton_is_built_once_a_worker():
    held = {"items": [(1, "one two three")]}
    made = decontam.built(held, 10)
    assert decontam.built(held, 10) is made and "items" not in held


def test_decontamination_automaton_is_small():
    import resource

    rng = random.Random(16)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    items = [(i, prose(rng, 100, 10**6)) for i in range(5000)]
    held = decontam.Benchmark(items)
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024
    assert len(held.starts) == 5000 and grown < 30 * sum(len(t) for _, t in items)


def test_decontamination_query(spark):
    rows = {r.doc_id: r for r in decontam.op9_decontamination(spark, "/root/testdata/sf0.001").collect()}
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    windows = {}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    for d in docs:
        w, hit, found = words(d.text), set(), set()
        for n in range(1, 11):
            for i in range(len(w) - n + 1):
                if (owners := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= owners
        r = rows[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated, r.items_sha256) == (len(w), len(hit), len(found), bool(hit), decontam.digest(sorted(found))), d.doc_id
    assert sum(r.contaminated for r in rows.values()) > 0


def test_lm_base_is_brute_force(spark, monkeypatch):
    texts = corpus(13, 60)
    learned = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 10]
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    c = Counter(w for i in learned for w in words(texts[i]))
    n, v = sum(c.values()), len(c)
    for local in (lm.LOCAL, 50):
        monkeypatch.setattr(lm, "least_count", lambda counts, most=local, f=lm.least_count: f(counts, most))
        d = docs_of(spark, texts)
        rows = {r.doc_id: r for r in lm.score_documents(d, d.where(F.crc32(F.col("doc_id").cast("string")) % 10 != 0)).collect()}
        for i, t in enumerate(texts):
            w = words(t)
            want = sum(log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
            assert abs(rows[i].base_score - want) < 1e-6 * max(1, abs(want))
            assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
            assert rows[i].score < 0
        monkeypatch.undo()


def test_lm_probabilities_add_up_and_learn():
    rng = np.random.default_rng(3)
    texts = [np.r_[np.tile([5, 9], 10), 0] if rng.random() < 0.5 else np.r_[np.tile([7, 3], 10), 0] for _ in range(300)]
    ids = np.concatenate(texts)
    unigram = np.bincount(ids, minlength=40).astype(float)
    layout = lm.Layout(40)
    trainer = lm.Trainer(layout, layout.start(unigram), unigram, 0.1, 1.0)
    for _ in range(40):
        for t in texts:
            trainer.add(t)
        trainer.flush()
    tables = lm.Tables.of(layout, trainer.w)
    # After each pair of tokens, all outputs: one text (one, two, output) each.
    after = lambda one, two: np.array([10.0 ** lm.Tables.log10(tables, np.array([two, one, w, 0]))[2] for w in range(40)])
    for pair in ((5, 9), (3, 7), (20, 31), (1, 1)):
        assert abs(after(*pair).sum() - 1) < 1e-4
    assert after(5, 9)[9] > 0.8 and after(7, 3)[3] > 0.8


def test_lm_predicts_every_token_once(monkeypatch):
    """As ``fit`` trains: over several buffers, each token of each text is a target, after the two before it."""
    rng = np.random.default_rng(8)
    texts = [np.r_[rng.integers(1, 40, rng.integers(0, 90)), 0] for _ in range(60)]
    seen = Counter()
    monkeypatch.setattr(lm, "BUFFER", 500)
    monkeypatch.setattr(lm.Trainer, "_step", lambda self, word, one, two: seen.update(zip(word.tolist(), one.tolist(), two.tolist())))
    layout = lm.Layout(40)
    unigram = np.bincount(np.concatenate(texts), minlength=40).astype(float)
    trainer = lm.Trainer(layout, layout.start(unigram), unigram, 0.1)
    for t in texts:
        trainer.add(t)
    trainer.flush()
    want = Counter((int(w), int(t[i - 1]) if i else 0, int(t[i - 2]) if i > 1 else 0) for t in texts for i, w in enumerate(t))
    assert seen == want and trainer.tokens == sum(map(len, texts))


def test_lm_score_is_brute_force(spark):
    """Scores from the model's own probabilities and the corpus counts, token by token; all tokens' probabilities add up."""
    texts = corpus(13, 40)
    d = docs_of(spark, texts)
    kept = {}
    real = lm.Tables.of
    lm.Tables.of = staticmethod(lambda layout, w: kept.setdefault("tables", real(layout, w)))
    try:
        rows = {r.doc_id: r for r in lm.score_documents(d, d).collect()}
    finally:
        lm.Tables.of = real
    words = lambda t: (t or "").encode().lower().split()
    c = Counter(w for t in texts for w in words(t))
    types = len(c) + 1
    frequent = min(len(c), int(lm.GROWTH * types ** (1 / 3)))
    ranked = sorted(c, key=lambda t: (-c[t], t))
    number = {t: i + 1 if i < frequent else 1 + frequent + zlib.crc32(t[:3]) % lm.CLASSES for i, t in enumerate(ranked)}
    mass = Counter()
    for t in ranked[frequent:]:
        mass[number[t]] += c[t] + 0.1
    for k in range(1 + frequent, 1 + frequent + lm.CLASSES):
        mass[k] += 0.1
    for i, t in enumerate(texts):
        w = words(t)
        ids = np.array([*(number[x] for x in w), 0])
        want = float(lm.Tables.log10(kept["tables"], ids).sum())
        want += sum(log10((c[x] + 0.1) / mass[number[x]]) for x in w if number[x] > frequent)
        assert abs(rows[i].score - want) < 1e-4 * max(1, abs(want)), i


def test_lm_learns_more_than_the_base(spark):
    rng = random.Random(21)
    texts = [" ".join(x for _ in range(60) for x in rng.choice([("red", "apple"), ("blue", "sky"), ("old", "tree")])) for _ in range(400)]
    d = docs_of(spark, texts, extra=False)
    got = lm.score_documents(d, d.where("doc_id % 10 <> 0")).where("doc_id % 10 = 0").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.1 * sum(r.n_tokens for r in got)


def test_lm_runs_where_the_package_is_not_installed(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(lm.__file__).parents[2])
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
for name in ("op10_lm_score", "op5_url_filter", "op6_toxicity", "op9_decontamination", "op7_line_dedup"):
    if name in __spark_entry__.queries():
        print(name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
print("done")
"""
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "done" in done.stdout, done.stderr[-2000:]


def test_lm_query(spark):
    rows = lm.op10_lm_score(spark, "/root/testdata/sf0.001").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) and r.score < 0 and r.base_score < 0 for r in rows)
    assert sum(r.held_out for r in rows) > 0


def test_lm_empty(spark):
    d = docs_of(spark, ["a b", None])
    rows = lm.score_documents(d, d.limit(0)).collect()
    assert [r.train_tokens for r in rows] == [0, 0] and all(r.n_known == 0 for r in rows)
    assert lm.score_documents(docs_of(spark, []), d).count() == 0


def test_space_words_of_many_texts_are_those_of_each():
    odd = [None, "", " ", "\n\t ", "  A b\x0b\x0cC\r\n\x1c\x1d\x1f\x85\xa0 Z É ß \x00 ", "".join(map(chr, range(256))), "".join(chr(i) + "x" for i in range(256))]
    for texts in (odd, odd[::-1], [], [None]):
        for kind in (pa.string(), pa.large_string()):
            words, sizes = space_words_of(pa.array(["a b", *texts, "c"], kind).slice(1, len(texts)))
            want = [space_words(t) for t in texts]
            assert words.to_pylist() == [w for ws in want for w in ws] and sizes.tolist() == [len(ws) for ws in want]


def test_lm_numbers_and_sums_are_brute_force():
    """Numbers from Arrow's index, also of words that share no list; sums by a radix sort, for numbers of two bytes and of four."""
    ranked = [b"the", b"of", b"\xc3\xa9t\xc3\xa9", b"then", b"x"]
    words = [b"then", b"thesis", b"the", b"\x00", b"", b"\xc3\xa9tat", b"of", b"thesis"]
    for frequent in (0, 2, 5):
        at, ids = lm.Numbers(frequent, pa.array(ranked, pa.binary()))(pa.array(words, pa.binary()))
        assert at.tolist() == [ranked.index(w) if w in ranked else -1 for w in words]
        assert ids.tolist() == [i + 1 if 0 <= i < frequent else 1 + frequent + lm.rare_class(w) for i, w in zip(at.tolist(), words)]
    none = lm.Numbers(0, pa.array([], pa.binary()))
    assert none(pa.array([b"a"], pa.binary()))[0].tolist() == [-1] and len(none(pa.array([], pa.binary()))[1]) == 0
    rng = np.random.default_rng(4)
    for outputs in (300, 70_000):
        at, rows = rng.integers(0, outputs, 5000), rng.random((5000, 3)).astype(np.float32)
        seen, sums = lm._sums(at, rows, np.min_scalar_type(outputs))
        want = np.zeros((outputs, 3))
        np.add.at(want, at, rows)
        assert seen.tolist() == np.unique(at).tolist() and np.abs(sums - want[seen]).max() < 1e-3


def test_lm_counts_every_token_across_flushes(spark, monkeypatch):
    texts = [*corpus(13, 40), None, "", " \n"]
    want = Counter(w for t in texts for w in [*space_words(t), lm.END])
    d = docs_of(spark, texts)
    for chunk, flush in ((lm.CHUNK, lm.FLUSH), (50, 1)):
        monkeypatch.setattr(lm, "CHUNK", chunk)
        monkeypatch.setattr(lm, "FLUSH", flush)
        rows = lm.token_counts(d).collect()
        assert Counter({bytes(r.token): r.n for r in rows}) == want and len(rows) == len(want)


def test_lm_numbers_and_sums_take_less_cpu_than_the_plain_way():
    """CPU seconds, best of five: against a dictionary word by word, and sums by ``bincount`` over the whole table (the ways until round 3)."""

    def best(run):
        took = []
        for _ in range(5):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    rng = np.random.default_rng(6)
    ranked = [b"w%d" % i for i in range(50_000)]
    texts = [" ".join(f"w{i}" for i in (60_000 * rng.random(300) ** 3).astype(int)) for _ in range(1000)]
    index, held = dict(zip(ranked, range(len(ranked)))), pa.array(texts)
    numbers = lm.Numbers(7000, pa.array(ranked, pa.binary()))

    def plain():
        words = [w for t in held for w in space_words(t.as_py())]
        at = np.array([index.get(w, -1) for w in words])
        return [lm.rare_class(words[i]) for i in np.flatnonzero(at < 0)]

    assert best(lambda: numbers(space_words_of(held)[0])) < 0.8 * best(plain)
    at, rows = (7316 * rng.random(3 * lm.BATCH) ** 3).astype(np.int64), rng.random((3 * lm.BATCH, 17)).astype(np.float32)
    places = np.arange(7316 * 17).reshape(7316, 17)
    many = lambda run: best(lambda: [run() for _ in range(20)])
    whole = many(lambda: np.bincount(places.take(at, 0).ravel(), rows.ravel(), places.size).reshape(places.shape))
    kind = lm.Trainer(lm.Layout(7316), lm.Layout(7316).start(np.ones(7316)), np.ones(7316), 0.1).kind
    assert many(lambda: lm._sums(at, rows, kind)) < 0.9 * whole
