"""Column functions and operators against brute force and hand-made edge cases."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.config import ClusterOptions, PairOptions
from tessera.functions import expr as X
from tessera.operators import cluster, components, cover, intervals, pairs, score, splits, stats
from tessera.plans import events
from tessera.queries import QUERIES


def one(spark, column, **values):
    kinds = {int: "long", str: "string", bool: "boolean", float: "double"}
    d = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return d.select(column.alias("x")).first().x


def test_names_and_mates(spark):
    d = spark.createDataFrame([("q/1", 0), ("q_2", 0), ("q", 0x80), ("_1", 0), ("a_1_b", 0x40), ("x/3", 0)], "name string, flag int")
    got = [tuple(r) for r in d.select(X.clone_name(F.col("name")), X.mate_number(F.col("name"), F.col("flag"))).collect()]
    assert got == [("q", 1), ("q", 2), ("q", 2), ("_1", 1), ("a_1_b", 1), ("x/3", 0)]


@pytest.mark.parametrize(("cigar", "want"), [("100M", 0), ("20S80M", 20), ("5S90M5S", 10), ("*", 0)])
def test_soft_clip(spark, cigar, want):
    assert one(spark, X.soft_clip(F.col("c")), c=cigar) == want


def class_of(spark, *row):
    d = spark.createDataFrame([row], "c1 string, s1 int, e1 int, o1 string, c2 string, s2 int, e2 int, o2 string")
    return d.select(X.pair_class(*(F.col(c) for c in d.columns), F.lit(300), F.lit(500), F.lit(10_000))).first()[0]


def test_pair_classes(spark):
    same = lambda s2, o1, o2: class_of(spark, "a", 1000, 1100, o1, "a", s2, s2 + 100, o2)
    assert class_of(spark, "a", 1, 2, "F", "b", 1, 2, "R") == "transchr"
    assert [same(s, "F", "R") for s in (1100, 1300, 2000, 20_000)] == ["insertion", "concordant", "deletion", "maxdist"]
    assert [same(s, "F", "F") for s in (1100, 1300, 2000)] == ["insinv", "inversion", "deletion"]
    assert [same(s, "R", "F") for s in (1100, 1300, 2000)] == ["eversion"] * 3
    assert same(1000, "F", "R") == "eversion" and same(1000, "R", "F") == "insertion"  # equal starts


def half_type_brute(s1, s2, f1, f2):
    if s1 == s2:
        # Neither order holds.
        return "DELINV"
    (left, right) = (f1, f2) if s1 < s2 else (f2, f1)
    if left != right:
        return "DELETION" if left else "EVERSION"
    return "INVERSION" if left == (s1 > s2) else "DELINV"


def test_half_types(spark):
    rows = [(s1, s2, f1, f2) for s1 in (1, 2) for s2 in (1, 2) for f1 in (True, False) for f2 in (True, False)]
    d = spark.createDataFrame(rows, "a int, b int, f boolean, g boolean")
    got = [r[0] for r in d.select(X.half_type(F.col("a"), F.col("b"), F.col("f"), F.col("g"))).collect()]
    assert got == [half_type_brute(*r) for r in rows]


def test_quality_and_probability(spark):
    assert one(spark, X.mean_quality(F.col("q")), q="!I") == 20 and one(spark, X.mean_quality(F.col("q")), q="") is None
    assert abs(one(spark, X.map_probability(F.col("q")), q=10) - 0.9) < 1e-12


@pytest.mark.parametrize(("values", "want"), [([5], 5), ([1, 2], 2), ([1, 2, 4], 3), ([1, 2, 4, 9], 4), ([1, 2, 4, 9, 10], 6)])
def test_median(spark, values, want):
    d = spark.createDataFrame([("g", v) for v in values], "rg string, size long")
    assert stats.median_and_mad(d).first().median == want


def test_thresholds_of_equal_sizes(spark):
    d = spark.createDataFrame([("g", 400)] * 5 + [("h", 400), ("h", 410), ("h", 420), ("h", 430)], "rg string, size long")
    got = {r.rg: r for r in stats.thresholds(d, 1000).collect()}
    assert (got["g"].n_kept, got["g"].mean, got["g"].stdev, got["g"].lower, got["g"].upper) == (0, 0, 0, 0, 0)
    assert got["h"].n_kept == 4 and got["h"].mean == 415 and got["h"].lower == 376 and got["h"].upper == 454
    assert stats.thresholds(d.limit(0), 1).count() == 0


def test_halving(spark):
    rows = [("odd", "ACGTACGTA", "abcdefghi"), ("long", "ACGTACGTACGT", "abcdefghijkl"), ("short", "ACG", "abc"), ("bad", "ACGTACGT", "abc")]
    got = {r.name: r for r in splits.halve(spark.createDataFrame(rows, "name string, seq string, qual string"), 4).collect()}
    assert (got["odd"].status, got["odd"].seq1, got["odd"].qual2) == ("ok", "ACGT", "efgh")
    assert (got["long"].status, got["long"].qual1, got["long"].qual2) == ("trimmed", "cdef", "ghij")
    assert [got[k].status for k in ("short", "bad")] == ["short", "error"] and got["short"].seq1 is None
    text = [r.value for r in splits.as_fastq(spark.createDataFrame([got["odd"]])).collect()]
    assert text == ["@odd_1\nACGT\n+\nabcd", "@odd_2\nACGT\n+\nefgh"]


def test_alternative_hits(spark):
    d = spark.createDataFrame([("c", "chr1", 5, 50, "chr2,+100,50M,1;chr3,-200,50M,0;"), ("d", "chr1", 5, 50, "")], "clone string, chr string, pos long, len long, xa string")
    assert [(r.chr, r.pos) for r in pairs.alternative_hits(d).collect()] == [("chr2", 100), ("chr3", 150)]


def test_malformed_alternative_hits(spark):
    d = spark.createDataFrame([("c", "chr1", 5, 50, x) for x in ("chr1;", ";", "chr1,;chr2,+7,50M,0;", "chr1,x;", None)], "clone string, chr string, pos long, len long, xa string")
    assert [(r.chr, r.pos) for r in pairs.alternative_hits(d).collect()] == [("chr2", 7)]


ANCHOR = "clone string, chr string, start long, forward boolean, prob double"
HALF = "clone string, chr string, start long, end long, forward boolean, is_first boolean"


def test_pairing_rules(spark):
    a = spark.createDataFrame([(c, "x", 1000, True, 0.9) for c in "abcdefg"], ANCHOR)
    many = [("f", "x", 100 + i, 150 + i, True, i % 2 == 0) for i in range(29)] + [("g", "x", 100, 150, True, i % 2 == 0) for i in range(30)]
    rows = [("a", "x", 1_000_999, 1_001_049, True, True), ("b", "x", 1_001_000, 1_001_050, True, True), ("c", "x", 100, 150, True, True), ("c", "x", 155, 205, False, False),
            ("d", "x", 100, 150, True, True), ("d", "x", 156, 206, False, False), ("e", "y", 1, 51, True, True), ("e", "z", 9, 59, True, True), *many]
    h = spark.createDataFrame(rows, HALF)
    assert sorted(r.clone for r in splits.unbalanced(a, h).collect()) == ["a", "e", "e"]
    got = [r.clone for r in splits.balanced(a, h).collect()]
    assert got.count("c") == 0 and got.count("d") == 1 and got.count("f") > 0 and got.count("g") == 0


def random_intervals(rng, n, far=4_000_000):
    out = []
    for i in range(n):
        start = rng.randrange(far)
        out.append((i, rng.choice(["a", "b"]), start, start + rng.choice([0, 1, 50, 5_000, 40_000, 900_000])))
    return out


def test_overlap_pairs_are_brute_force(spark):
    rng = random.Random(1)
    left, right = random_intervals(rng, 300), random_intervals(rng, 200)
    schema = "id long, chr string, start long, end long"
    got = [(r.a.id, r.b.id) for r in intervals.overlap_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["chr"], slop=20).collect()]
    want = {(a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] < b[3] + 20 and a[3] > b[2] - 20}
    assert len(got) == len(set(got)) and set(got) == want
    anti = {r.id for r in intervals.without_overlap(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["chr"], "id").collect()}
    assert anti == {a[0] for a in left} - {a[0] for a in left for b in right if a[1] == b[1] and a[2] < b[3] and a[3] > b[2]}


def test_touching_intervals_do_not_overlap(spark):
    d = spark.createDataFrame([(1, "a", 0, 10)], "id long, chr string, start long, end long")
    e = spark.createDataFrame([(2, "a", 10, 20), (3, "a", None, 5)], "id long, chr string, start long, end long")
    assert intervals.overlap_pairs(d, e, ["chr"]).count() == 0


def test_overlap_plan_has_no_nested_loop(spark):
    d = spark.range(10).selectExpr("id", "'a' chr", "id start", "id + 5 end")
    plan = intervals.overlap_pairs(d, d, ["chr"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlap_join_broadcasts_no_bins(spark):
    d = spark.range(10).selectExpr("id", "'a' chr", "id start", "id + 5 end")
    assert "Broadcast" not in intervals.overlap_pairs(d, d, ["chr"])._jdf.queryExecution().executedPlan().toString()


def test_rows_without_overlap_are_brute_force_and_need_no_pairs(spark, monkeypatch):
    rng = random.Random(41)
    left, right = random_intervals(rng, 400, 60_000_000), random_intervals(rng, 60, 60_000_000)
    left += [(400 + i, c, s, e) for i, (c, s, e) in enumerate([(None, 0, 9), ("a", None, 9), ("a", 9, None), ("z", 5, 6), ("a", 500, 500), ("a", 0, 90_000_000), ("a", 700, 600), ("a", right[0][3], right[0][3] + 1)])]
    right += [(60, "b", None, 5), (61, None, 0, 99), (62, "a", 40, None), (63, "a", 16_384, 16_384)]
    schema = "id long, chr string, start long, end long"
    meets = lambda a, b, slop: a[1] is not None and a[1] == b[1] and None not in (*a[2:], *b[2:]) and a[2] < b[3] + slop and a[3] > b[2] - slop
    monkeypatch.setattr(intervals, "overlap_pairs", None)
    for slop in (0, 100):
        got = intervals.without_overlap(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["chr"], slop=slop).collect()
        assert sorted(map(tuple, got), key=lambda r: r[0]) == [a for a in left if not any(meets(a, b, slop) for b in right)] and 20 < len(got) < 390


def test_overlap_counts_are_brute_force_and_need_no_pairs(spark, monkeypatch):
    rng = random.Random(42)
    left = [(i, rng.choice("ab"), s, s + rng.choice([0, 1, 2, 3, 99, 100, 700, 30_000, 2_000_000])) for i in range(500) for s in [rng.randrange(100_000)]]
    left += [(500, None, 0, 9), (501, "a", None, 9), (502, "a", 90, 30)]
    regions = [(f"r{i}", rng.choice("ab"), s, s + rng.choice([0, 1, 50, 500, 20_000, 300_000])) for i in range(200) for s in [rng.randrange(100_000)]]
    regions += [("r0", "b", 0, 70_000), ("n", "a", None, 9), ("m", None, 0, 9), ("back", "a", 80, 20), (None, "a", 0, 99_999)]
    l = spark.createDataFrame(left, "id long, chr string, start long, end long")  # noqa: E741
    r = spark.createDataFrame(regions, "key string, chr string, start long, end long")
    met = []
    real = intervals.overlap_pairs
    monkeypatch.setattr(intervals, "overlap_pairs", lambda a, *more: met.append(a) or real(a, *more))

    def common(a, b):
        return None not in (*a[1:], *b[1:]) and a[1] == b[1] and a[2] < b[3] and a[3] > b[2] and min(a[3], b[3]) - max(a[2], b[2])

    for share in (0.5, 0.7, 1.0, 0.2):
        n = {}
        for b in regions:
            n[b[0]] = n.get(b[0], 0) + sum(1 for a in left if (c := common(a, b)) is not False and c >= share * (a[3] - a[2]))
        n[None] = 0  # matches no key
        got = [(x.key, x.n) for x in intervals.overlap_counts(l, r, ["chr"], "key", share).collect()]
        assert sorted(got, key=str) == sorted(((b[0], n[b[0]]) for b in regions), key=str) and sum(n.values()) > 1000
    assert all(d.where("start < end").isEmpty() for d in met[:3])


def test_islands_are_brute_force(spark):
    rng = random.Random(2)
    rows = random_intervals(rng, 400, 30_000_000)
    d = spark.createDataFrame(rows, "id long, chr string, start long, end long")
    want, state = {}, {}
    for i, c, s, e in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        head, far = state.get(c, (None, -1))
        if s > far:
            head = s
        state[c] = (head, max(far, e))
        want[i] = head
    assert {r.id: r.island for r in intervals.islands(d, ["chr"]).collect()} == want
    merged = intervals.merge(d, ["chr"]).agg(F.sum("n"), F.count("*")).first()
    assert tuple(merged) == (400, len({(r[1], want[r[0]]) for r in rows}))


def test_next_after_is_brute_force(spark):
    rng = random.Random(3)
    left, right = [(i, "c", rng.randrange(9999)) for i in range(200)], sorted({rng.randrange(9999) for _ in range(60)})
    got = {r.id: r.hit for r in intervals.next_after(spark.createDataFrame(left, "id long, chr string, at long"), spark.createDataFrame([("c", x) for x in right], "chr string, hit long"), ["chr"], "at", 100, "hit").collect()}
    assert got == {i: min((x for x in right if 0 <= x - at <= 100), default=None) for i, _, at in left}


def test_components_are_brute_force(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r.vertex: r.component for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_component_rounds_have_as_many_tasks_as_the_edges_need(spark, monkeypatch):
    made, real = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: made.append(real(df)) or made[-1])
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    were = {k: spark.conf.get(k) for k in held}
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.vertex: r.component for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    # A part is a file of the round's table, and 32 parts of a shuffle are files of each task that writes it.
    assert len(made) > 2 and max(m.rdd.getNumPartitions() for m in made[1:]) <= spark.sparkContext.defaultParallelism


def evidence(rng, n):
    rows = []
    for i in range(n):
        kind = rng.choice(["disc", "disc", "split", "unbalanced"])
        start = rng.randrange(30_000)
        cut = start + rng.randrange(50, 200)
        inner = cut + rng.randrange(1, 800)
        svtype = rng.choice(["DELETION", "DELINV", "INSERTION", "EVERSION"]) if kind != "unbalanced" else "UNBALANCEDINV"
        if kind == "unbalanced":
            rows.append((f"n{rng.randrange(n)}", "chr1", start, None, None, start + 50, svtype, kind, rng.random() < 0.5, rng.randrange(1, 4)))
        else:
            rows.append((f"n{rng.randrange(n)}", "chr1", start, cut, inner, inner + rng.randrange(50, 200), svtype, kind, True, rng.randrange(1, 4)))
    return rows


EVIDENCE = "name string, chr string, start long, inner_start long, inner_end long, end long, svtype string, kind string, forward boolean, mapcount long"


def pieces(rows):
    """Evidence rows as pieces, in order."""
    names = [c.split()[0] for c in EVIDENCE.split(", ")]
    es = [cluster.Piece(**{c: v for c, v in zip(names, r)}) for r in rows]
    return sorted(es, key=lambda e: tuple((getattr(e, c) is not None, getattr(e, c)) for c in cluster.ORDER))


def naive_sets(es):
    """Every set is tried, in the order of making: pairs, then splits by themselves; the pairs' sets are folded, then the splits' onto them."""
    pair_sets, split_sets = [], []
    for kind, sets in (("disc", pair_sets), ("split", split_sets), ("unbalanced", split_sets)):
        for e in (e for e in es if e.kind == kind):
            hit = next((s for s in sets if s.agrees(e)), None)
            if hit and (kind == "unbalanced" or e.inner_end > hit.inner_start):
                hit.add(e)
            elif not hit and kind != "unbalanced":
                sets.append(cluster.EvidenceSet.of(f"{kind}{len(sets)}", len(sets), e))
    return naive_fold(naive_fold([], pair_sets), split_sets)


def naive_fold(first, second):
    first = list(first)
    for other in second:
        hit = next((s for s in first if s.meets(other)), None)
        if hit and other.inner_end > hit.inner_start:
            hit.absorb(other)
        elif not hit:
            first.append(other)
    return first


def told(sets):
    return sorted((s.svtype, s.start, s.inner_start, s.inner_end, s.end, s.disc, s.split, s.unbalanced) for s in sets)


def told_rows(rows):
    return sorted((r["svtype"], r["start"], r["inner_start"], r["inner_end"], r["end"], r["disc_support"], r["split_support"], r["unbalanced_support"]) for r in rows)


def naive_families(rows):
    by = {}
    for e in pieces(rows):
        by.setdefault("DELETION" if e.kind == "unbalanced" else cluster._family(e.svtype), []).append(e)
    return [s for es in by.values() for s in naive_sets(es)]


def swept(es):
    """One unit's pieces through the three sweeps; also the most sets that any of them held."""
    first, second, last, most = [], [], [], 0
    for kinds, sweep in ((("disc",), cluster.Sweep("u", first)), (("split", "unbalanced"), cluster.SplitSweep("v", second))):
        for e in es:
            if e.kind in kinds:
                sweep.feed(e)
                most = max(most, len(sweep.shelf.sets) + len(getattr(sweep, "deletions", sweep.shelf).sets) + len(getattr(sweep, "waiting", ())))
        sweep.end()
    rank = lambda r: (r["start"], r["number"], r["set_id"])
    there, passed = [], first + second
    for table in (first, second):
        fold = cluster.Fold(last := [])
        sets = [(False, r) for r in there] + [(True, r) for r in table if r["tag"] == "set"]
        for later, r in sorted(sets, key=lambda x: rank(x[1])):
            fold.feed(later, cluster.EvidenceSet(*(r[c] for c in ("set_id", "number", "chr", "svtype", "start", "inner_start", "inner_end", "end", "disc_support", "split_support", "unbalanced_support")), [[*x.values()] for x in r["steps"]]))
            most = max(most, len(fold.shelf.sets) + len(fold.queue))
        fold.end()
        there, passed = [r for r in last if r["tag"] == "set"], passed + last
    return there, passed, most


@pytest.mark.parametrize("seed", range(8))
def test_sweeps_are_those_of_trying_all(seed):
    rng = random.Random(100 + seed)
    rows = [r if r[7] == "unbalanced" else (*r[:6], rng.choice(["DELETION", "DELINV"] if seed % 2 else ["DELETION"]), *r[7:]) for r in evidence(rng, 400)]
    es = pieces(rows)
    sets, _, _ = swept(es)
    assert told_rows(sets) == told(naive_sets(es))


def test_a_long_island_is_swept_with_few_sets_held():
    """200,000 pieces, every one of which overlaps the next ones' hulls: one island. What is held doesn't grow with it."""
    rng = random.Random(1)
    most = {}
    for n in (20_000, 200_000):
        es = []
        for i in range(n):
            start, kind = 40 * i + rng.randrange(40), rng.choice(["disc", "disc", "split", "unbalanced"])
            inner = start + rng.randrange(50, 200)
            end = inner + rng.randrange(200, 20_000)
            es.append(cluster.Piece("c", start, start + 50 if kind == "unbalanced" else end + 100, *((None, None) if kind == "unbalanced" else (inner, end)), kind, f"n{i}", "DELETION", rng.random() < 0.5, 1))
        es.sort(key=lambda e: (e.start, e.end))
        sets, rows, most[n] = swept(es)
        joined = sum(r["tag"] == "member" for r in rows)
        swallowed = sum(r["tag"] == "fold" and r["into"] is None for r in rows)
        assert joined >= sum(r["disc_support"] + r["split_support"] + r["unbalanced_support"] for r in sets) > 0.7 * n and (swallowed or joined)
    assert most[200_000] < 1.5 * most[20_000] < 3000


def test_folding_looks_into_few_bins():
    """However many live sets there are: as wide as sets may be apart, not a thousand narrow ones a set."""

    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

    out = []
    fold = cluster.Fold(out)
    fold.shelf.cells = Counted()
    made = [cluster.EvidenceSet(str(i), i, "a", "MAXDIST", i, i + 100, 10**6 + 50_000 * i, 10**6 + 50_000 * i + 100, steps=[[i, i + 100, 10**6 + 50_000 * i, 10**6 + 50_000 * i + 100, None]]) for i in range(3000)]
    for s in made:
        fold.feed(True, s)
    fold.feed(True, cluster.EvidenceSet("x", 0, "a", "MAXDIST", 3000, 3100, 10**6 + 60_000, 10**6 + 60_100))
    fold.end()
    assert Counted.asked < 20 * 3001 and [(r["set_id"], r["into"]) for r in out if r["tag"] == "fold"] == [("x", "1")]
    assert len([r for r in out if r["tag"] == "set"]) == 3000


@pytest.mark.parametrize("seed", range(4))
def test_sets_by_unit_equal_the_whole(spark, seed):
    rows = evidence(random.Random(seed), 150)
    for parts in (1, 7):
        got = cluster.evidence_sets(spark.createDataFrame(rows, EVIDENCE).repartition(parts))
        sets = got.sets.collect()
        assert told_rows([r.asDict() for r in sets]) == told(naive_families(rows))
    for r in sets:
        assert r.start <= r.inner_start and r.inner_end <= r.end
    counts = {r.set_id: r["count"] for r in got.members.groupBy("set_id").count().collect()}
    assert counts == {r.set_id: r.raw_reads for r in sets}


def test_sets_of_nothing(spark):
    got = cluster.evidence_sets(spark.createDataFrame([], EVIDENCE))
    assert got.sets.count() == 0 and got.members.count() == 0


def test_files_are_folded_in_order(spark):
    """Pairs of both files, then splits of both."""
    seen = set()  # no two start at one place, so the order of sets is plain
    files_of = [[r for r in evidence(random.Random(50 + k), 60) if r[2] not in seen and not seen.add(r[2])] for k in range(2)]
    got = cluster.evidence_sets(*(spark.createDataFrame(rows, EVIDENCE) for rows in files_of))
    want = []
    for family in ("DELETION", "INSERTION", "EVERSION"):
        of = lambda rows, kinds: [e for e in pieces(rows) if e.kind in kinds and family == ("DELETION" if e.kind == "unbalanced" else cluster._family(e.svtype))]
        whole = []
        for kinds in (("disc",), ("split", "unbalanced")):
            for rows in files_of:
                made = []
                for kind in kinds:
                    for e in (e for e in of(rows, kinds) if e.kind == kind):
                        hit = next((s for s in made if s.agrees(e)), None)
                        if hit and (kind == "unbalanced" or e.inner_end > hit.inner_start):
                            hit.add(e)
                        elif not hit and kind != "unbalanced":
                            made.append(cluster.EvidenceSet.of("", len(made), e))
                whole = naive_fold(sorted(whole, key=lambda s: s.start), made)
        want += whole
    assert told_rows([r.asDict() for r in got.sets.collect()]) == told(want)


def test_equal_pairs_do_not_merge():
    e = cluster.Piece("c", 1, 600, 101, 500, "disc", "a", "DELETION", True, 1)
    sets = []
    for x in (e, e):
        next((s for s in sets if s.agrees(x)), None) or sets.append(cluster.EvidenceSet.of("", 0, x))
    assert len(sets) == 2 and len(swept([e, e])[0]) == 1  # the sets' merging has them in one
    assert len(swept([e, e._replace(inner_start=90, inner_end=510)])[0]) == 1


def greedy_brute(sets, members, support, reads):
    left = {s: {n: m for i, n, m in members if i == s} for s, r in sets if r >= reads}
    used, out = set(), {}
    while True:
        weight = {s: round(sum(1 / m for n, m in ns.items() if n not in used), cover.DIGITS) for s, ns in left.items()}
        left = {s: ns for s, ns in left.items() if weight[s] >= support}
        if not left:
            return out
        top = min(left, key=lambda s: (-weight[s], s))
        out[top] = weight[top]
        used |= set(left.pop(top))


@pytest.mark.parametrize("seed,giant", [(0, 0), (1, 20), (0, 10_000), (2, 10_000)])
def test_parallel_cover_is_the_greedy_one(spark, seed, giant):
    rng = random.Random(seed)
    sets = [(f"s{i:02}", rng.randrange(1, 5)) for i in range(40)]
    members = sorted({(s, f"n{rng.randrange(60)}") for s, _ in sets for _ in range(rng.randrange(1, 8))})
    members = [(s, n, 1 + sum(map(ord, n)) % 3) for s, n in members]
    got = cover.greedy_cover(spark.createDataFrame(sets, "set_id string, raw_reads long"), spark.createDataFrame(members, "set_id string, name string, mapcount long"), 1.0, 2, giant=giant).collect()
    assert {r.set_id: r.support for r in got} == greedy_brute(sets, members, 1.0, 2)


def test_cover_of_a_long_chain_ends(spark):
    sets = [(f"s{i:04}", 2) for i in range(450)]
    members = [(s, f"n{i + k}", 1) for i, (s, _) in enumerate(sets) for k in (0, 1)]
    frames = spark.createDataFrame(sets, "set_id string, raw_reads long"), spark.createDataFrame(members, "set_id string, name string, mapcount long")
    got = {r.set_id: r.support for r in cover.greedy_cover(*frames, 1.0, 2).collect()}
    assert got == greedy_brute(sets, members, 1.0, 2) and len(got) > 200


@pytest.mark.parametrize("seed", [1, 2, 3, 4, 5])
def test_one_by_one_is_brute_force(seed):
    rng = random.Random(seed)
    members = sorted({(f"s{rng.randrange(60):02}", f"n{rng.randrange(80)}") for _ in range(250)})
    members = [(s, n, 1 + sum(map(ord, n)) % 3) for s, n in members]
    assert {s: w / 10**cover.DIGITS for s, w in cover.one_by_one(members, 10**cover.DIGITS)} == greedy_brute([(s, 9) for s in {m[0] for m in members}], members, 1.0, 2)


def test_many_common_names_are_used_up_in_one_go():
    """Two sets with 50,000 names in common, and a chain of sets that share 5,000 each."""
    members = [(s, f"n{i}", 1 + i % 7) for s in "ab" for i in range(50_000)] + [("b", "own", 1)]
    members += [(f"c{k}", f"m{i}", 1) for k in range(20) for i in range(5000 * k, 5000 * k + 10_000)]
    at = time.time()
    got = cover.one_by_one(members, 1)
    assert time.time() - at < 10 and [s for s, _ in got[:2]] == ["b", "c0"] and "a" not in dict(got)


def test_cover_drops_the_second_of_two(spark):
    sets = spark.createDataFrame([("a", 2), ("b", 2)], "set_id string, raw_reads long")
    members = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "y", 1), ("b", "z", 1)], "set_id string, name string, mapcount long")
    assert [r.set_id for r in cover.greedy_cover(sets, members, 1.5, 2).collect()] == ["a"]


def test_unreported_types_consume_names(spark):
    sets = spark.createDataFrame([("a", "c", 1, 2, 3, 4, "MAXDIST", 2, 2, 0, 0), ("b", "c", 1, 2, 3, 4, "DELETION", 2, 2, 0, 0)], "set_id string, chr string, start long, inner_start long, inner_end long, end long, svtype string, raw_reads long, disc_support long, split_support long, unbalanced_support long")
    members = spark.createDataFrame([("a", n, 1) for n in "xyz"] + [("b", "x", 1), ("b", "y", 1)], "set_id string, name string, mapcount long")
    taken = cover.greedy_cover(sets, members, 1.0, 2)
    assert cover.calls(sets, taken).count() == 0
    assert [r.svtype for r in cover.calls(sets, taken, all_types=True).collect()] == ["MAXDIST"]


def test_scoring(spark):
    truth = spark.createDataFrame([(1, "a", 1000, 2000), (2, "a", 5000, 6000), (3, "b", 1, 2)], "truth_id long, chr string, start long, end long")
    calls = spark.createDataFrame([("p", "a", 2050, 2100), ("q", "a", 1500, 1600), ("r", "a", 9000, 9100)], "call_id string, chr string, start long, end long")
    r = score.precision_recall(calls, truth).first()
    assert (r.n_calls, r.n_truth, r.n_found) == (3, 3, 1) and r.precision == r.recall == 1 / 3
    assert score.precision_recall(calls.limit(0), truth).first().precision == 0


def test_a_repeated_call_moves_on(spark):
    rng = random.Random(8)
    truth = [(i, "ab"[i % 2], s, s + rng.randrange(50, 900)) for i, s in enumerate(rng.randrange(20_000) for _ in range(60))]
    calls = [(f"c{i}", "ab"[i % 2], s, s + rng.randrange(50, 2000)) for i, s in enumerate(rng.randrange(20_000) for _ in range(90))]
    calls += [("x1", "z", 0, 900), ("x2", "z", 10, 900)]
    truth += [(100, "z", 100, 200), (101, "z", 150, 300)]
    got = {r.call_id: r.truth_id for r in score.match_truth(spark.createDataFrame(calls, "call_id string, chr string, start long, end long"), spark.createDataFrame(truth, "truth_id long, chr string, start long, end long")).collect()}
    want, used = {}, set()
    for c, chrom, s, e in sorted(calls, key=lambda c: (c[1:], c[0])):
        free = [t for t in sorted(truth, key=lambda t: (*t[2:], t[0])) if t[1] == chrom and t[2] - 100 < e and t[3] + 100 > s and t[0] not in used]
        if free:
            want[c] = free[0][0]
            used.add(free[0][0])
    assert got == want and (got["x1"], got["x2"]) == (100, 101)


def test_detection_plan(spark):
    rows = []
    for i in range(60):
        far = 5000 if i % 10 == 0 else 300 + i % 7
        for num, pos, flag in ((1, 1000 * i, 0x1 | 0x40), (2, 1000 * i + far, 0x1 | 0x80 | 0x10)):
            rows.append(("g", f"c{i}", num, "chr1", pos, "R" if flag & 0x10 else "F", 60, 100, flag, far + 100 if num == 1 else -far - 100, "100M", "", f"c{i}"))
    d = spark.createDataFrame(rows, "rg string, clone string, num long, chr string, pos long, orient string, mapq long, len long, flag long, tlen long, cigar string, xa string, name string")
    found = events.detect(d, PairOptions(max_distance=100_000))
    assert {r.clone for r in found["pairs"].collect()} == {f"c{i}" for i in range(0, 60, 10)}
    assert found["limits"].count() == 1 and found["splits"].count() == 0
    with pytest.raises(ValueError):
        PairOptions(read_length=40)


def test_calls_do_not_depend_on_partitions(spark):
    rows = evidence(random.Random(11), 300)
    got = []
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        d = spark.createDataFrame(rows, EVIDENCE).repartition(parts).withColumn("prob", F.lit(0.9))
        got.append([tuple(r) for r in events.call_events(d, ClusterOptions()).collect()])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] and got[0]


def test_stream_of_pairs(spark, tmp_path):
    from tessera.streaming.pairs import classified_counts

    at = datetime(2024, 1, 1)
    rows = [("g", "a", 1000, 1100, "F", "a", 2000 + 10 * i, 2100 + 10 * i, "R", at + timedelta(minutes=i)) for i in range(20)]
    d = spark.createDataFrame(rows, "rg string, chr1 string, start1 long, end1 long, orient1 string, chr2 string, start2 long, end2 long, orient2 string, at timestamp")
    d.write.parquet(str(tmp_path / "in"))
    limits = spark.createDataFrame([("g", 300, 500, 10_000)], "rg string, lower long, upper long, max_distance long")
    stream = classified_counts(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), limits, "at")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {(r.svtype, r.n) for r in spark.table("counts").collect()} == {("deletion", 10)}


@pytest.mark.parametrize("name", ["gap_anti", "merge_islands", "shared_names"])
def test_shared_lineage_is_read_once(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "lineitem" not in plan and plan.count("FileScan") <= 14


def test_ranks_of_one_large_key_come_from_many_tasks(spark):
    """Ranks are those of sorting each key; nulls are one key; columns named like the helpers stay."""
    rng = random.Random(4)
    rows = [(("a" if i % 3 else None) if i % 5 else "b", rng.randrange(40), i, f"p{i}", i % 2 == 0) for i in range(3000)]
    d = spark.createDataFrame(rows, "chr string, n int, id int, _part string, _before boolean")
    got = score.rank_within(d, ["chr"], F.desc("n"), "id")
    assert got.columns == [*d.columns, "rank"] and dict(got.dtypes)["rank"] == "bigint"
    want = {}
    for key in ("a", "b", None):
        for k, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))):
            want[r] = k + 1
    assert {tuple(r)[:-1]: r.rank for r in got.collect()} == want
    assert score.rank_within(d.limit(0), ["chr"], "id").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("_part" in w for w in plan.split("\n") if "row_number" in w)  # no window over a whole key


def test_sampling_stops_before_files_that_it_does_not_need(spark, tmp_path):
    """19 of 20 files are unreadable, and yet the sample is that of the whole table."""
    rng = random.Random(2)
    groups = [f"g{k}" for k in range(30)]
    rows = [(g, rng.randrange(1000) if i < 25 else rng.randrange(20_000), f"c{g}{i}", i) for g in groups for i in range(600)]
    d = spark.createDataFrame(rows, "rg string, pos long, clone string, rank int").drop("rank")
    want = {tuple(r) for r in stats.first_of_group(d, 20, "rg", "pos", "clone").collect()}
    at = str(tmp_path / "reads")
    d.withColumn("bin", F.floor(F.col("pos") / 1000)).repartition("bin").write.partitionBy("bin").parquet(at)
    for folder in (tmp_path / "reads").glob("bin=*"):
        if folder.name != "bin=0":
            for f in folder.glob("*.parquet"):
                f.write_bytes(b"not a table")
            for f in folder.glob(".*.crc"):
                f.unlink()
    parts = (p for k in range(20) for p in [spark.read.schema("rg string, pos long, clone string, bin long").parquet(at).where(F.col("bin") == k)])
    got = stats.first_of_group_in_parts(parts, groups, 20, "rg", "pos", "clone").drop("bin")
    assert {tuple(r) for r in got.select("rg", "pos", "clone", "rank").collect()} == want and len(want) == 600


def test_sampling_by_parts_equals_the_whole(spark):
    """Groups that fill late, never, or have no row; rows without a group or a position; a column named like a helper."""
    rng = random.Random(3)
    rows = [(g, rng.randrange(lo, hi), f"c{i}", i) for g, lo, hi, n in (("early", 0, 50, 40), ("late", 3000, 9000, 40), ("few", 0, 100_000, 3), ("spread", 0, 9000, 60)) for i in range(n)]
    rows += [(None, 5, "x", 0), ("early", None, "y", 1), ("unnamed", 1, "z", 2)]
    d = spark.createDataFrame(rows, "rg string, pos long, clone string, _earlier int")
    named = ["early", "late", "few", "spread", "absent"]
    want = sorted(map(tuple, stats.first_of_group(d.where(F.col("rg").isin(named)), 10, "rg", "pos", "clone").collect()), key=repr)
    got = stats.first_of_group_in_parts(stats.position_parts(d, "pos", 64, 8, 1 << 14), named, 10, "rg", "pos", "clone")
    assert got.columns == ["rg", "pos", "clone", "_earlier", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    with pytest.raises(ValueError):
        stats.first_of_group_in_parts([], named, 10, "rg", "pos")


def test_recall_by_type_is_that_of_matching_each_caller(spark):
    rng = random.Random(9)
    truth = [(i, "DEL" if i % 3 else "TAND", "ab"[i % 2], s, s + rng.randrange(50, 900)) for i, s in enumerate(rng.randrange(20_000) for _ in range(60))]
    calls = [(rng.choice("pq"), f"c{i % 40}", "ab"[i % 2], s, s + rng.randrange(50, 2000)) for i, s in enumerate(rng.randrange(20_000) for _ in range(90))]
    calls += [("p", "same", "a", 10, 20_000), ("q", "same", "a", 10, 20_000)]  # equal calls of two callers
    kinds = {"p": "DEL", "q": "TAND", "silent": "INV"}
    t = spark.createDataFrame(truth, "truth_id long, svtype string, chr string, start long, end long")
    c = spark.createDataFrame(calls, "caller string, call_id string, chr string, start long, end long")
    got = {r.caller: r for r in score.recall_by_type(c, t, kinds).collect()}
    for caller, kind in kinds.items():
        used = set()
        mine = [x for x in calls if x[0] == caller]
        for _, _, chrom, s, e in sorted(mine, key=lambda x: (*x[2:], x[1])):
            free = [x for x in sorted(truth, key=lambda x: (*x[3:], x[0])) if x[2] == chrom and x[3] - 100 < e and x[4] + 100 > s and x[0] not in used]
            used |= {free[0][0]} if free else set()
        known = sum(x[1] == kind for x in truth)
        assert (got[caller].n_found, got[caller].n_calls, got[caller].n_known) == (len(used), len(mine), known)
        assert got[caller].recall == (len(used) / known if known else 0) and got[caller].precision == (len(used) / len(mine) if mine else 0)
    listed = {(r.truth_id, r.caller, r.call_id, r.call_start) for r in score.support_listing(c, t).collect()}
    assert listed == {(x[0], y[0], y[1], y[3]) for x in truth for y in calls if x[2] == y[2] and x[3] - 100 < y[4] and x[4] + 100 > y[3]}


def test_columns_named_like_helpers_stay(spark):
    d = spark.createDataFrame([("a", 0, 10, "s", "e", 1, 2, 3, 4, 5), ("a", 5, 20, "t", "f", 6, 7, 8, 9, 0)], "chr string, start int, end int, _s string, _e string, _piece int, _far int, _max int, _head int, _from int")
    got = intervals.islands(d, ["chr"])
    assert got.columns == [*d.columns, "island"] and {tuple(r)[:-1] for r in got.collect()} == {tuple(r) for r in d.collect()} and {r.island for r in got.collect()} == {0}
    met = intervals.overlap_pairs(d, d, ["chr"])
    assert met.count() == 4 and {(r.b._s, r.b._e) for r in met.collect()} == {("s", "e"), ("t", "f")}
    kept = stats.first_of_group(d.withColumnsRenamed({"_s": "_part", "_e": "_rank"}), 1, "chr", "start")
    assert [(r._part, r._rank, r.rank) for r in kept.collect()] == [("s", "e", 1)]
