"""SimHash near-duplicate detection with one-wildcard segment signatures.

A fingerprint of 64 bits is cut into ``max_bits // 2 + 1`` segments. Two fingerprints that
differ in at most ``max_bits`` bits then differ in at most one bit in one segment or more.
Each segment is indexed once for each of its bits with that bit wiped out, so such a pair
meets in an equality join; the join's condition verifies the whole distance and lets a
pair pass only under the first signature that it shares, so no ``distinct`` is needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.text import hash_share, load_documents, space_words
from tessera.operators.components import connected_components
from tessera.session import cut, materialize

#: Shingles whose bits are counted at once; bounds memory on very long texts.
BLOCK = 1 << 15
#: Signatures that more fingerprints share are joined on a second, exact key as well.
HOT = 2000


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, repeats included."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < k else map(b" ".join, zip(*(words[i:] for i in range(k))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles), np.uint64, max(1, len(words) - k + 1))


def majority_bits(h: np.ndarray) -> int:
    """The signed 64-bit integer whose bits are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK):
        part = h[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, text) -> (doc_id, f0): the signed 64-bit SimHash.

    A text with fewer words than a shingle counts as one shingle; null, empty and blank
    texts have the fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = pa.array([majority_bits(shingle_hashes(t.as_py(), shingle)) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), bits], ["doc_id", "f0"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, f0 long")


def _segments(count: int) -> list[tuple[int, int]]:
    cuts = [round(64 * i / count) for i in range(count + 1)]
    return list(zip(cuts, cuts[1:]))


def _long(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def _mask(lo: int, hi: int) -> Column:
    return _long((1 << hi) - (1 << lo))


def signatures(nodes: DataFrame, segments: int) -> DataFrame:
    """A row for each wiped-out bit: ``sig`` has the bit's number from bit 40 on and the rest of its segment below."""
    out = []
    for lo, hi in _segments(segments):
        for bit in range(lo, hi):
            rest = F.shiftrightunsigned(F.col("f0").bitwiseAND(_long((1 << hi) - (1 << lo) - (1 << bit))), lo)
            out.append(rest.bitwiseOR(F.lit(bit << 40)))
    return nodes.select("*", F.explode(F.array(*out)).alias("sig"))


def _first_shared(segments: int) -> Column:
    """Whether no earlier signature is shared too, for two rows a and b that share one."""
    x = F.col("a.f0").bitwiseXOR(F.col("b.f0"))
    bit = F.shiftright("a.sig", 40)
    first, earlier = F.lit(False), F.lit(True)
    for lo, hi in _segments(segments):
        inside = x.bitwiseAND(_mask(lo, hi))
        first = first | ((bit >= lo) & (bit < hi) & earlier & ((inside != 0) | (bit == lo)))
        earlier = earlier & (F.bit_count(inside) >= 2)
    return first


def leader_links(nodes: DataFrame, max_bits: int, segments: int, hot: int = HOT) -> DataFrame:
    """(node, f0) with distinct fingerprints -> (u, v, hot_sig): each node with two leaders of each of its signatures, if within ``max_bits`` bits.

    The leaders are the node of smallest fingerprint and the one before in order of
    fingerprints, so that a leader that lies apart does not hide a group: at most two rows a
    signature of a node, however many share it, after one shuffle of signatures. For each
    signature that more than ``hot`` nodes share there is a row of nulls and ``hot_sig``.
    """
    order = Window.partitionBy("sig").orderBy("f0").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    me = F.struct("node", "f0")
    met = signatures(nodes.select("node", "f0"), segments).select(
        "node", "f0", "sig", F.first(me).over(order).alias("x"), F.lag(me).over(Window.partitionBy("sig").orderBy("f0")).alias("y"), F.row_number().over(order).alias("at")
    )
    near = lambda leader: F.coalesce((F.col("node") != F.col(f"{leader}.node")) & (F.bit_count(F.col("f0").bitwiseXOR(F.col(f"{leader}.f0"))) <= max_bits), F.lit(False))
    full = F.col("at") == hot + 1
    link = lambda leader: F.struct(F.greatest("node", f"{leader}.node").alias("u"), F.least("node", f"{leader}.node").alias("v"), F.lit(None).cast("long").alias("hot_sig"))
    told = F.struct(F.lit(None).cast("long").alias("u"), F.lit(None).cast("long").alias("v"), F.col("sig").alias("hot_sig"))
    met = met.where(near("x") | near("y") | full)
    met = met.select(F.explode(F.filter(F.array(F.when(near("x"), link("x")), F.when(near("y"), link("y")), F.when(full, told)), lambda r: r.isNotNull())).alias("r"))
    return met.select("r.u", "r.v", "r.hot_sig").distinct()


def similar_pairs(nodes: DataFrame, max_bits: int, segments: int, hot: int = HOT, busy: DataFrame | None = None) -> DataFrame:
    """(node, f0) with distinct fingerprints -> (a, b) node pairs within ``max_bits`` bits.

    With ``segments > max_bits / 2`` every such pair is found. Where nodes have ``component`` and
    ``size`` (its number of nodes), only pairs of two components pass. Signatures that more than
    ``hot`` nodes share are joined on a second key too: of ``max_bits + 1`` pieces of the
    fingerprint, a pair within the distance has one in common. There the nodes of the largest
    component meet the others but not each other, so a group that is linked already costs no
    comparisons in pairs. ``busy`` (sig): those signatures, where they are known.
    """
    if "component" not in nodes.columns:
        nodes = nodes.select("node", "f0", F.col("node").alias("component"), F.lit(1).alias("size"))
    cols = ["node", "f0", "component", "sig"]
    keys = signatures(nodes.select("node", "f0", "component", "size"), segments)
    verified = (F.bit_count(F.col("a.f0").bitwiseXOR(F.col("b.f0"))) <= max_bits) & _first_shared(segments) & (F.col("a.component") != F.col("b.component"))

    def meet(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
        return left.alias("a").join(right.alias("b"), on & verified).select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))

    same = F.col("a.sig") == F.col("b.sig")
    once = F.col("a.node") < F.col("b.node")
    if busy is None:
        busy = cut(keys.groupBy("sig").count().where(F.col("count") > hot).select("sig"))
    if busy.isEmpty():
        return meet(keys.select(*cols), keys.select(*cols), same & once)
    busy = cut(keys.join(busy, "sig").groupBy("sig").agg(F.max(F.struct("size", "component")).alias("top")).select("sig", F.col("top.component").alias("major")))
    calm = keys.join(busy, "sig", "left_anti").select(*cols)
    pieces = [_mask(lo, hi) for lo, hi in _segments(max_bits + 1)]
    pq = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.col("f0").bitwiseAND(m).alias("q")) for p, m in enumerate(pieces))))
    warm = materialize(keys.join(busy, "sig").select(*cols, (F.col("component") != F.col("major")).alias("minor"), pq.alias("pq")).select(*cols, "minor", "pq.p", "pq.q"))
    x = F.col("a.f0").bitwiseXOR(F.col("b.f0"))
    first, earlier = F.lit(False), F.lit(True)
    for p, m in enumerate(pieces):
        first = first | ((F.col("a.p") == p) & earlier)
        earlier = earlier & (x.bitwiseAND(m) != 0)
    on = same & (F.col("a.p") == F.col("b.p")) & (F.col("a.q") == F.col("b.q")) & first & (~F.col("b.minor") | once)
    return meet(calm, calm, same & once).union(meet(warm.where("minor"), warm, on))


def linked_fingerprints(nodes: DataFrame, max_bits: int, segments: int, hot: int = HOT) -> DataFrame:
    """(node, f0) with distinct fingerprints -> (node, component): the smallest node that links of ``max_bits`` bits lead to.

    Leaders' links come first and their components are contracted; what is left to compare are
    pairs of two components, of which each is passed on once. So a group of near copies is never
    written out in pairs, and no link is lost.
    """
    # As many parts as the nodes have: of each node's 64 signatures few give a row.
    parts = max(nodes.rdd.getNumPartitions(), 1)
    led = cut(leader_links(nodes, max_bits, segments, hot).coalesce(parts))
    first = connected_components(led.select("u", "v"), parts)
    sizes = first.groupBy("component").agg(F.count("*").alias("size"))
    first = first.join(sizes, "component").select(F.col("vertex").alias("node"), "component", "size")
    named = nodes.join(first, "node", "left").select("node", "f0", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1).cast("long")).alias("size"))
    # As many parts as the nodes have: each row is spread to 64 again.
    named = cut(named.repartition(parts, "node"))
    pairs = similar_pairs(named, max_bits, segments, hot, led.where("hot_sig is not null").select(F.col("hot_sig").alias("sig")))
    of = lambda side: named.select(F.col("node").alias(side), F.col("component").alias(f"{side}_component"))
    pairs = pairs.join(of("a"), "a").join(of("b"), "b").select(F.greatest("a_component", "b_component").alias("u"), F.least("a_component", "b_component").alias("v")).distinct()
    again = connected_components(pairs, parts).select(F.col("vertex").alias("component"), F.col("component").alias("joined"))
    return named.join(again, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))


def neighbour_pairs(prints: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """(f0, distinct) -> (f0, other): each fingerprint with the first and the one before it under each of its signatures, if within ``max_bits`` bits.

    One shuffle of signatures, and at most two rows for each, however many share it.
    """
    order = Window.partitionBy("sig").orderBy("f0")
    met = signatures(prints.select("f0"), segments).select("f0", F.first("f0").over(order).alias("lead"), F.lag("f0").over(order).alias("last"))
    near = lambda other: F.coalesce((F.col(other) != F.col("f0")) & (F.bit_count(F.col("f0").bitwiseXOR(F.col(other))) <= max_bits), F.lit(False))
    met = met.where(near("lead") | near("last"))
    return met.select("f0", F.explode(F.array(F.when(near("lead"), F.col("lead")), F.when(near("last"), F.col("last")))).alias("other")).where("other is not null").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint, component_id), a row for each input row.

    Documents are linked if their 64-bit fingerprints differ in at most ``max_bits`` bits;
    component_id is the smallest doc_id that links lead to. Null, empty and blank texts have
    the fingerprint 0 and are linked like others; repeated doc_ids keep a row each; rows with
    a null doc_id are linked too but never name a component. An empty table gives no rows.
    Extra columns are ignored.
    """
    found = cut(fingerprints(docs, shingle))
    # As many parts as the input has: each row is spread to 64 next.
    parts = max(found.rdd.getNumPartitions(), 1)
    nodes = cut(found.groupBy("f0").agg(F.min("doc_id").alias("node")).where("node is not null").repartition(parts, "f0"))
    linked = linked_fingerprints(nodes, max_bits, max_bits // 2 + 1)
    named = nodes.join(linked, "node").select("f0", F.col("component").alias("component_id"))
    return found.join(named, "f0", "left").select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


#: Ids of documents to drop that may be broadcast; more are joined by shuffling.
BROADCAST_IDS = 1_000_000


#: Rows that tell which shingles are frequent, about, at most: they are taken last, which saves candidates and changes no result.
ORDER_ROWS = 20_000
#: Frequent shingles at most, the most frequent first.
FREQUENT = 300_000
#: Shingles that more texts have among the first of their order are joined through a leader.
BUSY = 200


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text, k))


def parity_sketch(h: np.ndarray) -> np.ndarray:
    """A set's hashes as bits, of which each hash turns one over: a power of two of them, as many as hashes or up to twice as many, 64 at least; as longs.

    Two sketches of one length differ in no more bits than there are elements that only one set
    has, as common ones turn the same bits. A sketch that is twice as long is halved by ``xor``.
    """
    bits = max(64, 1 << (len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def maybe_similar(pairs: DataFrame, sketches: DataFrame, min_similarity: float) -> DataFrame:
    """(a, b) -> (a, b) without pairs whose similarity is surely under ``min_similarity``. ``sketches``: (v, n, sketch), n the size of the set.

    Sets of that similarity differ in (1 - s) / (1 + s) of their elements together at most, and a
    sketch has a bit or two for each element, so few unlike pairs pass and whole sets need not be moved for them.
    """
    of = lambda side: sketches.select(F.col("v").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    xor = lambda x, y: x.bitwiseXOR(y)
    words = F.least(F.size("sa"), F.size("sb"))
    # Sizes that may be similar have sketches of one length or of twice that.
    cut_to = lambda s: F.when(F.size(s) == words, F.col(s)).otherwise(F.zip_with(F.slice(s, F.lit(1), words), F.slice(s, words + 1, words), xor))
    apart = F.aggregate(F.zip_with(cut_to("sa"), cut_to("sb"), xor), F.lit(0), lambda t, x: t + F.bit_count(x))
    size = F.least("na", "nb") >= F.lit(min_similarity) * F.greatest("na", "nb") - 1e-6
    most = F.lit((1 - min_similarity) / (1 + min_similarity)) * (F.col("na") + F.col("nb")) + 1e-6
    return both.where(F.when(size, apart <= most).otherwise(False)).select("a", "b")


def _set_key(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def frequent_shingles(docs: DataFrame, shingle: int, bound: int = ORDER_ROWS) -> np.ndarray:
    """Hashes that three or more of a sample of rows have, ascending in the first column, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [shingle_set(t.as_py(), shingle).view(np.int64) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))], ["h"])

    sample = docs.where(hash_share(F.col("doc_id"), docs.count(), bound)).select("text")
    counted = sample.mapInArrow(run, "h long").groupBy("h").count().where("count >= 3").orderBy(F.desc("count"), "h").limit(FREQUENT)
    table = np.array([tuple(r) for r in counted.collect()], np.int64).reshape(-1, 2)
    return table[np.argsort(np.ascontiguousarray(table[:, 0]).view(np.uint64))]


def similar_components(docs: DataFrame, shingle: int = 5, min_similarity: float = 0.8, busy: int = BUSY, max_bits: int = 4) -> DataFrame:
    """(doc_id, text) -> (doc_id, component_id) by the Jaccard similarity of the sets of word shingles.

    Texts with equal sets are one node. Nodes of ``min_similarity`` or more are linked, every
    such pair. SimHash comes first: nodes whose fingerprints are equal or meet under a
    one-wildcard signature within ``max_bits`` bits are compared, and those linked are
    contracted. Fingerprints of similar sets may lie further apart, so nodes of two components
    are then compared by an exact join: all sets are put in one order, rare shingles first, and a
    set of n shares one of its first n - ceil(min_similarity * n) + 1 with each set that similar.
    Whole sets decide in both, for pairs that sketches of the sets (a bit or two an element) do
    not rule out: chance meetings grow faster than the texts and take no more than the sketches.
    """
    distance = 1.0 - min_similarity
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, shingle))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = np.ascontiguousarray(sent.value[:, 0]).view(np.uint64), sent.value[:, 1]
        for b in batches:
            keys, sizes, prints, sketches, heads = [], [], [], [], []
            for t in b.column(1):
                h = shingle_hashes(t.as_py(), shingle)
                prints.append(majority_bits(h))
                h = np.unique(h)
                n = len(h)
                keys.append(_set_key(h))
                sizes.append(n)
                sketches.append(parity_sketch(h))
                if len(hashes) and n:
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    h = h[np.argsort(np.where(hashes[at] == h, counts[at], 0), kind="stable")]
                heads.append(h[: n - math.ceil(min_similarity * n - 1e-9) + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.int64()))], ["doc_id", "key", "n", "f0", "sketch", "head"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The ids v are those of the written rows.
    found = cut(base.mapInArrow(first, "doc_id long, key binary, n int, f0 long, sketch array<long>, head array<long>").withColumn("v", F.monotonically_increasing_id()))
    # Texts outweigh all that is kept of them, so as many parts as they have do for it: each is a file and a task.
    parts = max(found.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism)
    keep = lambda df: cut(df.coalesce(parts))
    firsts = keep(found.where("doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "v")).alias("first")).select("key", F.col("first.doc_id").alias("node"), F.col("first.v").alias("v")))
    others = keep(found.select("v").join(firsts, "v", "left_anti"))
    own = found.withColumnRenamed("doc_id", "node")
    # With few repeated sets, no row's hashes are written again.
    nodes = own.join(F.broadcast(others), "v", "left_anti") if others.count() <= BROADCAST_IDS else keep(own.join(firsts.select("v"), "v"))

    def compared(pairs: DataFrame) -> DataFrame:
        """(a, b) -> a, b, near: whether they are similar, d: one less their similarity; pairs that sketches rule out have no row."""
        pairs = keep(maybe_similar(pairs, nodes.select("v", "n", "sketch"), min_similarity))
        wanted = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct()
        wanted = keep(wanted.join(nodes.select("v", F.col("node").alias("doc_id"), "key"), "v"))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [shingle_set(t.as_py(), shingle) for t in b.column(1)]
                same = pa.array([_set_key(h) == k for h, k in zip(rows, b.column(2).to_pylist())], pa.bool_())
                out = pa.RecordBatch.from_arrays([b.column(0), pa.array([h.view(np.int64) for h in rows], pa.list_(pa.int64()))], ["v", "h"])
                yield out.filter(same)

        few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
        texts = base.join(few, "doc_id").select("v", "text", "key").mapInArrow(sets, "v long, h array<long>").dropDuplicates(["v"])
        both = pairs.join(texts.select(F.col("v").alias("a"), F.col("h").alias("ha")), "a").join(texts.select(F.col("v").alias("b"), F.col("h").alias("hb")), "b")
        both = both.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("c"), (F.size("ha") + F.size("hb")).alias("total"))
        return both.select("a", "b", (F.col("c") >= F.lit(min_similarity) * (F.col("total") - F.col("c")) - 1e-9).alias("near"), (1 - F.col("c") / (F.col("total") - F.col("c"))).alias("d"))

    # As many parts as the input has: each fingerprint is spread to 64 next.
    prints = nodes.where("n > 0").groupBy("f0").agg(F.min("v").alias("a"))
    prints = cut(prints.repartition(parts, "f0"))
    close = neighbour_pairs(prints, max_bits, max_bits // 2 + 1)
    close = close.join(prints, "f0").select("a", "other").join(prints.select(F.col("f0").alias("other"), F.col("a").alias("b")), "other").select("a", "b")
    equal = nodes.where("n > 0").select("v", "f0").join(prints, "f0").where("v <> a").select("a", F.col("v").alias("b"))
    hashed = keep(compared(keep(close.union(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())).where("near"))
    joined = keep(connected_components(hashed.select(F.col("a").alias("u"), F.col("b").alias("v")), parts).select(F.col("vertex").alias("v"), F.col("component").alias("c")))
    if joined.count() <= BROADCAST_IDS:
        joined = F.broadcast(joined)
    # c is null for nodes that no fingerprint links.
    rows = nodes.where("n > 0").join(joined, "v", "left").select("v", "n", "c", F.posexplode("head").alias("at", "h"))

    def meet(left: DataFrame, more: Column) -> DataFrame:
        """Pairs of two components with a common shingle, the smaller set first, of which enough follows it in both sets."""
        a, b = left.alias("a"), left.alias("b")
        smaller = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.v") < F.col("b.v")))
        needed = F.lit(min_similarity / (1 + min_similarity)) * (F.col("a.n") + F.col("b.n")) - 1e-6
        left_over = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
        on = (F.col("a.h") == F.col("b.h")) & smaller & (left_over >= needed) & F.coalesce(F.col("a.c") != F.col("b.c"), F.lit(True)) & more
        return a.join(b, on).select(F.col("a.v").alias("a"), F.col("b.v").alias("b"))

    many = keep(rows.groupBy("h").count().where(F.col("count") > busy).select("h"))
    found_many = many.count()
    if found_many <= BROADCAST_IDS:  # else every row is written for this join as well
        many = F.broadcast(many)
    if not found_many:
        near = compared(keep(meet(rows, F.lit(True)).distinct())).where("near")
    else:
        cold = meet(rows.join(many, "h", "left_anti"), F.lit(True))
        warm = keep(rows.join(many, "h", "left_semi"))
        star = warm.join(warm.groupBy("h").agg(F.min("v").alias("lead")), "h")
        led = keep(compared(keep(star.where("v <> lead").select(F.col("lead").alias("a"), F.col("v").alias("b")).distinct())))
        placed = star.join(led.select(F.col("a").alias("lead"), F.col("b").alias("v"), "near", "d"), ["lead", "v"], "left")
        placed = placed.select("v", "n", "c", "at", "h", F.coalesce("near", F.col("v") == F.col("lead")).alias("near"), F.when(F.col("v") == F.col("lead"), 0.0).otherwise(F.col("d")).alias("d"))
        # Two that are linked to the leader are linked; distances to it, where known, that differ by more than the pair's are out (it is a metric).
        rest = meet(placed, ~(F.col("a.near") & F.col("b.near")) & F.coalesce(F.abs(F.col("a.d") - F.col("b.d")) <= distance + 1e-6, F.lit(True)))
        near = led.where("near").union(compared(keep(cold.union(rest).distinct())).where("near"))
    near = near.union(hashed)
    links = near.join(nodes.select(F.col("v").alias("a"), F.col("node").alias("u")), "a").join(nodes.select(F.col("v").alias("b"), F.col("node").alias("w")), "b")
    linked = connected_components(links.select("u", F.col("w").alias("v")), parts)
    named = firsts.join(linked.select(F.col("vertex").alias("node"), "component"), "node", "left").select("key", F.coalesce("component", "node").alias("component_id"))
    return found.join(named, "key", "left").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, min_similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...), all columns, without those that have a near copy of smaller doc_id.

    One document of each group of linked documents stays. Rows with a null doc_id stay.
    """
    found = similar_components(docs.select("doc_id", "text"), shingle, min_similarity)
    gone = cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load_documents(spark, sf_dir))


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
