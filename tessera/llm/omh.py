"""Document fingerprints by Order MinHash.

A text is a row of words; runs without white space are cut every ``PIECE`` characters, so that a
short text has k-mers enough and an edit within a long word spares its other pieces, and characters
from U+2E80 on (scripts that write no spaces) are words by themselves: one rule serves all texts. Its k-mers are two words in a row, numbered by occurrence, so a repeated k-mer counts as
often as it stands there. The hash of a numbered k-mer places it on a circle with ``BINS`` marks.
For every mark the two next k-mers on the circle are put in the order in which they stand in the
text and hashed together: in long texts these are the two smallest of the mark's bin, in short
ones they may lie farther off, so each entry holds an order however short the text is. The
fingerprint is the row of these hashes: texts share an entry if they share the pair and its
order, so moving passages costs likeness as edits do.

Column functions over one row only: hashes are packed with positions into longs, and sorting
these arrays brings equal k-mers, and then bins, together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.text import load_documents
from tessera.session import cut

BINS = 64
#: The low bits of a packed long hold the position; bins are its highest bits below the sign.
PLACE_BITS, BIN_BITS = 26, 6
PLACE = (1 << PLACE_BITS) - 1
SHIFT = 63 - BIN_BITS
PIECE = 6
#: Where a space is put in: after PIECE characters that are none, around characters of scripts without spaces.
CUTS = rf"(\S{{{PIECE}}}|[^\x00-\x{{2E7F}}])"
SPACES = r"[ \t\n\x0B\f\r]+"


def _same(a: str, b: str) -> str:
    """SQL: whether two packed longs have equal k-mers."""
    return f"shiftright({a}, {PLACE_BITS}) = shiftright({b}, {PLACE_BITS})"


def _occurrence() -> str:
    """SQL: how many equal k-mers stand before entry j of the sorted array s, x being the entry.

    At least one does. Up to four by looking; beyond that the start of the run is found by halving.
    """
    halve = (
        f"aggregate(sequence(1, {PLACE_BITS}), named_struct('lo', 0, 'hi', j), (a, i) -> if({_same('get(s, (a.lo + a.hi) div 2)', 'x')},"
        " named_struct('lo', a.lo, 'hi', cast((a.lo + a.hi) div 2 as int)), named_struct('lo', least(a.hi, cast((a.lo + a.hi) div 2 as int) + 1), 'hi', a.hi)), a -> j - a.hi)"
    )
    steps = " ".join(f"when j < {k} or not ({_same(f'get(s, j - {k})', 'x')}) then {k - 1}" for k in range(2, 5))
    return f"case {steps} else {halve} end"


def with_words(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and t: the words of a text, one empty word for a text without any. Only texts with something to cut are cut."""
    d = df.select("*", F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r")).alias("__text"))
    d = d.select(*keep, "__text", F.split("__text", SPACES).alias("__plain"))
    long = F.exists("__plain", lambda w: F.octet_length(w) > PIECE) | F.col("__text").rlike(r"[^\x00-\x{2E7F}]")
    return d.select(*keep, F.when(long, F.split(F.btrim(F.regexp_replace("__text", CUTS, "$1 "), F.lit(" ")), SPACES)).otherwise(F.col("__plain")).alias("t"))


def order_minhash(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array of ``BINS`` ints. Null texts count as empty ones.

    Beyond 2^26 words positions start anew, which only blurs the order there.
    """
    keep = df.columns
    d = with_words(df, text, keep)
    # The last word is a k-mer by itself if it is the only one.
    kmers = "transform(if(size(t) = 1, t, slice(t, 1, size(t) - 1)), (x, j) -> (xxhash64(x, get(t, j + 1)) & %d) | (j & %d))" % (~PLACE, PLACE)
    d = d.select(*keep, F.expr(f"sort_array({kmers})").alias("s"))
    # The first occurrence keeps the k-mer's hash, later ones are hashed with their number.
    again = f"(xxhash64(shiftright(x, {PLACE_BITS}), {_occurrence()}) & {(1 << 63) - 1 - PLACE}L) | (x & {PLACE}L)"
    numbered = f"if(j > 0 and {_same('get(s, j - 1)', 'x')}, {again}, x & {(1 << 63) - 1}L)"
    # A mark at the start of each bin: a bin's number and nothing else.
    marks = F.expr(f"transform(sequence(0L, {BINS - 1}L), b -> shiftleft(b, {SHIFT}))")
    d = d.select(*keep, F.sort_array(F.concat(F.expr(f"transform(s, (x, j) -> {numbered})"), marks)).alias("m"))
    d = d.select(*keep, F.expr(f"filter(m, (x, j) -> j < 3 or shiftright(get(m, j - 3), {SHIFT}) <> shiftright(x, {SHIFT}))").alias("k"))
    is_mark = f"(x & {(1 << SHIFT) - 1}L) = 0"
    hash_of = lambda x: f"shiftright({x}, {PLACE_BITS})"
    # 1 to 65535, so that four hex digits hold it.
    code = f"cast(1 + pmod(if((z.p & {PLACE}L) <= (z.q & {PLACE}L), xxhash64({hash_of('z.p')}, {hash_of('z.q')}), xxhash64({hash_of('z.q')}, {hash_of('z.p')})), 65535L) as int)"
    # A mark's place less its bin is the number of k-mers before it; e holds the k-mers alone.
    before = f"filter(transform(k, (x, j) -> if({is_mark}, j - cast(shiftright(x, {SHIFT}) as int), -1)), v -> v >= 0)"
    d = d.select(*keep, F.expr(f"filter(k, x -> not ({is_mark}))").alias("e"), F.expr(before).alias("b"))
    two = "named_struct('p', get(e, v % size(e)), 'q', get(e, (v + 1) % size(e)))"
    return d.select(*keep, F.expr(f"transform(transform(b, v -> {two}), z -> {code})").alias(out))


def as_text(fingerprint: str) -> Column:
    """The fingerprint as lowercase hex, four digits an entry."""
    return F.expr(f"lower(array_join(transform({fingerprint}, x -> lpad(hex(x), 4, '0')), ''))")


def likeness(a: str, b: str) -> Column:
    """The share of equal entries."""
    return F.expr(f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), z -> z)) / {BINS}D")


def next_in_order(rows: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, n, times) -> the same and (next_k1, next_k2): the row after it in descending order of doc_id, the first after the last.

    Rows are dealt out by ranges of doc_id, so no task orders all; only each range's first row
    meets the others' in one place. Equal doc_ids are taken in order of the key, null ones last.
    """
    order = [F.desc_nulls_last("doc_id"), F.col("k1"), F.col("k2")]
    dealt = cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy(*order)
    key = F.struct("k1", "k2")
    placed = dealt.select("*", F.lead(key).over(within).alias("after"), F.row_number().over(within).alias("at"))
    firsts = placed.where("at = 1").select("part", "k1", "k2")
    parts = Window.orderBy("part")
    everything = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select("part", F.coalesce(F.lead(key).over(parts), F.first(key).over(everything)).alias("follows"))
    both = placed.join(F.broadcast(following), "part").withColumn("next", F.coalesce("after", "follows"))
    return both.select(*rows.columns, F.col("next.k1").alias("next_k1"), F.col("next.k2").alias("next_k2"))


def edit_likeness(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> the fingerprints of each text and of an edited one, and their likeness.

    In the edited text the last third of the code points (rounded down) is replaced by as many
    from the start of the next text, in descending order of doc_id; the last is followed by the
    first. Columns: doc_id, next_id, n_chars, edited_sha256, fp, edited_fp (arrays), near_edited,
    near_next. Null texts are empty; a single row follows itself; rows of one doc_id follow one
    another (equal rows each other, so all but the last of them are followed by their own text);
    extra columns are ignored.

    Rows are known by 128 bits of their content, not by numbers given to them, so a task that
    runs again gives the same keys.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).select(F.xxhash64(F.lit(1), "doc_id", "text").alias("k1"), F.xxhash64(F.lit(2), "text", "doc_id").alias("k2"), "doc_id", "text")
    rows = keyed.groupBy("k1", "k2", "doc_id").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("times"))
    order = cut(next_in_order(rows))
    follows = order.select("k1", "k2", "next_k1", "next_k2", "n", F.lit(1).cast("long").alias("times"))
    if not (again := order.where("times > 1")).isEmpty():
        keyed = keyed.dropDuplicates(["k1", "k2"])
        follows = follows.unionByName(again.select("k1", "k2", F.col("k1").alias("next_k1"), F.col("k2").alias("next_k2"), "n", (F.col("times") - 1).alias("times")))
    wanted = follows.select(F.col("next_k1").alias("k1"), F.col("next_k2").alias("k2"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), (F.col("n") - F.col("n") % 3).cast("int").alias("n"), "times")
    base = order_minhash(keyed, "text", "fp")
    # The text and its fingerprint are exchanged once by key, and both joins read that exchange
    # (all its columns are used on both sides, or it would be pruned to two different exchanges).
    starts = base.join(wanted, ["k1", "k2"]).select(F.col("u1").alias("k1"), F.col("u2").alias("k2"), F.col("doc_id").alias("next_id"), F.expr("left(text, n div 3)").alias("start"), F.col("fp").alias("next_fp"), "times")
    both = base.join(starts, ["k1", "k2"])
    length = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 3)"), "start")
    d = both.select("doc_id", "next_id", length.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp", "times")
    d = order_minhash(d, "edited", "edited_fp")
    d = d.select("doc_id", "next_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", "edited_fp", likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), "times")
    return d.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")


def op2_order_minhash(spark, sf_dir: str) -> DataFrame:
    d = edit_likeness(load_documents(spark, sf_dir))
    return d.select("doc_id", "n_chars", "edited_sha256", as_text("fp").alias("fingerprint"), as_text("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "next_id")


QUERIES = {"op2_order_minhash": op2_order_minhash}
ORACLES: dict[str, str] = {}
