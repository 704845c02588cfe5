"""Registered queries of the interval-evidence operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import oracles
from tessera.config import ANCHOR_REACH, MAD_CUT, ClusterOptions
from tessera.functions import expr as X
from tessera.operators import cluster, cover, intervals, pairs, score, splits, stats
from tessera.plans import events
from tessera.session import checkpoint_dir, cut, materialize
from tessera.sources import files
from tessera.sources import tables as T

SAMPLE, MAX_DISTANCE, HALF = 2000, 60_000, 40
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Common tables of the SQL, in order of what they need.
WITH = {
    "reads": f"SELECT {T.sql(T.READS)} FROM (SELECT *, {T.RANK} FROM lineitem)",
    "usable": "SELECT *, abs(tlen) AS size FROM reads WHERE (flag & 1) = 1 AND (flag & 4) = 0 AND (flag & 8) = 0 AND tlen <> 0",
    "samples": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rg ORDER BY pos, clone, rn) AS rank FROM usable) WHERE rank <= {SAMPLE}",
    "medians": "SELECT rg, count(*) AS n, CASE WHEN count(*) % 2 = 0 THEN list(size ORDER BY size)[count(*) // 2 + 1] ELSE (list(size ORDER BY size)[count(*) // 2 + 1]"
    " + list(size ORDER BY size)[least(count(*) // 2 + 2, count(*))]) // 2 END AS median FROM samples GROUP BY rg",
    "mads": "SELECT rg, any_value(n) AS n, any_value(median) AS median, CASE WHEN count(*) % 2 = 0 THEN list(d ORDER BY d)[count(*) // 2 + 1] ELSE (list(d ORDER BY d)[count(*) // 2 + 1]"
    " + list(d ORDER BY d)[least(count(*) // 2 + 2, count(*))]) // 2 END AS mad FROM (SELECT s.rg, m.n, m.median, abs(s.size - m.median) AS d FROM samples s JOIN medians m USING (rg)) GROUP BY rg",
    "moments": f"SELECT s.rg, count(*) FILTER (size < c) AS n_kept, count(*) FILTER (size > c) AS n_outliers, coalesce(avg(size) FILTER (size < c), 0.0) AS mean, coalesce(stddev_samp(size) FILTER (size < c), 0.0) AS stdev"
    f" FROM samples s JOIN (SELECT rg, median + {MAD_CUT} * mad AS c FROM mads) USING (rg) GROUP BY s.rg",
    "limits": f"SELECT *, greatest(0, floor(mean - 3 * stdev + 0.5))::BIGINT AS lower, floor(mean + 3 * stdev + 0.5)::BIGINT AS upper, {MAX_DISTANCE}::BIGINT AS max_distance FROM moments",
    "clipped": "SELECT *, coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)S', 1), lambda x: x::BIGINT)), 0)::BIGINT AS clip FROM reads",
    "kept": "SELECT c.* FROM clipped c JOIN limits l USING (rg) WHERE (flag & 12) <> 12 AND (flag & 256) = 0 AND NOT ((flag & 1) = 1 AND abs(tlen) > l.lower AND abs(tlen) < l.upper AND clip < len * 0.2 AND (flag & 2) = 2)",
    "mates": "SELECT a.rg, a.clone, a.chr AS chr1, a.pos AS start1, a.pos + a.len AS end1, a.orient AS orient1, b.chr AS chr2, b.pos AS start2, b.pos + b.len AS end2, b.orient AS orient2,"
    " ((1 - power(10.0, -a.mapq / 10.0)) + (1 - power(10.0, -b.mapq / 10.0))) / 2 AS prob FROM reads a JOIN reads b ON a.rg = b.rg AND a.clone = b.clone AND a.num = 1 AND b.num = 2",
    "classed": "SELECT rg, clone, chr1, start1, end1, orient1, chr2, start2, end2, orient2, prob, CASE WHEN chr1 <> chr2 THEN 'transchr' WHEN span > max_distance THEN 'maxdist'"
    " WHEN span < lower THEN CASE WHEN ev THEN 'eversion' WHEN orient1 <> orient2 THEN 'insertion' ELSE 'insinv' END"
    " WHEN span > upper THEN CASE WHEN NOT ev THEN 'deletion' WHEN orient1 = orient2 THEN 'delinv' ELSE 'eversion' END"
    " WHEN orient1 = orient2 THEN 'inversion' WHEN ev THEN 'eversion' ELSE 'concordant' END AS svtype"
    " FROM (SELECT m.*, l.lower, l.upper, l.max_distance, greatest(start1, end1, start2, end2) - least(start1, end1, start2, end2) + 1 AS span,"
    " CASE WHEN start1 < start2 THEN orient1 = 'R' AND orient2 = 'F' ELSE orient1 = 'F' AND orient2 = 'R' END AS ev FROM mates m JOIN limits l USING (rg))",
    "discs": "SELECT * FROM classed WHERE svtype <> 'concordant'",
    "counted": "SELECT *, count(*) OVER (PARTITION BY clone) AS mapcount FROM discs",
    "filtered": "SELECT * FROM counted WHERE chr1 = chr2 AND prob > 0.0001 AND svtype NOT IN ('concordant', 'transchr', 'inversion')",
    "evidence": "SELECT clone AS name, chr1 AS chr, list_sort([start1, end1, start2, end2])[1] AS \"start\", list_sort([start1, end1, start2, end2])[2] AS inner_start, list_sort([start1, end1, start2, end2])[3] AS inner_end,"
    " list_sort([start1, end1, start2, end2])[4] AS \"end\", CASE svtype WHEN 'insertion' THEN 'INSERTION' WHEN 'deletion' THEN 'DELETION' WHEN 'insinv' THEN 'INSINV' WHEN 'delinv' THEN 'DELINV' WHEN 'eversion' THEN 'EVERSION' ELSE 'MAXDIST' END AS svtype,"
    " 'disc' AS kind, orient1 = 'F' AS forward, mapcount, prob FROM filtered",
    "anchors": f"SELECT {T.sql(T.ANCHORS)} FROM reads WHERE rn = 1",
    "halves": f"SELECT {T.sql(T.HALVES)} FROM reads WHERE rn > 1",
    "sided": "SELECT *, count(*) OVER (PARTITION BY clone) AS n, count(*) FILTER (is_first) OVER (PARTITION BY clone) AS n_first FROM halves",
    "gaps": f"SELECT {T.sql(T.GAPS)} FROM supplier",
    "truth": f"SELECT {T.sql(T.TRUTH)} FROM part",
    "ids": 'SELECT *, row_number() OVER (ORDER BY name, chr, "start", "end", inner_start, inner_end, svtype, prob, mapcount, forward) AS id FROM evidence',
    "spans": 'SELECT *, CASE WHEN svtype IN (\'DELETION\', \'DELINV\') THEN \'DELETION\' WHEN svtype IN (\'INSERTION\', \'INSINV\') THEN \'INSERTION\' ELSE svtype END AS family FROM evidence',
    "marked": 'SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY chr, family ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN NULL ELSE "start" END AS head FROM spans',
    "islands": 'SELECT *, max(head) OVER (PARTITION BY chr, family ORDER BY "start") AS island FROM marked',
    "merged": 'SELECT chr, family, island AS "start", max("end") AS "end", count(*) AS n FROM islands GROUP BY chr, family, island',
    "members": "SELECT chr || ':' || family || ':' || island AS set_id, name, max(mapcount) AS mapcount FROM islands GROUP BY 1, 2",
    "weighed": "SELECT set_id, round(sum(1.0 / mapcount), 6) AS support, count(*) AS names FROM members GROUP BY set_id",
    "called": 'SELECT chr || \':\' || "start" AS call_id, chr, "start", "end" FROM merged WHERE family = \'DELETION\' AND n >= 2',
}


def query(name: str, sql: str | None = None, more: dict[str, str] | None = None):
    """Registers a query and, with the common tables and ``more`` of its own, its SQL."""

    def register(f):
        QUERIES[name] = f
        if sql:
            own = [f"{k} AS {'' if k.endswith('_w') else 'MATERIALIZED '}({v})" for k, v in (more or {}).items()]
            ORACLES[name] = "WITH RECURSIVE " + ", ".join([*(f"{k} AS ({v})" for k, v in WITH.items()), *own]) + " " + sql
        return f

    return register


def _samples(r: DataFrame) -> DataFrame:
    return stats.first_of_group(stats.usable_inserts(r), SAMPLE, "rg", "pos", "clone", "rn")


def _limits(r: DataFrame) -> DataFrame:
    """A row a read group, written once, by one aggregate over the samples."""
    return cut(stats.thresholds(_samples(r), MAX_DISTANCE))


def _classified(r: DataFrame) -> DataFrame:
    return pairs.classify(pairs.mate_pairs(r), _limits(r))


def _discordant(r: DataFrame) -> DataFrame:
    """Written once: counts, islands and joins read it several times."""
    return materialize(pairs.discordant(_classified(r)).drop("edits", "quality").withColumn("name", F.col("clone")))


def _evidence(r: DataFrame) -> DataFrame:
    return materialize(pairs.pair_evidence(pairs.usable_pairs(_discordant(r), ClusterOptions().min_probability)))


def _islands(r: DataFrame) -> DataFrame:
    return intervals.islands(_evidence(r).withColumn("family", X.type_family(F.col("svtype"))), ["chr", "family"])


def _island_members(r: DataFrame) -> DataFrame:
    set_id = F.concat_ws(":", "chr", "family", F.col("island").cast("string"))
    return _islands(r).groupBy(set_id.alias("set_id"), "name").agg(F.max("mapcount").alias("mapcount"))


@query("read_filter", "SELECT clone, rn, flag, tlen, clip FROM kept")
def read_filter(spark, d):
    r = T.reads(spark, d)
    return pairs.filter_reads(r, _limits(r)).select("clone", "rn", "flag", "tlen", F.col("clip").cast("long").alias("clip"))


@query("clone_name", "SELECT clone, rn, regexp_replace(name, '(.)[_/][12]$', '\\1') AS stem, CASE WHEN (flag & 64) = 64 THEN 1 WHEN (flag & 128) = 128 THEN 2 ELSE 0 END::BIGINT AS mate, CASE WHEN regexp_matches(name, '[_/]1$') THEN 1 WHEN regexp_matches(name, '[_/]2$') THEN 2 ELSE 0 END::BIGINT AS suffix, translate(name, '_/', '--') AS plain FROM reads")
def clone_name(spark, d):
    name, flag = F.col("name"), F.col("flag")
    return T.reads(spark, d).select("clone", "rn", X.clone_name(name).alias("stem"), X.mate_number(name, flag).cast("long").alias("mate"), X.mate_number(name, F.lit(0)).cast("long").alias("suffix"), F.translate(name, "_/", "--").alias("plain"))


@query("readlen_mode", "SELECT len, count(*) AS n FROM reads WHERE len >= 50 GROUP BY len ORDER BY n DESC, len DESC LIMIT 1")
def readlen_mode(spark, d):
    return stats.read_length_mode(T.reads(spark, d))


@query("sample_per_rg", "SELECT rg, clone, rn, size, rank FROM samples")
def sample_per_rg(spark, d):
    return _samples(T.reads(spark, d)).select("rg", "clone", "rn", "size", "rank")


@query("sample_in_parts", "SELECT rg, clone, rn, size, rank FROM samples")
def sample_in_parts(spark, d):
    """The same sample off a table sorted by position, read only as far as the read groups need."""
    r = materialize(T.reads(spark, d).repartitionByRange("pos").sortWithinPartitions("pos"))
    groups = [x.rg for x in r.select("rg").distinct().collect()]  # as a header would tell: a read group each
    got = stats.first_of_group_in_parts(stats.position_parts(r, "pos", 1 << 12), groups, SAMPLE, "rg", "pos", "clone", "rn", usable=stats.usable_inserts)
    return got.select("rg", "clone", "rn", "size", "rank")


@query("ref_median_mad", "SELECT rg, n, median::BIGINT AS median, mad::BIGINT AS mad FROM mads")
def ref_median_mad(spark, d):
    return stats.median_and_mad(_samples(T.reads(spark, d)))


@query("rg_thresholds", "SELECT rg, n_kept, n_outliers, round(mean, 6) AS mean, round(stdev, 6) AS stdev, lower, upper, max_distance FROM limits")
def rg_thresholds(spark, d):
    return _limits(T.reads(spark, d)).withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


@query("softclip_len", "SELECT clone, rn, clip, clip > len * 0.3 AS heavy FROM clipped")
def softclip_len(spark, d):
    clip = X.soft_clip(F.col("cigar")).cast("long")
    return T.reads(spark, d).select("clone", "rn", clip.alias("clip"), (clip > F.col("len") * 0.3).alias("heavy"))


@query("split_anchor_flags", """SELECT clone, rn, is_split, is_anchor, bool_or(is_split) OVER (PARTITION BY rg, clone) AS has_split FROM (
  SELECT *, (((flag & 4) = 4 AND (flag & 8) = 0) OR clip > len * 0.3) AND (flag & 256) = 0 AS is_split, (flag & 4) = 0 AND (flag & 8) = 8 AND chr <> '*' AND NOT clip > len * 0.3 AS is_anchor FROM clipped)""")
def split_anchor_flags(spark, d):
    return pairs.split_and_anchor_flags(T.reads(spark, d)).select("clone", "rn", "is_split", "is_anchor", "has_split")


@query("xa_explode", """SELECT clone, rn, string_split(h, ',')[1] AS chr, substr(string_split(h, ',')[2], 2)::BIGINT - CASE WHEN h LIKE '%,-%' THEN len ELSE 0 END AS pos, flag
  FROM (SELECT *, unnest(string_split(xa, ';')) AS h FROM reads) WHERE h <> ''""")
def xa_explode(spark, d):
    return pairs.alternative_hits(T.reads(spark, d)).select("clone", "rn", "chr", "pos", "flag")


@query("mate_pairs", "SELECT rg, clone, chr1, start1, end1, orient1, chr2, start2, end2, orient2, round(prob, 9) AS prob FROM mates")
def mate_pairs(spark, d):
    return pairs.mate_pairs(T.reads(spark, d)).withColumn("prob", F.round("prob", 9)).drop("edits", "quality")


@query("pair_quality", """, q AS (SELECT rg, clone, num, edits, CASE WHEN length(qual) > 0 THEN list_sum(list_transform(regexp_extract_all(qual, '(?s).'), lambda c: unicode(c))) / length(qual) - 33 END AS quality FROM reads)
  SELECT rg, (a.edits + b.edits) / 2 AS edits, round((a.quality + b.quality) / 2, 6) AS quality, count(*) AS n FROM q a JOIN q b USING (rg, clone) WHERE a.num = 1 AND b.num = 2 GROUP BY ALL""")
def pair_quality(spark, d):
    m = pairs.mate_pairs(T.reads(spark, d))
    return m.groupBy("rg", "edits", F.round("quality", 6).alias("quality")).agg(F.count("*").alias("n"))


@query("pairs_file", "SELECT clone AS name, chr1, start1, end1, orient1, chr2, start2, end2, orient2, svtype, round(prob, 9) AS prob FROM discs")
def pairs_file(spark, d):
    """Discordant pairs written as text, a folder a read group, and read again."""
    path = f"{checkpoint_dir(spark)}/pairs-{uuid.uuid4().hex}"
    files.write_pairs(_discordant(T.reads(spark, d)), path)
    got = files.read_pairs(spark, path)
    return got.select("name", "chr1", "start1", "end1", "orient1", "chr2", "start2", "end2", "orient2", "svtype", F.round("prob", 9).alias("prob"))


@query("sets_per_chromosome", "SELECT chr, family, count(*) AS n FROM merged GROUP BY chr, family")
def sets_per_chromosome(spark, d):
    e = _evidence(T.reads(spark, d)).withColumn("family", X.type_family(F.col("svtype")))
    return score.counts_by_type(intervals.merge(e, ["chr", "family"]), ["chr", "family"])


@query("sv_class", "SELECT chr1 AS chr, svtype, count(*) AS n, min(start1) AS first, max(end2) AS last FROM classed GROUP BY 1, 2")
def sv_class(spark, d):
    return _classified(T.reads(spark, d)).groupBy(F.col("chr1").alias("chr"), "svtype").agg(F.count("*").alias("n"), F.min("start1").alias("first"), F.max("end2").alias("last"))


@query("pair_state", """SELECT CASE WHEN one AND two THEN 0 WHEN two THEN 1 WHEN one THEN 2 ELSE 3 END::BIGINT AS state, count(*) AS n
  FROM (SELECT bool_or(num = 1) AS one, bool_or(num = 2) AS two, count(*) AS c FROM kept GROUP BY rg, clone) WHERE c > 1 GROUP BY 1""")
def pair_state(spark, d):
    r = T.reads(spark, d)
    return pairs.fragment_states(pairs.filter_reads(r, _limits(r))).withColumn("state", F.col("state").cast("long"))


@query("divet_filter", "SELECT clone AS name, chr1, start1, end2, svtype, mapcount FROM filtered")
def divet_filter(spark, d):
    return pairs.usable_pairs(_discordant(T.reads(spark, d)), 0.0001).select("name", "chr1", "start1", "end2", "svtype", "mapcount")


@query("name_mapcount", "SELECT clone AS name, count(*) AS mapcount FROM discs GROUP BY 1")
def name_mapcount(spark, d):
    return pairs.mapping_counts(_discordant(T.reads(spark, d)))


@query("read_pair_coords", 'SELECT name, chr, "start", inner_start, inner_end, "end", svtype, mapcount, forward FROM evidence')
def read_pair_coords(spark, d):
    return _evidence(T.reads(spark, d)).select("name", "chr", "start", "inner_start", "inner_end", "end", "svtype", "mapcount", "forward")


@query("split_halves", f"""SELECT status, seq1, qual1, seq2, qual2, count(*) AS n FROM (SELECT status, CASE WHEN ok THEN substr(seq, m - {HALF} + 1, {HALF}) END AS seq1, CASE WHEN ok THEN substr(qual, m - {HALF} + 1, {HALF}) END AS qual1,
  CASE WHEN ok THEN substr(seq, m + 1, {HALF}) END AS seq2, CASE WHEN ok THEN substr(qual, m + 1, {HALF}) END AS qual2 FROM (SELECT *, status IN ('ok', 'trimmed') AS ok FROM (
  SELECT *, CASE WHEN length(seq) <> length(qual) THEN 'error' WHEN m < {HALF} THEN 'short' WHEN m > {HALF} THEN 'trimmed' ELSE 'ok' END AS status FROM (SELECT *, (length(seq) // 2)::INT AS m FROM reads)))) GROUP BY ALL""")
def split_halves(spark, d):
    return splits.halve(T.reads(spark, d), HALF).groupBy("status", "seq1", "qual1", "seq2", "qual2").agg(F.count("*").alias("n"))


@query("base_quality", "SELECT doc_id, CASE WHEN length(text) > 0 THEN round(list_sum(list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c))) / length(text) - 33, 6) END AS quality FROM documents")
def base_quality(spark, d):
    return T.table(spark, d, "documents").select("doc_id", F.round(X.mean_quality(F.col("text")), 6).alias("quality"))


@query("map_prob", "SELECT mapq, round(1 - power(10.0, -mapq / 10.0), 9) AS prob, count(*) AS n FROM reads GROUP BY 1, 2")
def map_prob(spark, d):
    return T.reads(spark, d).select("mapq", F.round(X.map_probability(F.col("mapq")), 9).alias("prob")).groupBy("mapq", "prob").agg(F.count("*").alias("n"))


@query("anchor_split_join", 'SELECT s.clone, a."start" AS anchor_start, s.chr, s."start", s."end", s.is_first, n, n_first FROM anchors a JOIN sided s USING (clone) WHERE n < 30')
def anchor_split_join(spark, d):
    r = T.reads(spark, d)
    return splits.anchored_halves(T.anchors(r), T.halves(r)).select("clone", "anchor_start", "chr", "start", "end", "is_first", "n", "n_first")


_NEAR = '(a.chr = s.chr AND abs(s."start" - a."start") < %d)' % ANCHOR_REACH


@query("unbalanced_pairs", f"""SELECT s.clone, s.chr, s."start", s."end", s.forward, s.is_first, a."start" AS anchor_start FROM anchors a JOIN sided s USING (clone)
  WHERE (n = 1 AND {_NEAR}) OR (n > 1 AND n < 30 AND (n_first = 0 OR n_first = n))""")
def unbalanced_pairs(spark, d):
    r = T.reads(spark, d)
    return splits.unbalanced(T.anchors(r), T.halves(r)).select("clone", "chr", "start", "end", "forward", "is_first", "anchor_start")


_HALF_TYPE = """CASE WHEN (s."start" > t."start" AND s.forward AND NOT t.forward) OR (s."start" < t."start" AND NOT s.forward AND t.forward) THEN 'EVERSION'
  WHEN (s."start" < t."start" AND NOT s.forward AND NOT t.forward) OR (s."start" > t."start" AND s.forward AND t.forward) THEN 'INVERSION'
  WHEN (s."start" < t."start" AND s.forward AND NOT t.forward) OR (s."start" > t."start" AND NOT s.forward AND t.forward) THEN 'DELETION' ELSE 'DELINV' END"""
_FOUR = '[s."start", s."end", t."start", t."end"]'


@query("balanced_pairs", f"""SELECT s.clone, s.chr, list_sort({_FOUR})[1] AS "start", list_sort({_FOUR})[2] AS inner_start, list_sort({_FOUR})[3] AS inner_end, list_sort({_FOUR})[4] AS "end", {_HALF_TYPE} AS svtype, a."start" AS anchor_start
  FROM anchors a JOIN sided s USING (clone) JOIN sided t ON t.clone = s.clone AND s.is_first AND NOT t.is_first
  WHERE s.n < 30 AND least(abs(s."start" - t."end"), abs(t."start" - s."end")) > 5 AND ({_NEAR} OR (s.n > 2 AND {_NEAR.replace('s.', 't.')}))""")
def balanced_pairs(spark, d):
    r = T.reads(spark, d)
    return splits.balanced(T.anchors(r), T.halves(r)).select("clone", "chr", "start", "inner_start", "inner_end", "end", "svtype", "anchor_start")


@query("split_type", f"SELECT {_HALF_TYPE} AS svtype, count(*) AS n FROM halves s JOIN halves t ON t.clone = s.clone AND t.rn = s.rn + 1 GROUP BY 1")
def split_type(spark, d):
    h = T.halves(T.reads(spark, d))
    a = h.select("clone", "rn", F.col("start").alias("s1"), F.col("forward").alias("f1"))
    b = h.select("clone", (F.col("rn") - 1).alias("rn"), F.col("start").alias("s2"), F.col("forward").alias("f2"))
    kind = X.half_type(F.col("s1"), F.col("s2"), F.col("f1"), F.col("f2"))
    return a.join(b, ["clone", "rn"]).groupBy(kind.alias("svtype")).agg(F.count("*").alias("n"))


@query("missing_anchor_semi", """, f AS (SELECT r.rg, r.clone, r.rn, r.num, k.rn IS NOT NULL AS kept, (((r.flag & 4) = 4 AND (r.flag & 8) = 0) OR r.clip > r.len * 0.3) AND (r.flag & 256) = 0 AS s, (r.flag & 4) = 0 AND (r.flag & 8) = 8 AND NOT r.clip > r.len * 0.3 AS a
    FROM clipped r LEFT JOIN kept k ON k.clone = r.clone AND k.rn = r.rn),
  w AS (SELECT DISTINCT f.rg, f.clone, 3 - f.num AS num FROM f JOIN (SELECT rg, clone FROM f WHERE kept GROUP BY rg, clone HAVING bool_or(s) AND NOT bool_or(a)) USING (rg, clone) WHERE kept AND s)
  SELECT clone, rn FROM f WHERE NOT s AND EXISTS (SELECT 1 FROM w WHERE w.rg = f.rg AND w.clone = f.clone AND w.num = f.num)""")
def missing_anchor_semi(spark, d):
    r = T.reads(spark, d)
    kept = pairs.filter_reads(r, _limits(r)).select("clone", "rn", F.lit(True).alias("kept"))
    f, clip, length = F.col("flag"), X.soft_clip(F.col("cigar")), F.col("len")
    flagged = r.select("rg", "clone", "rn", "num", X.is_split(f, clip, length).alias("is_split"), X.is_anchor(f, F.col("chr"), clip, length).alias("is_anchor"))
    return splits.missing_anchors(flagged.join(kept, ["clone", "rn"], "left").na.fill(False, ["kept"])).select("clone", "rn")


@query("gap_anti", 'SELECT DISTINCT name, chr, "start", "end" FROM evidence e WHERE NOT EXISTS (SELECT 1 FROM gaps g WHERE g.chr = e.chr AND g."start" < e."end" AND g."end" > e."start")')
def gap_anti(spark, d):
    e = _evidence(T.reads(spark, d)).select("name", "chr", "start", "end")
    return intervals.without_overlap(e, T.gaps(spark, d), ["chr"]).distinct()


@query("interval_join", """SELECT e.name, e.chr, e."start", e."end", g.gap_id FROM evidence e JOIN gaps g ON g.chr = e.chr AND g."start" < e."end" AND g."end" > e."start" """)
def interval_join(spark, d):
    met = intervals.overlap_pairs(_evidence(T.reads(spark, d)), T.gaps(spark, d), ["chr"])
    return met.select("a.name", "a.chr", "a.start", "a.end", "b.gap_id")


@query("reciprocal_overlap", """SELECT m.family, m."start", g.gap_id, round((least(m."end", g."end") - greatest(m."start", g."start")) / greatest(m."end" - m."start", g."end" - g."start"), 6) AS share
  FROM merged m JOIN gaps g ON g.chr = m.chr AND g."start" < m."end" AND g."end" > m."start" """)
def reciprocal_overlap(spark, d):
    e = _evidence(T.reads(spark, d)).withColumn("family", X.type_family(F.col("svtype")))
    met = intervals.overlap_pairs(intervals.merge(e, ["chr", "family"]), T.gaps(spark, d), ["chr"])
    share = X.shared_share(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))
    return met.select("a.family", "a.start", "b.gap_id", F.round(share, 6).alias("share"))


@query("merge_islands", 'SELECT chr, family, "start", "end", n FROM merged')
def merge_islands(spark, d):
    e = _evidence(T.reads(spark, d)).withColumn("family", X.type_family(F.col("svtype")))
    return intervals.merge(e, ["chr", "family"])


@query("overlap_count", """SELECT t.truth_id, count(e.name) AS n FROM truth t LEFT JOIN evidence e ON e.chr = t.chr AND e."start" < t."end" AND e."end" > t."start"
  AND least(e."end", t."end") - greatest(e."start", t."start") >= 0.5 * (e."end" - e."start") GROUP BY t.truth_id""")
def overlap_count(spark, d):
    return intervals.overlap_counts(_evidence(T.reads(spark, d)), T.truth(spark, d), ["chr"], "truth_id")


@query("weighted_support", "SELECT set_id, support, names FROM weighed")
def weighted_support(spark, d):
    m = _island_members(T.reads(spark, d))
    return m.groupBy("set_id").agg(F.round(F.sum(1.0 / F.col("mapcount")), 6).alias("support"), F.count("*").alias("names"))


@query("shared_names", "SELECT name, count(*) AS sets, min(set_id) AS first FROM members GROUP BY name HAVING count(*) > 1")
def shared_names(spark, d):
    return cover.shared_names(_island_members(T.reads(spark, d)))


@query("touched_sets", "SELECT DISTINCT set_id FROM members WHERE name IN (SELECT name FROM members GROUP BY name HAVING count(*) > 1)")
def touched_sets(spark, d):
    return cover.touched_sets(_island_members(T.reads(spark, d)))


@query("set_filter", "SELECT set_id, support FROM weighed WHERE names >= 2 AND support >= 1.0")
def set_filter(spark, d):
    m = _island_members(T.reads(spark, d))
    return m.groupBy("set_id").agg(F.round(F.sum(1.0 / F.col("mapcount")), 6).alias("support"), F.count("*").alias("n")).where("n >= 2 and support >= 1.0").drop("n")


@query("nearest_inversion", """, i AS (SELECT DISTINCT chr1 AS chr, start1 AS at, orient1 FROM discs WHERE svtype IN ('inversion', 'insinv') AND chr1 = chr2)
  SELECT l.chr, l.at, min(r.at) AS next_at FROM i l LEFT JOIN i r ON l.orient1 = 'F' AND r.orient1 = 'R' AND r.chr = l.chr AND r.at >= l.at AND r.at - l.at <= 100000 WHERE l.orient1 = 'F' GROUP BY l.chr, l.at""")
def nearest_inversion(spark, d):
    i = _discordant(T.reads(spark, d)).where(F.col("svtype").isin("inversion", "insinv") & (F.col("chr1") == F.col("chr2"))).select(F.col("chr1").alias("chr"), "start1", "orient1").distinct()
    left = i.where("orient1 = 'F'").select("chr", F.col("start1").alias("at"))
    return intervals.next_after(left, i.where("orient1 = 'R'").select("chr", F.col("start1").alias("next_at")), ["chr"], "at", 100_000, "next_at")


@query("support_names", "SELECT set_id, string_agg(name, ';' ORDER BY name) AS names FROM members GROUP BY set_id")
def support_names(spark, d):
    return _island_members(T.reads(spark, d)).groupBy("set_id").agg(F.concat_ws(";", F.sort_array(F.collect_list("name"))).alias("names"))


#: Calls one by one, each with the first of its events that is still free.
MATCHED = """, met AS (SELECT c.call_id, c.chr, c."start", c."end", list(t.truth_id ORDER BY t."start", t."end", t.truth_id) AS events FROM called c JOIN truth t
    ON t.chr = c.chr AND t."start" - 100 < c."end" AND t."end" + 100 > c."start" GROUP BY ALL),
  offers AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY "start", "end", call_id) AS k FROM met),
  hit_list AS (SELECT chr, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::VARCHAR AS call_id, NULL::BIGINT AS truth_id FROM (SELECT DISTINCT chr FROM offers)
    UNION ALL SELECT chr, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, call_id, pick
    FROM (SELECT o.chr, o.k, h.used, o.call_id, list_filter(o.events, lambda x: NOT list_contains(h.used, x))[1] AS pick FROM hit_list h JOIN offers o ON o.chr = h.chr AND o.k = h.k + 1)),
  hit AS (SELECT call_id, truth_id FROM hit_list WHERE truth_id IS NOT NULL)"""


@query("precision_recall", MATCHED + """,
  n AS (SELECT (SELECT count(*) FROM called) AS n_calls, (SELECT count(*) FROM truth) AS n_truth, (SELECT count(DISTINCT truth_id) FROM hit) AS n_found)
  SELECT *, CASE WHEN n_calls > 0 THEN n_found / n_calls ELSE 0.0 END AS precision, CASE WHEN n_truth > 0 THEN n_found / n_truth ELSE 0.0 END AS recall FROM n""")
def precision_recall(spark, d):
    return score.precision_recall(_calls(spark, d), T.truth(spark, d))


def _calls(spark, d):
    e = _evidence(T.reads(spark, d)).withColumn("family", X.type_family(F.col("svtype")))
    m = intervals.merge(e, ["chr", "family"]).where("family = 'DELETION' and n >= 2")
    return m.select(F.concat_ws(":", "chr", F.col("start").cast("string")).alias("call_id"), "chr", "start", "end")


@query("truth_match", MATCHED + " SELECT call_id, truth_id FROM hit")
def truth_match(spark, d):
    return score.match_truth(_calls(spark, d), T.truth(spark, d))


#: As MATCHED, for each caller by itself; events have types.
TYPED = """, typed AS (SELECT *, CASE WHEN truth_id % 3 = 0 THEN 'EVERSION' ELSE 'DELETION' END AS svtype FROM truth),
  tagged AS (SELECT family AS caller, chr || ':' || "start" AS call_id, chr, "start", "end" FROM merged WHERE family IN ('DELETION', 'EVERSION') AND n >= 2),
  met AS (SELECT c.*, list(t.truth_id ORDER BY t."start", t."end", t.truth_id) AS events FROM tagged c JOIN truth t ON t.chr = c.chr AND t."start" - 100 < c."end" AND t."end" + 100 > c."start" GROUP BY ALL),
  offers AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY caller, chr ORDER BY "start", "end", call_id) AS k FROM met),
  hit_list AS (SELECT caller, chr, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS truth_id FROM (SELECT DISTINCT caller, chr FROM offers)
    UNION ALL SELECT caller, chr, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick
    FROM (SELECT o.caller, o.chr, o.k, h.used, list_filter(o.events, lambda x: NOT list_contains(h.used, x))[1] AS pick FROM hit_list h JOIN offers o ON o.caller = h.caller AND o.chr = h.chr AND o.k = h.k + 1)),
  n AS (SELECT f.caller, (SELECT count(*) FROM hit_list h WHERE h.caller = f.caller AND h.truth_id IS NOT NULL) AS n_found, (SELECT count(*) FROM tagged c WHERE c.caller = f.caller) AS n_calls,
    (SELECT count(*) FROM typed t WHERE t.svtype = f.caller) AS n_known FROM (VALUES ('DELETION'), ('EVERSION')) f(caller))"""


def _typed(spark, d):
    """Calls of two families as two callers, and events with types."""
    m = intervals.merge(_evidence(T.reads(spark, d)).withColumn("family", X.type_family(F.col("svtype"))), ["chr", "family"])
    m = m.where("family in ('DELETION', 'EVERSION') and n >= 2").select(F.col("family").alias("caller"), F.concat_ws(":", "chr", F.col("start").cast("string")).alias("call_id"), "chr", "start", "end")
    return m, T.truth(spark, d).withColumn("svtype", F.when(F.col("truth_id") % 3 == 0, "EVERSION").otherwise("DELETION"))


@query("recall_by_type", TYPED + """ SELECT caller, n_found, n_calls, CASE WHEN n_calls > 0 THEN n_found / n_calls ELSE 0.0 END AS precision, n_known, CASE WHEN n_known > 0 THEN n_found / n_known ELSE 0.0 END AS recall FROM n""")
def recall_by_type(spark, d):
    return score.recall_by_type(*_typed(spark, d), {"DELETION": "DELETION", "EVERSION": "EVERSION"})


@query("truth_support", TYPED + """ SELECT t.truth_id, t.chr, t."start", t."end", t.svtype, c.caller, c.call_id, c."start" AS call_start, c."end" AS call_end FROM typed t JOIN tagged c ON t.chr = c.chr AND t."start" - 100 < c."end" AND t."end" + 100 > c."start" """)
def truth_support(spark, d):
    return score.support_listing(*_typed(spark, d))


@query("truth_matrix", """, h AS (SELECT t.truth_id, m.family FROM truth t JOIN merged m ON m.chr = t.chr AND t."start" - 100 < m."end" AND t."end" + 100 > m."start")
  SELECT t.truth_id, t.chr, t."start", t."end", count(*) FILTER (h.family = 'DELETION') AS "DELETION", count(*) FILTER (h.family = 'INSERTION') AS "INSERTION", count(*) FILTER (h.family = 'EVERSION') AS "EVERSION"
  FROM truth t LEFT JOIN h USING (truth_id) GROUP BY ALL""")
def truth_matrix(spark, d):
    e = _evidence(T.reads(spark, d)).withColumn("family", X.type_family(F.col("svtype")))
    truth = T.truth(spark, d)
    hits = intervals.overlap_pairs(intervals.merge(e, ["chr", "family"]), truth, ["chr"], score.SLOP).select(F.col("a.family").alias("caller"), "b.truth_id")
    return score.support_matrix(hits, truth, ["DELETION", "INSERTION", "EVERSION"])


@query("name_set_ops", """, a AS (SELECT DISTINCT clone FROM discs), h AS (SELECT DISTINCT clone FROM halves)
  SELECT clone, CASE WHEN clone IN (SELECT clone FROM a) AND clone IN (SELECT clone FROM h) THEN 'both' WHEN clone IN (SELECT clone FROM a) THEN 'pairs' ELSE 'halves' END AS side FROM (SELECT clone FROM a UNION SELECT clone FROM h)""")
def name_set_ops(spark, d):
    r = T.reads(spark, d)
    a, h = _discordant(r).select("clone").distinct(), T.halves(r).select("clone").distinct()
    side = lambda x, name: x.withColumn("side", F.lit(name))
    return side(a.intersect(h), "both").union(side(a.join(h, "clone", "left_anti"), "pairs")).union(side(h.join(a, "clone", "left_anti"), "halves"))


@query("chromosomes", "SELECT DISTINCT chr FROM (SELECT chr FROM anchors UNION ALL SELECT chr FROM halves)")
def chromosomes(spark, d):
    r = T.reads(spark, d)
    return T.anchors(r).select("chr").union(T.halves(r).select("chr")).distinct()


@query("final_sort", """SELECT chr, family, "start", "end", n, row_number() OVER (PARTITION BY chr ORDER BY n DESC, "start", "end", family) AS rank FROM merged""")
def final_sort(spark, d):
    e = _evidence(T.reads(spark, d)).withColumn("family", X.type_family(F.col("svtype")))
    m = intervals.merge(e, ["chr", "family"])
    return score.rank_within(m, ["chr"], F.desc("n"), "start", "end", "family")


def _written_reads(spark, d):
    """What evidence needs of the reads, written once: else they are ranked and sorted again for each use."""
    return materialize(T.reads(spark, d).select("clone", "rn", "rg", "num", "chr", "pos", "orient", "mapq", "len", "flag", "tlen"))


def _all_evidence(spark, d):
    r = _written_reads(spark, d)
    return events.evidence(_discordant(r), T.anchors(r), T.halves(r), T.gaps(spark, d), ClusterOptions())


_FAMILY = oracles.FAMILY.format("svtype")
_PIECES = 'name, chr, "start", inner_start, inner_end, "end", svtype, kind, forward, mapcount'
#: Pairs and paired halves that touch no gap, and their sets.
SETS = {
    "both_halves": f"""SELECT s.clone AS name, s.chr, list_sort({_FOUR})[1] AS "start", list_sort({_FOUR})[2] AS inner_start, list_sort({_FOUR})[3] AS inner_end, list_sort({_FOUR})[4] AS "end", {_HALF_TYPE} AS svtype, 'split' AS kind, NULL::BOOLEAN AS forward
      FROM anchors a JOIN sided s USING (clone) JOIN sided t ON t.clone = s.clone AND s.is_first AND NOT t.is_first WHERE s.n < 30 AND least(abs(s."start" - t."end"), abs(t."start" - s."end")) > 5 AND ({_NEAR} OR (s.n > 2 AND {_NEAR.replace('s.', 't.')}))""",
    "one_half": f"""SELECT s.clone AS name, s.chr, s."start", NULL::BIGINT AS inner_start, NULL::BIGINT AS inner_end, s."end", 'UNBALANCEDINV' AS svtype, 'unbalanced' AS kind, s.forward
      FROM anchors a JOIN sided s USING (clone) WHERE (n = 1 AND {_NEAR}) OR (n > 1 AND n < 30 AND (n_first = 0 OR n_first = n))""",
    "anchor_counts": "SELECT clone AS name, count(*) AS mapcount FROM anchors GROUP BY clone",
    "half_pieces": "SELECT h.*, coalesce(c.mapcount, 1) AS mapcount FROM (SELECT * FROM both_halves UNION ALL SELECT * FROM one_half) h LEFT JOIN anchor_counts c USING (name)",
    "pieces": f"""SELECT '' AS file, *, CASE WHEN kind = 'unbalanced' THEN 'DELETION' ELSE {_FAMILY} END AS family FROM (SELECT {_PIECES} FROM evidence UNION ALL SELECT {_PIECES} FROM half_pieces) e
      WHERE NOT EXISTS (SELECT 1 FROM gaps g WHERE g.chr = e.chr AND g."start" < e."end" AND g."end" > e."start")""",
    "pair_pieces": "SELECT * FROM pieces WHERE kind = 'disc'",
    "split_pieces": "SELECT * FROM pieces WHERE kind <> 'disc'",
    **oracles.clustered("pair_sets", "pair_pieces", "inner_start", "d"),
    **oracles.clustered("split_sets", "split_pieces", "CASE WHEN family = 'DELETION' THEN \"end\" ELSE inner_start END", "s"),
    **oracles.folded("merged_pairs", None, "pair_sets"),
    **oracles.folded("sets", "merged_pairs", "split_sets"),
}
FILES = {
    "named": f"SELECT *, (substr(name, 2)::BIGINT % 2)::VARCHAR || ':' AS file, {_FAMILY} AS family FROM evidence",
    **{f"named{k}": f"SELECT * FROM named WHERE file = '{k}:'" for k in (0, 1)},
    **oracles.clustered("sets0", "named0", "inner_start", "d"),
    **oracles.clustered("sets1", "named1", "inner_start", "d"),
    **oracles.folded("first", None, "sets0"),
    **oracles.folded("sets", "first", "sets1"),
}
COVER = {**SETS, **oracles.covered("taken", "sets", 2, 1)}
SHOWN = ["set_id", "chr", "family", "start", "inner_start", "inner_end", "end", "svtype", "raw_reads", "disc_support", "split_support", "unbalanced_support"]


@query("evidence_sets", f"SELECT {oracles.SHOWN} FROM sets", SETS)
def evidence_sets(spark, d):
    return cluster.evidence_sets(_all_evidence(spark, d)).sets.select(SHOWN)


@query("set_merge", f"SELECT {oracles.SHOWN} FROM sets", FILES)
def set_merge(spark, d):
    """Pairs of two files (odd and even clones), each clustered by itself, folded in order."""
    e = _evidence(_written_reads(spark, d))
    odd = F.substring("name", 2, 20).cast("long") % 2
    return cluster.fold_sets([cluster.pair_sets(e.where(odd == k), f"{k}:") for k in (0, 1)]).sets.select(SHOWN)


@query("greedy_cover", "SELECT set_id, support FROM taken", COVER)
def greedy_cover(spark, d):
    made = cluster.evidence_sets(_all_evidence(spark, d))
    return cover.greedy_cover(made.sets, cluster.set_members(made), 1.0, 2)


CALLS = """SELECT set_id, chr, x.s AS "start", x.si AS inner_start, x.ei AS inner_end, x.e AS "end", CASE WHEN x.svtype IN ('DELETION', 'DELINV') THEN 'DELETION' WHEN x.svtype IN ('INSERTION', 'INSINV') THEN 'INSERTION' ELSE 'TANDEM' END AS svtype,
  x.disc AS disc_support, x.split AS split_support, x.unb AS unbalanced_support, support AS weighted_support FROM sets JOIN taken ON taken.set_id = x.id WHERE x.svtype IN ('DELETION', 'DELINV', 'INSERTION', 'INSINV', 'EVERSION')"""


@query("calls", CALLS, COVER)
def calls(spark, d):
    return events.call_events(_all_evidence(spark, d), ClusterOptions())


@query("ranked_calls", f"""SELECT *, row_number() OVER (PARTITION BY chr ORDER BY floor(weighted_support) DESC, "start", inner_start, inner_end, "end", svtype, set_id) AS rank FROM ({CALLS})""", COVER)
def ranked_calls(spark, d):
    called = events.call_events(_all_evidence(spark, d), ClusterOptions())
    return score.rank_within(called, ["chr"], F.desc(F.floor("weighted_support")), "start", "inner_start", "inner_end", "end", "svtype", "set_id")
