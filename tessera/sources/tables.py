"""Views of the relational test tables as reads, halves, anchors, gaps and known events.

The column texts are SQL that Spark and DuckDB read alike, so queries and their checks start
from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RANK = (
    "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,"
    " l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS rn"
)
_REVERSE = "(rn % 2 = 0) <> (l_returnflag = 'R' AND l_linestatus = 'O')"
_NUM = "CASE WHEN rn % 2 = 1 THEN 1 ELSE 2 END"
READS = {
    "clone": "CONCAT('c', CAST(l_orderkey AS STRING))",
    "name": f"CONCAT('c', CAST(l_orderkey AS STRING), CASE WHEN l_partkey % 3 = 0 THEN '/' ELSE '_' END, CAST({_NUM} AS STRING))",
    "rn": "CAST(rn AS BIGINT)",
    "rg": "CONCAT('rg', CAST(l_orderkey % 3 AS STRING))",
    "num": f"CAST({_NUM} AS BIGINT)",
    "chr": "CONCAT('chr', CAST((l_orderkey + CASE WHEN rn % 2 = 0 AND l_discount > 0.095 THEN 1 ELSE 0 END) % 5 AS STRING))",
    "pos": "CAST((l_orderkey * 733) % 1000000 + CASE WHEN rn % 2 = 0 THEN 300 + CAST(l_quantity AS BIGINT) * 4"
    " + CASE WHEN l_tax > 0.065 THEN l_partkey * 37 WHEN l_tax < 0.005 THEN -250 ELSE 0 END ELSE 0 END AS BIGINT)",
    "orient": f"CASE WHEN {_REVERSE} THEN 'R' ELSE 'F' END",
    "mapq": "CAST(l_quantity AS BIGINT)",
    "len": "CAST(CASE WHEN l_linenumber = 7 THEN 75 ELSE 100 END AS BIGINT)",
    "flag": "CAST(1 + CASE WHEN l_returnflag = 'N' THEN 2 ELSE 0 END + CASE WHEN l_discount < 0.005 THEN 4 ELSE 0 END + CASE WHEN l_tax < 0.005 THEN 8 ELSE 0 END"
    f" + CASE WHEN {_REVERSE} THEN 16 ELSE 0 END + CASE WHEN rn % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN rn % 7 = 0 THEN 256 ELSE 0 END AS BIGINT)",
    "tlen": "CAST(CASE WHEN l_tax < 0.005 THEN 0 WHEN rn % 2 = 1 THEN 1 ELSE -1 END * (300 + CAST(l_quantity AS BIGINT) * 4 + CASE WHEN l_tax > 0.075 THEN 100000 ELSE 0 END) AS BIGINT)",
    "cigar": "CASE WHEN l_linenumber % 2 = 0 THEN CONCAT(CAST(l_partkey % 50 AS STRING), 'S', CAST(100 - l_partkey % 50 AS STRING), 'M')"
    " ELSE CONCAT(CAST(l_partkey % 25 AS STRING), 'S', CAST(100 - l_partkey % 25 - l_suppkey % 20 AS STRING), 'M', CAST(l_suppkey % 20 AS STRING), 'S') END",
    "xa": "CASE WHEN rn = 1 THEN CONCAT('chr', CAST(l_partkey % 5 AS STRING), ',+', CAST(l_partkey * 37 AS STRING), ',100M,2;chr', CAST(l_suppkey % 5 AS STRING), ',-', CAST(l_suppkey * 991 + 100 AS STRING), ',100M,1;') ELSE '' END",
    "edits": "CAST(l_partkey % 4 AS BIGINT)",
    "seq": "SUBSTRING(REPEAT('ACGT', 30), 1, CASE WHEN l_linenumber = 7 THEN 75 ELSE 100 - CAST(l_suppkey % 7 AS INT) END)",
    "qual": "SUBSTRING(REPEAT('IIHGF', 30), 1, CASE WHEN l_linenumber = 7 THEN 75 ELSE 100 - CAST(l_suppkey % 7 AS INT) END + CASE WHEN l_partkey % 97 = 0 THEN 1 ELSE 0 END)",
}
ANCHORS = {"clone": "clone", "chr": "chr", "start": "pos", "forward": "orient = 'F'", "prob": "1 - POWER(10.0, -mapq / 10.0)"}
HALVES = {"clone": "clone", "chr": "chr", "start": "pos", "end": "pos + 50", "forward": "orient = 'F'", "is_first": "flag % 4 < 2", "rn": "rn"}
GAPS = {"gap_id": "s_suppkey", "chr": "CONCAT('chr', CAST(s_suppkey % 5 AS STRING))", "start": "CAST(s_suppkey * 9001 % 1000000 AS BIGINT)", "end": "CAST(s_suppkey * 9001 % 1000000 + 5000 AS BIGINT)"}
TRUTH = {"truth_id": "p_partkey", "chr": "CONCAT('chr', CAST(p_partkey % 5 AS STRING))", "start": "CAST(p_partkey * 613 % 1000000 AS BIGINT)", "end": "CAST(p_partkey * 613 % 1000000 + 200 + p_size * 20 AS BIGINT)"}


def texts(columns: dict[str, str]) -> list[str]:
    return [f"{v} AS `{k}`" for k, v in columns.items()]


def sql(columns: dict[str, str]) -> str:
    return ", ".join(f'{v} AS "{k}"' for k, v in columns.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("*", RANK).selectExpr(*texts(READS))


def anchors(r: DataFrame) -> DataFrame:
    return r.where("rn = 1").selectExpr(*texts(ANCHORS))


def halves(r: DataFrame) -> DataFrame:
    return r.where("rn > 1").selectExpr(*texts(HALVES))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*texts(GAPS))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*texts(TRUTH))
