"""Connected components of an edge table by alternating star contractions.

Every round is two group-bys and two joins on vertex ids, so no vertex's neighbours are
ever gathered in one row, and the number of rounds grows with the logarithm of the
longest chain rather than with its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

#: Edges of a task, about, in a round; tables of fewer have as many tasks as there are cores.
EDGES = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).coalesce(parts).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(pmod(xxhash64(v, u), 1000003))")).first()
    return tuple(row)


def connected_components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """``edges`` (u, v: two vertex ids of one orderable type) -> (vertex, component).

    ``component`` is the smallest vertex id that can be reached. Only vertices with an
    edge to another vertex are returned; self loops, repeated edges and edges with a
    null end are ignored. An empty table gives an empty table. ``parts``: that the table of
    edges is written in at most (by default as many as its shuffle has); a part is one file. The
    rounds' tasks follow the number of edges, however many partitions a shuffle has.
    """
    e = edges.where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e.coalesce(parts) if parts else e)
    before = _state(e)
    if before[0] == 0:
        return e.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    cores = edges.sparkSession.sparkContext.defaultParallelism
    while True:
        most = max(cores, -(-before[0] // EDGES))
        e = cut(_small_star(_large_star(e.coalesce(most)).coalesce(most), most).coalesce(most))
        now = _state(e)
        if now == before:
            roots = e.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(roots)
        before = now
