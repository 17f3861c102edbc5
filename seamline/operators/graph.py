"""Neighbours and bounded traversal over typed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def incident(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows of ``starts`` (nk, nid, types, ...) with every edge at the node: adds edge_id, edge_type, tk_, tid_.

    starts holds a few nodes per query (seeds, or what a capped expansion found),
    so it is the broadcast side and the edges are not shuffled. An edge whose
    both ends are the node counts once; repeated rows of an edge do, too.
    """
    s = F.broadcast(starts)
    fits = F.col("types").isNull() | F.array_contains("types", F.col("edge_type"))
    cols = [*starts.columns, F.col("id").alias("edge_id"), "edge_type"]
    out = edges.join(s, (edges.fk == starts.nk) & (edges.fid == starts.nid) & fits).select(*cols, F.col("tk").alias("tk_"), F.col("tid").alias("tid_"))
    back = edges.join(s, (edges.tk == starts.nk) & (edges.tid == starts.nid) & fits & ~((edges.fk == edges.tk) & (edges.fid == edges.tid))).select(*cols, F.col("fk").alias("tk_"), F.col("fid").alias("tid_"))
    keys = [c for c in starts.columns if c in ("sid", "nk", "nid")]
    return out.unionByName(back).where(F.col("tid_").isNotNull()).dropDuplicates([*keys, "edge_id"])


def expand(edges: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """The first ``lim`` edges of each node in order of edge id; adds ``nth``."""
    w = Window.partitionBy(*by, "nk", "nid").orderBy("edge_id")
    return incident(edges, nodes).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= F.col("lim"))


def traverse(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Breadth-first expansion of at most two hops from each start.

    starts: (sid, nk, nid, types, lim, hops); edges may hold repeated rows. Returns (sid, kind, id, hops, path,
    ord): nodes at their first discovery, ord being the order of discovery. Each
    node offers its first ``lim`` edges; nodes are expanded in order of discovery
    while fewer than ``lim`` nodes are found, so that one expansion may overshoot.
    The start is never returned. Types null means any.
    """
    first = lambda part, order: F.row_number().over(Window.partitionBy(*part).orderBy(*order)) == 1
    one = expand(edges, starts.where(F.col("hops") >= 1), ["sid"])
    one = one.where(~((F.col("tk_") == F.col("nk")) & (F.col("tid_") == F.col("nid")))).withColumn("pick", first(["sid", "tk_", "tid_"], ["nth"])).where("pick")
    one = one.select("sid", F.col("nk").alias("sk"), F.col("nid").alias("snid"), "types", "lim", "hops", F.col("tk_").alias("kind"), F.col("tid_").alias("id"), F.col("edge_type").alias("t1"), F.row_number().over(Window.partitionBy("sid").orderBy("nth")).alias("d"), F.count(F.lit(1)).over(Window.partitionBy("sid")).alias("n1"))
    near = one.select("sid", "kind", "id", F.lit(1).alias("hop"), F.array("t1").alias("path"), F.col("d").cast("long").alias("ord"))
    parents = one.where("hops >= 2").select("sid", F.col("kind").alias("nk"), F.col("id").alias("nid"), "types", "lim", "sk", "snid", "t1", "d", "n1")
    two = expand(edges, parents, ["sid"])
    seen = one.select("sid", F.col("kind").alias("tk_"), F.col("id").alias("tid_"))
    two = two.where(~((F.col("tk_") == F.col("sk")) & (F.col("tid_") == F.col("snid")))).join(seen, ["sid", "tk_", "tid_"], "left_anti")
    two = two.withColumn("pick", first(["sid", "tk_", "tid_"], ["d", "nth"])).where("pick")
    before = F.coalesce(F.count(F.lit(1)).over(Window.partitionBy("sid").orderBy("d").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    two = two.withColumn("found", F.col("n1") + before).where(F.col("found") < F.col("lim"))
    order = F.row_number().over(Window.partitionBy("sid").orderBy("d", "nth"))
    far = two.select("sid", F.col("tk_").alias("kind"), F.col("tid_").alias("id"), F.lit(2).alias("hop"), F.array("t1", "edge_type").alias("path"), (F.col("n1") + order).cast("long").alias("ord"))
    return near.unionByName(far).withColumnRenamed("hop", "hops")


def edge_points(last: Column, mode: Column, about_docs: Column, about_config: Column, hops: Column) -> Column:
    """Points of a discovery by the last edge of its path, before the graph weight."""
    change, docs = mode.isin("refactor", "bugfix", "testgen"), mode.isin("docs", "architecture")
    base = (
        F.when(last == "TEST_COVERS_SYMBOL", F.when(change, 8.0).otherwise(6.0))
        .when(last == "FILE_CONTAINS_SYMBOL", 5.5)
        .when(last.isin("FILE_IMPORTS_FILE", "APPLIES_TO"), 5.0)
        .when(last == "DOC_DESCRIBES_FILE", F.when(docs | about_docs | about_config, 5.5).otherwise(3.0))
        .when(last == "DOC_DESCRIBES_SYMBOL", F.when(docs | about_docs, 5.0).otherwise(2.0))
        .otherwise(3.0)
    )
    return F.greatest(F.lit(1.0), base - (hops - 1))
