"""Index maintenance as differences of snapshots: prune, merge, cascade, reconcile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(new: DataFrame, old: DataFrame, key: list[str], digest: str) -> DataFrame:
    """(key..., change): ``added``, ``removed``, ``changed`` or ``same`` between two snapshots."""
    a = new.select(*key, F.col(digest).alias("_new"), F.lit(True).alias("_in_new"))
    b = old.select(*key, F.col(digest).alias("_old"), F.lit(True).alias("_in_old"))
    how = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(F.col("_new").eqNullSafe(F.col("_old")), "same").otherwise("changed")
    return a.join(b, key, "full").select(*key, how.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The old snapshot with the rows of the new one replaced or added."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def prune(old: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """The old snapshot without rows that the latest scan did not see."""
    return old.join(seen.select(*key).distinct(), key, "left_semi")


def cascade(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges (fk, fid, tk, tid) left after their nodes (kind, id) are gone."""
    g = gone.select("kind", "id").distinct()
    left = edges.join(g.select(F.col("kind").alias("fk"), F.col("id").alias("fid")), ["fk", "fid"], "left_anti")
    return left.join(g.select(F.col("kind").alias("tk"), F.col("id").alias("tid")), ["tk", "tid"], "left_anti")


def reconcile(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(kind, n_nodes, n_embedded, n_stale): nodes (kind, id), those with a vector, and vectors of nodes that are gone."""
    n = nodes.select(F.col("kind"), "id", F.lit(1).alias("node"))
    e = embeddings.select(F.col("node_kind").alias("kind"), F.col("node_id").alias("id"), F.lit(1).alias("vec")).distinct()
    both = n.join(e, ["kind", "id"], "full")
    return both.groupBy("kind").agg(F.count("node").alias("n_nodes"), F.count_if(F.col("node").isNotNull() & F.col("vec").isNotNull()).alias("n_embedded"), F.count_if(F.col("node").isNull()).alias("n_stale"))


def outside_nested(files: DataFrame, repos: DataFrame) -> DataFrame:
    """Files (repo_id, full_path) that lie under no other repository registered below their own root.

    Every ancestor folder of a path is looked up by equality, so that no path is
    compared with every root.
    """
    roots = repos.select(F.col("id").alias("other_id"), F.regexp_replace("local_path", "/+$", "").alias("folder"))
    parts = F.split("full_path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    own = roots.select(F.col("other_id").alias("repo_id"), F.length("folder").alias("own_depth"))
    deeper = (
        files.where(F.size(parts) > 2).select("repo_id", "full_path", F.explode(above).alias("folder")).join(roots, "folder").join(own, "repo_id")
        .where((F.col("other_id") != F.col("repo_id")) & (F.length("folder") > F.col("own_depth"))).select("repo_id", "full_path").distinct()
    )
    return files.join(deeper, ["repo_id", "full_path"], "left_anti")
