"""References whose parent record is missing, deleted or later than the reference.

Parent keys are integers. Per table and block of 2**16 keys the sorted keys are
compressed into contiguous runs; every distinct referenced key is matched as-of
to the preceding run start and is an orphan if it lies beyond the run's end. A
block bounds what one task sorts, whatever the number of references to a key,
since references are first aggregated to one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import node_kind
from ..session import cut

BLOCK_BITS = 16
SALTS = 8


def key_runs(keys: DataFrame) -> DataFrame:
    """(kind, key) -> (kind, block, run_start, run_end), contiguous within a block.

    Repeated keys count once; null keys are dropped; an empty table has no runs.
    """
    block = F.shiftright("key", BLOCK_BITS).alias("block")
    once = keys.where(F.col("key").isNotNull()).select("kind", block, "key").distinct()
    n = F.row_number().over(Window.partitionBy("kind", "block").orderBy("key"))
    return (
        once.withColumn("island", F.col("key") - n)
        .groupBy("kind", "block", "island")
        .agg(F.min("key").alias("run_start"), F.max("key").alias("run_end"))
        .drop("island")
    )


def beyond_runs(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """The (kind, key) rows of ``refs`` that lie in no run: as-of match to run starts."""
    events = (
        refs.select("kind", F.shiftright("key", BLOCK_BITS).alias("block"), F.col("key").alias("at"), F.lit(None).cast("bigint").alias("run_end"), F.lit(1).alias("side"))
        .unionByName(runs.select("kind", "block", F.col("run_start").alias("at"), "run_end", F.lit(0).alias("side")))
    )
    w = Window.partitionBy("kind", "block").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        events.withColumn("reach", F.last("run_end", ignorenulls=True).over(w))
        .where((F.col("side") == 1) & (F.col("reach").isNull() | (F.col("at") > F.col("reach"))))
        .select("kind", F.col("at").alias("key"))
    )


def edge_references(edges: DataFrame) -> DataFrame:
    """Both ends of every edge: (edge_id, side, kind, key, made_at)."""
    ends = F.array(
        F.struct(F.lit("from").alias("side"), node_kind("from_node_kind").alias("kind"), F.col("from_node_id").alias("key")),
        F.struct(F.lit("to").alias("side"), node_kind("to_node_kind").alias("kind"), F.col("to_node_id").alias("key")),
    )
    return (
        edges.select(F.col("id").alias("edge_id"), F.col("created_at").alias("made_at"), F.explode(ends).alias("e"))
        .select("edge_id", "made_at", "e.side", "e.kind", "e.key")
        .where(F.col("key").isNotNull() & F.col("kind").isin("file", "symbol", "memory", "repo"))
    )


def parent_keys(files: DataFrame, symbols: DataFrame, memories: DataFrame, repos: DataFrame) -> DataFrame:
    """(kind, key, first_seen): one row per existing record, with its earliest date."""

    def earliest(df, kind, at):
        return df.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("key")).agg(F.min(at).alias("first_seen")).select(F.lit(kind).alias("kind"), "key", "first_seen")

    f = earliest(files.select("id", "indexed_at"), "file", "indexed_at")
    of_file = f.select(F.col("key").alias("file_id"), "first_seen")
    known = symbols.where(F.col("id").isNotNull()).select("id", "file_id").distinct()
    # symbols without a file have no date; they take no part in the join, where they would all share one key
    s = known.where("file_id is not null").join(of_file, "file_id", "left").select("id", "first_seen")
    s = s.unionByName(known.where("file_id is null").select("id", F.lit(None).cast(dict(f.dtypes)["first_seen"]).alias("first_seen")))
    return (
        f.unionByName(earliest(s, "symbol", "first_seen"))
        .unionByName(earliest(memories.select("id", "created_at"), "memory", "created_at"))
        .unionByName(earliest(repos.select("id", "created_at"), "repo", "created_at"))
    )


def orphan_references(refs: DataFrame, parents: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(edge_id, side, kind, key, made_at, state) of references that are missing, deleted or late.

    refs: (edge_id, side, kind, key, made_at); parents: (kind, key, first_seen);
    tombstones: (kind, key). Defined cases: repeated references come out once;
    a null key or a kind without a table is no case; a null made_at or a parent
    without a date is never late; a key in both its table and the tombstones
    exists. A key that very many references share is salted for the last join,
    and what a salt still leaves too large adaptive execution splits, as the
    other side has each key once. References are aggregated once and written.
    """
    used = cut(refs.groupBy("kind", "key").agg(F.min("made_at").alias("first_use")))
    absent = beyond_runs(used, key_runs(parents))
    gone = tombstones.where(F.col("key").isNotNull()).select("kind", "key").distinct().withColumn("was", F.lit(True))
    absent = absent.join(gone, ["kind", "key"], "left").select(
        "kind", "key", F.when(F.col("was"), "deleted").otherwise("missing").alias("state"), F.lit(None).cast("timestamp_ntz").alias("first_seen")
    )
    late = (
        used.join(parents, ["kind", "key"])
        .where(F.col("first_use") < F.col("first_seen"))
        .select("kind", "key", F.lit("late").alias("state"), F.col("first_seen").cast("timestamp_ntz").alias("first_seen"))
    )
    found = absent.unionByName(late).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        refs.withColumn("salt", F.pmod(F.hash("edge_id", "side"), F.lit(SALTS)))
        .join(found, ["kind", "key", "salt"])
        .where((F.col("state") != "late") | (F.col("made_at") < F.col("first_seen")))
        .select("edge_id", "side", "kind", "key", "made_at", "state")
        .distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, state and month of the reference; undated ones under a null month."""
    return orphans.groupBy(F.col("kind").alias("table_kind"), "state", F.date_format("made_at", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("key").alias("n_keys"))
