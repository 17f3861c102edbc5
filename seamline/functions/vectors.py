"""Vector expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product over the shorter length; null vectors give null, empty ones 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    n = F.least(F.size(a), F.size(b))
    d = lambda v: F.slice(v.cast("array<double>"), F.lit(1), n)
    return F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def token_buckets(df: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    """(key, bucket, value): signed bag-of-tokens embedding before normalisation, as sparse rows.

    A token's SHA-256 gives its bucket (first byte modulo dims) and its sign
    (second byte odd: minus); texts without tokens have no rows.
    """
    words = df.select(key, F.explode(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    digest = F.sha2("token", 256)
    byte = lambda k: F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("int")
    return words.select(key, (byte(0) % dims).alias("bucket"), F.when(byte(1) % 2 == 1, -F.col("n")).otherwise(F.col("n")).alias("x")).groupBy(key, "bucket").agg(F.sum("x").cast("double").alias("value"))


def embed(df: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    """(key, vector): dense, of unit length, or all zero."""
    sparse = token_buckets(df, key, text, dims)
    one = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)) / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm")))
    return one.select(key, dense.alias("vector"))


def top_similar(asked: DataFrame, rows: DataFrame, best: int, asked_block: int = 2_000, block: int = 20_000) -> DataFrame:
    """(query_id, vec_id, sim, nth): for each asked (vec_id, embedding) the rows of the greatest positive dot product, itself left out.

    Both sides are cut into blocks by hash; each pair of blocks is one task that
    keeps the best of every query, and these are ranked over all. Ties go to the lower id.
    """
    full = lambda df: df.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).select("vec_id", "embedding")
    asked, rows = full(asked), full(rows)
    n_q, n_r = -(-asked.count() // asked_block) or 1, -(-rows.count() // block) or 1

    def blocks(df, own, own_n, other, other_n, asks):
        every = df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(own_n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))
        return every.select("q", "r", F.lit(asks).alias("asks"), "vec_id", "embedding")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ask, all_ = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        ids, out = all_["vec_id"].to_numpy(), [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        if len(ask) and len(all_):
            v = np.stack(all_["embedding"].to_numpy()).astype(np.float64)
            for i, x in zip(ask["vec_id"].to_numpy(), ask["embedding"]):
                sim = np.round(v @ np.asarray(x, dtype=np.float64), 6)
                ok = np.flatnonzero((sim > 0) & (ids != i))
                ok = ok[np.lexsort((ids[ok], -sim[ok]))][:best]
                out.append((np.full(len(ok), i), ids[ok], sim[ok]))
        return pd.DataFrame({n: np.concatenate([o[j] for o in out]) for j, n in enumerate(("query_id", "vec_id", "sim"))})

    part = blocks(asked, "q", n_q, "r", n_r, True).unionByName(blocks(rows, "r", n_r, "q", n_q, False)).groupBy("q", "r").applyInPandas(run, "query_id long, vec_id long, sim double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id"))
    return part.withColumn("nth", rank).where(F.col("nth") <= best)
