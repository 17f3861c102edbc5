"""Most similar vectors for every vector, by cross-polytope hashing.

Unit vectors are pseudo-rotated by three rounds of random signs and a Hadamard
transform and assigned to the nearest signed axis. Each table keeps a vector
under its nearest axis and probes the next nearest ones; vectors that meet in a
bucket are candidates and are reranked by their cosine. Vectors travel as 16-bit
integers with one scale, whose cosines are off by about 1e-5; wherever that
could change the result, cosines are recomputed from the stored vectors.

Code length follows the number of vectors, so that an ordinary bucket stays
small. A bucket that is still crowded, as when a third of all vectors lie close
together, is compared whole: it is cut into blocks, and every two blocks meet in
a task of their own. Hashing it again would lose neighbours, since within a tight
group they are only weakly alike in what distinguishes them from the mean.
Equal vectors are compared once per bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import node_kind
from ..session import broadcast_if_small, cut

TABLES, PROBES, PROBE_RATIO = 2, 3, 0.8
#: Vectors a bucket is meant to hold; above CROWD rows it is compared in blocks of BLOCK rows.
BUCKET, CROWD, BLOCK = 7_000, 40_000, 20_000
#: Error bound of a cosine of 16-bit vectors, with room.
SLACK = 2e-4
SEED = 20240


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.float32(math.sqrt(d))


def rotate(unit: np.ndarray, which: int) -> np.ndarray:
    """Pseudo-random rotation number ``which`` of the rows, padded to a power of two."""
    n, dim = unit.shape
    d = 1 << max(1, (dim - 1).bit_length())
    x = np.zeros((n, d), dtype=np.float32)
    x[:, :dim] = unit
    signs = np.random.default_rng([SEED, which, d]).choice(np.array([-1, 1], dtype=np.float32), size=(3, d))
    for s in signs:
        x = hadamard(x * s)
    return x


def nearest_axes(rotated: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, scores) of the nearest signed axes, best first."""
    size = np.abs(rotated)
    probes = min(probes, size.shape[1])
    order = np.argpartition(-size, probes - 1, axis=1)[:, :probes]
    order = np.take_along_axis(order, np.argsort(-np.take_along_axis(size, order, 1), axis=1, kind="stable"), 1)
    return order * 2 + (np.take_along_axis(rotated, order, 1) > 0), np.take_along_axis(size, order, 1)


def extra_axes(vectors: int, bucket: int = BUCKET) -> int:
    """Axes of a second, coarser code, so that ``vectors`` spread to about ``bucket`` each."""
    need = vectors / bucket / 128
    return 0 if need <= 1 else min(64, 1 << max(0, math.ceil(math.log2(need / 2))))


def probe_codes(unit: np.ndarray, table: int, extra: int, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """(codes, used) per row and probe; the first probe is the vector's own bucket."""
    rotated = rotate(unit, 2 * table)
    codes, score = nearest_axes(rotated, probes)
    used = score >= PROBE_RATIO * score[:, :1]
    if extra:
        folded = rotate(unit, 2 * table + 1)[:, :extra]
        more, mscore = nearest_axes(folded, 2 if extra > 1 else 1)
        grid = [(codes[:, i], more[:, j], used[:, i] & (mscore[:, j] >= PROBE_RATIO * mscore[:, 0])) for i in range(codes.shape[1]) for j in range(more.shape[1])]
        codes = np.stack([a * 2 * extra + b for a, b, _ in grid], axis=1)
        used = np.stack([u for *_, u in grid], axis=1)
    return codes, used


def pack(unit: np.ndarray) -> list[bytes]:
    scale = np.maximum(np.abs(unit).max(axis=1, keepdims=True), 1e-30)
    return [r.tobytes() for r in np.rint(unit / scale * 32767).astype("<i2")]


def unpack(packed) -> np.ndarray:
    q = np.frombuffer(b"".join(packed), dtype="<i2").reshape(len(packed), -1).astype(np.float32)
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """(id, grp, vector): null ids and kinds, null or empty vectors are left out; grp is kind and actual length."""
    return vectors.where(F.col("id").isNotNull() & F.col("node_kind").isNotNull() & (F.size("vector") > 0)).select(
        "id", F.concat_ws(":", node_kind("node_kind"), F.size("vector")).alias("grp"), "vector"
    )


def hash_vectors(clean: DataFrame, extra: dict[str, int]) -> DataFrame:
    """(id, grp, packed, codes): each code with its table and whether it is the vector's own.

    Zero vectors and such with a null or non-finite number are dropped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for grp, rows in b.groupby("grp", sort=False):
                x = np.array([np.asarray(v, dtype=np.float64) for v in rows["vector"]])
                peak = np.abs(x).max(axis=1)
                ok = np.isfinite(peak) & (peak > 0)
                x = x[ok] / peak[ok, None]
                if not len(x):
                    continue
                unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                codes = [[] for _ in range(len(unit))]
                for t in range(TABLES):
                    c, used = probe_codes(unit, t, extra.get(grp, 0))
                    for r, p in zip(*np.nonzero(used)):
                        codes[r].append((int(c[r, p]) << 8 | t << 1 | (p == 0)))
                yield pd.DataFrame({"id": rows["id"].to_numpy()[ok], "grp": grp, "packed": pack(unit), "codes": codes})

    return clean.mapInPandas(run, "id long, grp string, packed binary, codes array<long>")


def _bucket_rows(hashed: DataFrame) -> DataFrame:
    code = F.explode("codes").alias("c")
    return hashed.select("id", "packed", "grp", code).select(F.xxhash64("grp", F.shiftright("c", 1)).alias("bucket"), (F.col("c") % 2 == 1).alias("own"), "id", "packed")


def block_crowded(rows: DataFrame, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """Cut crowded buckets into blocks; every two blocks of a bucket become a bucket, so that all its vectors still meet.

    Equal vectors stay in one block. The work of a crowded bucket grows with the
    square of its rows, spread over as many tasks as there are pairs of blocks.
    """
    crowded = cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("bucket", F.greatest(F.lit(2), F.ceil(F.col("n") / block)).cast("int").alias("blocks")))
    if crowded.isEmpty():
        return rows
    keys = broadcast_if_small(crowded, settled=True)
    hot = rows.join(keys, "bucket").withColumn("block", F.pmod(F.xxhash64("packed"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block != other")
    met = hot.select(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"), "own", "id", "packed")
    return rows.join(keys, "bucket", "left_anti").unionByName(met)


def _best_of(ids: np.ndarray, own: np.ndarray, packed: list[bytes], keep: int, least: float) -> Iterator[tuple]:
    """(src, dst, cosine) arrays: for each vector of a bucket its ``keep`` most similar others."""
    _, first = np.unique(ids * 2 + ~own, return_index=True)  # own copy of an id first
    first = first[np.concatenate([[True], ids[first][1:] != ids[first][:-1]])]
    ids, own = ids[first], own[first]
    blob = np.array([packed[i] for i in first], dtype=object)
    classes: dict[bytes, int] = {}
    of = np.array([classes.setdefault(x, len(classes)) for x in blob], dtype=np.int64)  # ids are ascending, so are each class's members
    if len(ids) < 2:
        return
    order = np.argsort(of, kind="stable")
    begin = np.searchsorted(of[order], np.arange(len(classes) + 1))
    v = unpack(list(classes))
    any_own = np.zeros(len(classes), dtype=bool)
    np.logical_or.at(any_own, of, own)
    home = np.flatnonzero(any_own)
    if len(classes) < len(ids):  # equal vectors: the lowest other ids of the class, for every member
        for c in np.flatnonzero(np.diff(begin) > 1):
            members = ids[order[begin[c] : begin[c + 1]]]
            low = members[: keep + 1]
            src, dst = np.repeat(members, len(low)), np.tile(low, len(members))
            other = src != dst
            yield src[other], dst[other], np.ones(other.sum())
    step = max(1, 8_000_000 // max(1, len(classes)))
    for side in (0, 1):
        rows, cols = (home, np.arange(len(classes))) if side == 0 else (np.flatnonzero(~any_own), home)
        if not len(rows) or not len(cols):
            continue
        right = v[cols].T
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            sim = v[part] @ right
            sim[part[:, None] == cols[None, :]] = -2
            k = min(keep, sim.shape[1])
            top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            score = np.take_along_axis(sim, top, 1)
            r, j = np.nonzero(score >= least)
            a, b, s = part[r], cols[top[r, j]], score[r, j].astype(np.float64)
            if len(classes) == len(ids):
                yield ids[order[begin[a]]], ids[order[begin[b]]], s
                continue
            for x, y, z in zip(a, b, s):
                members, low = ids[order[begin[x] : begin[x + 1]]], ids[order[begin[y] : begin[y + 1]]][:keep]
                yield np.repeat(members, len(low)), np.tile(low, len(members)), np.full(len(low) * len(members), z)


def candidates(rows: DataFrame, keep: int, least: float) -> DataFrame:
    """(src, dst, cosine): within each bucket the best ``keep`` of every vector, from ``least`` on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(parts):
            ids, own, packed = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [x for p in parts for x in p[2]]
            return _best_of(ids, own, packed, keep, least)

        def emit(found):
            out = [x for x in found if len(x[0])]
            return pd.DataFrame({k: np.concatenate([x[i] for x in out]) for i, k in enumerate(("src", "dst", "cosine"))}) if out else None

        now, parts, found, held = None, [], [], 0
        for b in batches:
            bucket, ids, own, packed = b["bucket"].to_numpy(), b["id"].to_numpy(), b["own"].to_numpy(dtype=bool), b["packed"].tolist()
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() + [len(bucket)]
            for lo, hi in zip(edges, edges[1:]):
                if bucket[lo] != now and parts:
                    for x in done(parts):
                        found.append(x)
                        held += len(x[0])
                        if held > 200_000:
                            yield emit(found)
                            found, held = [], 0
                    parts = []
                now = bucket[lo]
                parts.append((ids[lo:hi], own[lo:hi], packed[lo:hi]))
        if parts:
            found += list(done(parts))
        if (last := emit(found)) is not None:
            yield last

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, "src long, dst long, cosine double")


def _exact(pairs: DataFrame, clean: DataFrame) -> DataFrame:
    """Pairs (src, dst) with the cosine of the stored vectors."""
    wanted = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).distinct()
    v = clean.join(broadcast_if_small(wanted), "id", "left_semi").groupBy("id").agg(F.first("vector").alias("v"))
    x = v.select(F.col("id").alias("src"), F.col("v").alias("a"))
    y = v.select(F.col("id").alias("dst"), F.col("v").alias("b"))

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(p, q):
            p, q = np.asarray(p, dtype=np.float64), np.asarray(q, dtype=np.float64)
            p, q = p / np.abs(p).max(), q / np.abs(q).max()
            return float(p @ q / np.sqrt((p @ p) * (q @ q)))

        return pd.Series([one(p, q) for p, q in zip(a, b)], dtype="float64")

    return pairs.select("src", "dst").join(x, "src").join(y, "dst").select("src", "dst", cosine("a", "b").alias("cosine"))


def nearest_neighbours(vectors: DataFrame, k: int = 5, least: float = 0.9, crowd: int = CROWD, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """(src, dst, cosine, rank): for every vector its k most similar of the same kind and length.

    Only cosines of at least ``least`` count. Null, zero and non-finite vectors
    have no neighbours; repeated rows count once; equal cosines rank by the lower
    id; magnitude does not matter; an empty table gives no rows.
    """
    clean = clean_vectors(vectors)
    extra = {r["grp"]: extra_axes(r["n"], bucket) for r in clean.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 128 * bucket).collect()}  # one row per kind and length
    hashed = cut(hash_vectors(clean, extra))
    rows = block_crowded(_bucket_rows(hashed), crowd, block)
    found = cut(candidates(rows, k + 3, least - SLACK).groupBy("src", "dst").agg(F.max("cosine").alias("cosine")))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.round("cosine", 6).desc(), "dst"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k + 3)
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("cosine")))
    unsure = F.coalesce((at(k) < 1 - SLACK) & (at(k) - at(k + 1) < SLACK / 4), F.lit(False)) | F.max((F.col("rank") <= k) & (F.abs(F.col("cosine") - least) < SLACK))
    doubtful = cut(ranked.groupBy("src").agg(unsure.alias("unsure")).where("unsure").select("src"))
    top = lambda df: df.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("cosine") >= least)).select("src", "dst", "cosine", "rank")
    if doubtful.isEmpty():
        return top(ranked)
    small = broadcast_if_small(doubtful, settled=True)
    return top(ranked.join(small, "src", "left_anti")).unionByName(top(_exact(ranked.join(small, "src", "left_semi"), clean)))


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.9) -> DataFrame:
    """(id_a, id_b), id_a < id_b: one is among the k most similar of the other."""
    n = nearest_neighbours(vectors, k, least)
    return n.select(F.least("src", "dst").alias("id_a"), F.greatest("src", "dst").alias("id_b")).distinct()


def brute_force(vectors: DataFrame, queries: DataFrame, k: int = 5, least: float = 0.9) -> DataFrame:
    """(src, dst, cosine) of a stated query set (id) against all rows; to measure recall.

    Queries and rows are cut into blocks of bounded size by hash; each pair of
    blocks is one task that keeps the k best per query, and the blocks' results
    are merged to the k best over all.
    """
    clean = cut(hash_vectors(clean_vectors(vectors), {}).select("id", "grp", "packed").dropDuplicates(["id"]))
    asked = clean.join(queries.select("id").distinct(), "id", "left_semi")
    n_q, n_r = -(-asked.count() // 4_000) or 1, -(-clean.count() // 20_000) or 1

    def blocks(df, own, own_n, other, other_n, asks):
        every = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))
        return every.select(F.pmod(F.xxhash64("id"), F.lit(own_n)).cast("int").alias(own), other, "grp", F.lit(asks).alias("asks"), "id", "packed").select("q", "r", "grp", "asks", "id", "packed")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ask, all_ = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        if len(ask) and len(all_):
            v, ids = unpack(all_["packed"].tolist()), all_["id"].to_numpy()
            for i, x in zip(ask["id"].to_numpy(), unpack(ask["packed"].tolist())):
                s = v @ x
                s[ids == i] = -2
                best = np.flatnonzero(s >= least)
                best = best[np.lexsort((ids[best], -np.round(s[best], 6)))][:k]
                out.append((np.full(len(best), i), ids[best], s[best].astype(float)))
        return pd.DataFrame({n: np.concatenate([o[j] for o in out]) for j, n in enumerate(("src", "dst", "cosine"))})

    part = blocks(asked, "q", n_q, "r", n_r, True).unionByName(blocks(clean, "r", n_r, "q", n_q, False)).groupBy("q", "r", "grp").applyInPandas(run, "src long, dst long, cosine double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.round("cosine", 6).desc(), "dst"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def recall(vectors: DataFrame, every: int = 50, k: int = 5, least: float = 0.9) -> DataFrame:
    """(n_true, n_found, recall) over the queries whose id is divisible by ``every``."""
    true = brute_force(vectors, vectors.where(F.col("id") % every == 0), k, least).select("src", "dst")
    got = nearest_neighbours(vectors, k, least).select("src", "dst", F.lit(1).alias("hit"))
    both = true.join(got, ["src", "dst"], "left")
    return both.agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
