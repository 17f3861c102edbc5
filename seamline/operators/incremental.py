"""Processing only new or changed records.

``StateStore`` keeps the content hash of every processed key in numbered
versions. A run hashes the current rows, joins them with the state, processes
what is new or changed, and commits. A commit writes the touched buckets of the
state, and with them the run's output if it has any, under names of its own and
then claims the next version number for a manifest that refers to them, in one
operation that fails if the number is taken. So a run that dies at any point
leaves the previous version in force, of two runs at once none loses what it
committed, and output and state become visible together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import checksum, plain
from ..session import shared_dir
from .versions import Versions, VersionTaken

#: Parts of a state; a commit rewrites only those that hold a processed key.
BUCKETS = 32
#: Times that a commit is merged again after another writer took its version.
ATTEMPTS = 8


def newest(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row per key: that of the greatest ``order`` (nulls least), ties by the kept values."""
    picked = F.max_by(F.struct(*keep), F.struct(*order, *keep)).alias("r")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(picked).select(key, "r.*")


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``content_hash``: SHA-256 over the named columns; null differs from empty."""
    return df.withColumn("content_hash", F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


def succeeded_state(state: DataFrame, runs: DataFrame) -> DataFrame:
    """(file_id, seen): checksum of each file's latest state row among succeeded runs."""
    good = runs.where(plain("status") == "succeeded").select("run_id").distinct()
    rows = state.join(good, "run_id", "left_semi").select("file_id", "processed_at", "run_id", checksum("checksum").alias("seen"))
    return newest(rows, "file_id", ["processed_at", "run_id"], ["seen"])


def pending_files(files: DataFrame, state: DataFrame, runs: DataFrame, root: str | None = None) -> DataFrame:
    """(file_id, reason) of the files that the next run has to process, each once.

    The state of succeeded runs is committed to a ``StateStore`` below ``root``
    (a new folder of the shared folder if none is given) and the current rows,
    those of the latest indexed_at, are compared with it. reason is ``unknown``
    (no checksum), ``new`` (no state) or ``changed``. Empty state makes
    everything new; an empty table gives no rows; files that only the state
    knows are not reported.
    """
    spark = files.sparkSession
    store = StateStore(spark, root or f"{shared_dir(spark)}/state-{uuid.uuid4().hex}", "file_id")
    digest = lambda c: F.sha2(c, 256).alias("content_hash")
    store.commit(succeeded_state(state, runs).select("file_id", digest("seen")))
    rows = files.select(F.col("id").alias("file_id"), "indexed_at", checksum("checksum").alias("now"))
    current = newest(rows, "file_id", ["indexed_at"], ["now"]).select(F.col("file_id").cast("string").alias("file_id"), digest("now"))
    return store.changed(current).select(F.col("file_id").cast("long").alias("file_id"), F.col("change").alias("reason"))


class StateStore(Versions):
    """Versioned (key, content_hash) state.

    The manifest of a version names the folder of each bucket, the run's output
    if it has any, and the last epoch of each stream.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "key", buckets: int = BUCKETS):
        super().__init__(spark, root)
        self.key, self.buckets = key, buckets

    def _manifest(self, version: int) -> dict:
        return self._load(version) if version else {"buckets": {}, "output": None, "epochs": {}}

    def _parts(self, manifest: dict, only: set[str] | None = None) -> DataFrame:
        folders = sorted({f for b, f in manifest["buckets"].items() if only is None or b in only})
        schema = f"{self.key} string, content_hash string"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders))

    def read(self, version: int | None = None) -> DataFrame:
        """(key, content_hash) of the version in force, or of an earlier one."""
        return self._parts(self._manifest(self.version() if version is None else version))

    def outputs(self) -> DataFrame | None:
        """All output committed so far; None if there is none."""
        folders = [m["output"] for m in map(self._manifest, self._versions()) if m["output"]]
        return self.spark.read.parquet(*(f"{self.root}/{f}" for f in folders)) if folders else None

    def epoch(self, stream: str) -> int:
        """The last epoch of a stream that was committed; -1 before the first."""
        return self._manifest(self.version())["epochs"].get(stream, -1)

    def changed(self, rows: DataFrame) -> DataFrame:
        """Rows (key, content_hash, ...) that the state lacks or holds with another hash, with ``change``.

        change is ``unknown`` (null hash), ``new`` or ``changed``. Each key comes
        once, with its greatest hash if it has several, and among rows of one
        hash the greatest by the other columns that can be ordered. Null keys are
        left out.
        """
        old = self.read().select(F.col(self.key).alias("_key"), F.col("content_hash").alias("_seen"), F.lit(True).alias("_known"))
        rest = [c for c, t in rows.dtypes if c not in (self.key, "content_hash") and "map<" not in t and t != "variant"]
        picked = F.max_by(F.struct(*(c for c in rows.columns if c != self.key)), F.struct("content_hash", *rest))
        rows = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(picked.alias("_r")).select(self.key, "_r.*")
        change = F.when(F.col("content_hash").isNull(), "unknown").when(F.col("_known").isNull(), "new").when(~F.col("content_hash").eqNullSafe(F.col("_seen")), "changed")
        joined = rows.join(old, F.col(self.key).cast("string") == F.col("_key"), "left").withColumn("change", change)
        return joined.where(F.col("change").isNotNull()).drop("_key", "_seen", "_known")

    def commit(self, processed: DataFrame, output: DataFrame | None = None, stream: str | None = None, epoch: int = -1, attempts: int = ATTEMPTS) -> int:
        """Merge processed (key, content_hash) into the state; returns the new version.

        ``output`` is written once and becomes visible with the version. If
        another writer takes the version first, the state is merged again over
        the winner's; after ``attempts`` VersionTaken is raised and nothing is
        changed. A stream's epoch that is committed already changes nothing.
        """
        made = None
        if output is not None:
            made = f"output-{uuid.uuid4().hex}"
            output.write.parquet(f"{self.root}/{made}")
        for _ in range(attempts):
            base = self.version()
            manifest = self._manifest(base)
            if stream is not None and epoch <= manifest["epochs"].get(stream, -1):
                return base
            try:
                return self._swap(base, manifest, processed, made, stream, epoch)
            except VersionTaken:
                continue
        raise VersionTaken(f"{self.root}: {attempts} commits lost to other writers")

    def _swap(self, base: int, manifest: dict, processed: DataFrame, output: str | None, stream: str | None, epoch: int) -> int:
        of = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        new = processed.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast("string").alias(self.key), "content_hash", F.lit(1).alias("_r"))
        old = None
        if manifest["buckets"]:
            touched = {str(r["bucket"]) for r in new.select(of).distinct().collect()}  # at most one row a bucket
            old = self._parts(manifest, touched).select(self.key, "content_hash", F.lit(0).alias("_r"))
        both = new if old is None else old.unionByName(new)
        merged = both.select("*", of).repartition("bucket").groupBy("bucket", self.key).agg(F.max_by("content_hash", F.struct("_r", "content_hash")).alias("content_hash"))
        folder = f"state-{uuid.uuid4().hex}"
        merged.write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        written = {n[7:]: f"{folder}/{n}" for n in self._names(folder) if n.startswith("bucket=")}
        epochs = {**manifest["epochs"], **({stream: epoch} if stream is not None else {})}
        self._claim(base + 1, {"buckets": {**manifest["buckets"], **written}, "output": output, "epochs": epochs})
        return base + 1

    def vacuum(self, keep: int = 2) -> int:
        """Delete state folders that none of the last ``keep`` versions refers to; returns their number.

        Not to be run beside a commit. Output is kept.
        """
        used = {f.split("/")[0] for v in self._versions()[-keep:] for f in self._manifest(v)["buckets"].values()}
        dead = [n for n in self._names() if n.startswith("state-") and n not in used]
        for n in dead:
            self._fs.delete(self._path(f"{self.root}/{n}"), True)
        return len(dead)
