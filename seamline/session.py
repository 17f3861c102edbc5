"""Session and storage helpers shared by all operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", name: str = "seamline") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only on one machine (a local master), where the session names none, a folder
    of this process is made and set; elsewhere executors could not share it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="seamline-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application.

    Spark serves the archive from the driver to every executor, so the cluster
    needs no installation of the package.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="seamline-ship-")) / "seamline_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that a table may have to be broadcast.
BROADCAST_BYTES = 64 << 20


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows of ``df``: contents of strings, arrays and the like, eight bytes for any other value."""

    def width(c: str, kind: str):
        if kind == "string":
            return F.octet_length(c)
        if kind == "binary":
            return F.length(c)
        return F.octet_length(F.to_json(F.struct(c))) if kind[:5] in ("array", "map<s", "struc") or kind.startswith("map") else F.lit(8)

    total = sum((F.coalesce(width(f"`{c}`", t), F.lit(0)) + 8 for c, t in df.dtypes), F.lit(8))
    return df.agg(F.coalesce(F.sum(total.cast("long")), F.lit(0)).alias("b")).first()["b"]


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES, settled: bool = False) -> DataFrame:
    """Broadcast ``df`` only if its measured size is at most ``max_bytes``.

    The table is cut first unless it is ``settled`` already, so that measuring
    does not compute it a second time. A larger table is returned unhinted and
    the join shuffles instead.
    """
    df = df if settled else cut(df)
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df
