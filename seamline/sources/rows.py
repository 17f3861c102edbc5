"""Row files of evaluation sets and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a .jsonl, .json (a list, or an object with ``data``), .csv or .parquet file; other suffixes raise."""
    suffix = path.rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if suffix in ("jsonl", "ndjson"):
        return reader.json(path)
    if suffix == "json":
        df = spark.read.option("multiLine", True).json(path)
        if df.columns == ["data"]:
            df = df.selectExpr("inline(data)")
        return df if schema is None else df.select(*(c.split()[0] for c in schema.split(",")))
    if suffix == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if suffix == "parquet":
        return reader.parquet(path)
    raise ValueError(f"Unknown row format: {path}")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)
