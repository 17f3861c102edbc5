"""Current rows of the index tables.

Every table may deliver rows more than once; ``files`` also in several versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.keys import node_kind, plain


def files(df: DataFrame) -> DataFrame:
    """Latest version of each file (null dates are oldest; ties by the greater checksum), with its classes."""
    keep = ["repo_id", "path", "language", "checksum", "summary", "imports", "tags", "indexed_at", F.element_at("metadata_json", "content_excerpt").alias("excerpt")]
    one = df.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct(*keep), F.struct("indexed_at", "checksum")).alias("f")).select("id", "f.*")
    return one.withColumns({"is_test": classify.is_test(), "is_doc": classify.is_doc(), "is_config": classify.is_config(), "is_code": classify.is_code(), "is_support": classify.is_support()})


def once(df: DataFrame, key: str = "id") -> DataFrame:
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])


def symbols(df: DataFrame) -> DataFrame:
    return once(df.select("id", "repo_id", "file_id", "parent_symbol_id", "name", "qualified_name", plain("symbol_type").alias("symbol_type"), "language", "line_start", "line_end", "signature", "docstring", "summary"))


def memories(df: DataFrame) -> DataFrame:
    return once(df.select("id", "repo_id", "title", "content", "summary", "memory_type", plain("status").alias("status"), "source", "confidence", "created_at", "updated_at"))


def edge_rows(df: DataFrame) -> DataFrame:
    """Rows of edges in normal form: (id, repo_id, fk, fid, tk, tid, edge_type, weight); repeats remain."""
    return df.where(F.col("id").isNotNull()).select(
        "id", "repo_id", node_kind("from_node_kind").alias("fk"), F.col("from_node_id").alias("fid"), node_kind("to_node_kind").alias("tk"), F.col("to_node_id").alias("tid"), F.upper(plain("edge_type")).alias("edge_type"), "weight"
    )


def edges(df: DataFrame) -> DataFrame:
    return once(edge_rows(df))


def embedding_rows(df: DataFrame) -> DataFrame:
    """Rows of node_embeddings with the kind in normal form; repeats remain."""
    return df.where(F.col("id").isNotNull()).select("id", "repo_id", node_kind("node_kind").alias("node_kind"), "node_id", "embedding_role", "model_name", "dimensions", "vector", "content_preview")


def embeddings(df: DataFrame) -> DataFrame:
    return once(embedding_rows(df))
