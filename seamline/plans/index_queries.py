"""Queries that write an index and read it back, with the SQL of what it must hold."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.providers import provider
from ..operators import catalog
from ..session import shared_dir, table
from .indexing import Index
from .retrieval_queries import _CHAIN, BASE, retrieval


def _index(s, dims=64) -> Index:
    return Index(s, f"{shared_dir(s)}/index-{uuid.uuid4().hex}", provider(dims))


def _texts(s, d):
    """(id, repo_id, path, text) of every file whose text is held."""
    text = table(s, d, "source_files").where("file_id is not null").groupBy(F.col("file_id").alias("id")).agg(F.max("content").alias("text"))
    return catalog.files(table(s, d, "files")).select("id", "repo_id", "path").join(text, "id")


def index_flow(s, d):
    """A first run over two thirds of the texts, then one over trees in which a fifth has changed and a seventh is gone."""
    texts, index = _texts(s, d), _index(s)
    repos = [r["repo_id"] for r in texts.select("repo_id").distinct().collect()]  # sixty repositories at every scale
    index.index_texts(texts.where("id % 3 != 0").select("repo_id", "path", "text"), repos)
    later = texts.where("id % 7 != 0").withColumn("text", F.when(F.col("id") % 5 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("\n# changed"))).otherwise(F.col("text")))
    counts = index.index_texts(later.select("repo_id", "path", "text"), repos)
    held = index.table("files").groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("id").alias("n_ids"))
    symbols = index.table("symbols").groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_symbols"))
    edges = index.table("edges").where("edge_type = 'FILE_CONTAINS_SYMBOL'").groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_contains"))
    vectors = index.table("node_embeddings").groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_vectors"))
    x = counts.join(held, "repo_id").join(symbols, "repo_id", "left").join(edges, "repo_id", "left").join(vectors, "repo_id", "left").fillna(0)
    whole = (F.col("n_symbols") == F.col("n_contains")) & (F.col("n_vectors") == F.col("n_files") + F.col("n_symbols"))
    return x.select("repo_id", "indexed", "skipped", "discovered", "n_files", "n_ids", whole.cast("int").alias("whole"))


def memory_writes(s, d):
    """Every memory created anew, and linked to its repository."""
    index = _index(s, 16)
    old = catalog.memories(table(s, d, "memories"))
    made = index.create_memories(old.select("repo_id", "title", "content", "summary", "memory_type"))
    index.link_memories(made.select(F.col("id").alias("from_memory_id"), F.lit("repo").alias("to_node_kind"), F.col("repo_id").alias("to_node_id")))
    owner = F.coalesce("repo_id", F.lit(-1).cast("long")).alias("owner")
    m = index.table("memories").groupBy(owner, "status", "source").agg(F.count(F.lit(1)).alias("n"))
    v = index.table("node_embeddings").where("node_kind = 'memory' and size(vector) = 16").groupBy(owner).agg(F.count(F.lit(1)).alias("n_vectors"))
    e = index.table("edges").where("from_node_kind = 'memory' and edge_type = 'APPLIES_TO'").groupBy(owner).agg(F.count(F.lit(1)).alias("n_links"), F.sum("weight").alias("weight"))
    return m.join(v, "owner").join(e, "owner")


def retrieval_log_view(s, d):
    """Logs of the query set, written and read back: nodes, best node, packed files, newest first."""
    index = _index(s, 16)
    index.append_logs(retrieval(s, d))
    log = index.table("retrieval_logs")
    n_packed = F.coalesce(F.json_array_length(F.get_json_object("packed_context", "$.files")), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("created_at"), "query_text"))
    return log.select("repo_id", "mode", "query_text", F.size("retrieved_node_ids").alias("n_nodes"), F.element_at("retrieved_node_ids", 1)["node"].alias("best"), F.round(F.element_at("scores", 1)["score"], 4).alias("score"), n_packed.alias("n_packed"), nth.alias("nth")).where("nth <= 10")


QUERIES = {f.__name__: f for f in (index_flow, memory_writes, retrieval_log_view)}

SQL = {
    "index_flow": BASE + """, t AS (SELECT f.id, f.repo_id FROM files_now f JOIN (SELECT DISTINCT file_id FROM source_files WHERE file_id IS NOT NULL) c ON c.file_id = f.id)
 SELECT repo_id, count(*) FILTER (id % 3 = 0 OR id % 5 = 0) AS indexed, count(*) FILTER (id % 3 <> 0 AND id % 5 <> 0) AS skipped, count(*) AS discovered, count(*) AS n_files, count(*) AS n_ids, 1 AS whole FROM t WHERE id % 7 <> 0 GROUP BY 1""",
    "memory_writes": BASE + " SELECT coalesce(repo_id, -1) AS owner, 'active' AS status, 'manual' AS source, count(*) AS n, count(*) AS n_vectors, count(*) AS n_links, count(*)::DOUBLE AS weight FROM mems GROUP BY 1",
    "retrieval_log_view": _CHAIN + """SELECT q.repo_id, mode, text AS query_text, least(count(r.id), 25)::INT AS n_nodes, arg_min(r.kind || ':' || r.id, r.rank) AS best, round(arg_min(r.score, r.rank), 4)::DOUBLE AS score,
  (SELECT count(*) FROM packed p WHERE p.query_id = q.query_id AND p.kind = 'file')::INT AS n_packed, row_number() OVER (PARTITION BY q.repo_id ORDER BY text) AS nth FROM q LEFT JOIN ranking r ON r.query_id = q.query_id GROUP BY q.query_id, q.repo_id, mode, text""",
}
