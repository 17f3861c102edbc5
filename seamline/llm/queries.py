"""Queries of the language-model operators, with SQL where it expresses them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import ann, docpairs, handwritten, leakage, split, tokens, truncation


def p1_pairs(spark, d):
    return docpairs.documented_functions(table(spark, d, "symbols"), table(spark, d, "source_files"))


def p1_found(spark, d):
    return p1_pairs(spark, d).select("symbol_id").distinct()


def p3_pieces(spark, d):
    return split.oversized_pieces(table(spark, d, "symbols"), table(spark, d, "source_files"), table(spark, d, "node_embeddings"))


def p3_found(spark, d):
    return p3_pieces(spark, d).where(F.col("piece") == 1).select("item_kind", "item_id").distinct()


def p6_found(spark, d):
    return ann.similar_pairs(table(spark, d, "node_embeddings"))


def p6_recall(spark, d):
    return ann.recall(table(spark, d, "node_embeddings"))


def p7_ids(spark, d):
    return tokens.encode_documents(table(spark, d, "documents"))


def p7_counts(spark, d):
    return tokens.token_counts(table(spark, d, "documents"))


def p4_labels(spark, d):
    return handwritten.not_handwritten(table(spark, d, "files"))


def p4_found(spark, d):
    return p4_labels(spark, d).select("file_id").distinct()


def p8_found(spark, d):
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark, d):
    return p8_found(spark, d).groupBy("instance_id").agg(F.countDistinct("doc_id").alias("n_docs"))


def p9_found(spark, d):
    return truncation.truncated(table(spark, d, "documents"))


def p9_rates(spark, d):
    return truncation.truncation_rates(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_pairs, p1_found, p3_pieces, p3_found, p4_labels, p4_found, p6_found, p6_recall, p7_ids, p7_counts, p8_found, p8_items, p9_found, p9_rates)
}

SQL = {
    "p3_found": """
SELECT DISTINCT 'symbol' AS item_kind, id AS item_id FROM symbols WHERE abs(line_end - line_start) + 1 > 80
UNION SELECT 'preview', id FROM node_embeddings WHERE length(content_preview) > 250""",
}
