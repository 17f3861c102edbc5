"""Evaluation: gold spans, span recall, baseline retriever, row accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

GOLD_SCHEMA = "array<struct<file: string, start_line: int, end_line: int, content: string>>"
# What a baseline walk over a tree leaves out and takes in.
SKIPPED_DIRS = (".git", "__pycache__", ".pytest_cache", ".venv", "node_modules", "build", "dist")
TAKEN_SUFFIXES = (".py", ".md", ".rst", ".toml", ".yaml", ".yml", ".json", ".cfg", ".ini")
#: Characters of a text that the baseline looks at; its definition, as is the limit on its terms.
BASELINE_CHARS, BASELINE_TERMS = 8000, 80


def plain_path(c: Column | str) -> Column:
    """Path without leading dots and slashes, with forward slashes."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^[./]+", "")


def gold_spans(items: DataFrame) -> DataFrame:
    """(instance_id, nth, file, first, last) from the JSON gold; null or broken gold has no rows."""
    one = items.select("instance_id", "gold_context").distinct()
    return one.select("instance_id", F.posexplode(F.from_json("gold_context", GOLD_SCHEMA)).alias("nth", "g")).select("instance_id", "nth", plain_path("g.file").alias("file"), F.col("g.start_line").alias("first"), F.col("g.end_line").alias("last"))


def span_hits(gold: DataFrame, spans: DataFrame) -> DataFrame:
    """Gold rows that a span (file, low, high) of the same file overlaps; each at most once."""
    return gold.join(spans, (gold["file"] == spans["file"]) & (gold["first"] <= spans["high"]) & (gold["last"] >= spans["low"]), "left_semi")


def skipped_path(c: Column | str) -> Column:
    """Whether a baseline walk passes over a path; a name that is nothing but a suffix has none."""
    return F.arrays_overlap(F.split(c, "/"), F.array(*map(F.lit, SKIPPED_DIRS))) | ~F.lower(c).rlike("[^/](" + "|".join(s.replace(".", r"\.") for s in TAKEN_SUFFIXES) + ")$")


def baseline_terms(text: Column | str) -> Column:
    """Distinct words of a question of three characters or more that are no stopwords, without variants."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.slice(F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 3) & ~t.isin(*T.STOPWORDS))), 1, BASELINE_TERMS)


def baseline_score(terms: Column | str, path: Column | str, text: Column | str) -> Column:
    """Points of a file for the terms of a question: name 8, path 5, first BASELINE_CHARS characters 1."""
    p, x = F.lower(path), F.lower(F.substring(F.coalesce(text, F.lit("")), 1, BASELINE_CHARS))
    name = F.substring_index(p, "/", -1)
    return T.total(terms, lambda t: T.points((F.contains(name, t), 8), (F.contains(p, t), 5), (F.contains(x, t), 1)))


def span_recall(gold: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n_spans, n_hit, recall): share of the gold spans (keys, file, first, last) that a span (keys, file, low, high) overlaps.

    Gold without lines does not count; where there is none, or no span at all,
    there is no row.
    """
    g = gold.where("first is not null and last is not null").select(*keys, "file", "first", "last").withColumn("gold_id", F.xxhash64("file", "first", "last"))
    s = spans.where("low is not null and high is not null").select(*keys, "file", "low", "high")
    hit = g.join(s, [*keys, "file"]).where("first <= high and last >= low").select(*keys, "gold_id").distinct().withColumn("hit", F.lit(1))
    rows = g.join(s.select(*keys).distinct(), keys, "left_semi").join(hit, [*keys, "gold_id"], "left").groupBy(*keys)
    return rows.agg(F.count(F.lit(1)).alias("n_spans"), F.count("hit").alias("n_hit"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))
