"""Predicates over files, memories and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that give a query its focus, by substring.
DOC_WORDS = ("doc", "docs", "runbook", "decision", "adr", "architecture")
CONFIG_WORDS = ("config", "settings", "provider", "providers")
TEST_WORDS = ("test", "tests", "coverage")
HISTORY_WORDS = ("decision", "runbook", "incident", "architecture", "prior")
CODE_LANGUAGES = ("python", "typescript", "javascript")
CONFIG_LANGUAGES = ("toml", "yaml", "json")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_test() -> Column:
    return _yes(F.array_contains("tags", "test")) | _yes(F.col("path").startswith("tests/")) | _yes(F.contains("path", F.lit("/test")))


def is_doc() -> Column:
    return _yes(F.col("path").startswith("docs/")) | _yes(F.col("language") == "markdown")


def is_config() -> Column:
    return _yes(F.col("path").startswith("config/")) | _yes(F.col("language").isin(*CONFIG_LANGUAGES))


def is_code() -> Column:
    return _yes(F.col("language").isin(*CODE_LANGUAGES))


def is_support() -> Column:
    return is_test() | is_doc() | is_config()


def focused(text: Column | str, words: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join(words))


def mentions(text: str, words: tuple[str, ...]) -> bool:
    """``focused`` for a query known to the driver."""
    return any(w in text.lower() for w in words)
