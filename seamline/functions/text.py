"""Text expressions: tokens, variants, term scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode non-word characters in both Java and DuckDB (their ``\W`` is ASCII only).
NON_WORD = r"[^\p{L}\p{N}_]+"
MAX_TERMS = 80
# Words that are no query terms.
STOPWORDS = (
    "about", "after", "also", "and", "are", "because", "been", "before", "but", "can", "could", "does", "for", "from", "had", "has", "have", "how", "into",
    "not", "our", "out", "same", "should", "than", "that", "the", "then", "there", "these", "this", "when", "where", "which", "while", "with", "would", "you",
)


def pieces(c: Column | str, least: int, pattern: str = NON_WORD) -> Column:
    """Non-word-separated pieces of at least ``least`` characters; null gives an empty list."""
    return F.filter(F.split(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")), pattern), lambda t: F.length(t) >= least)


def variants(t: Column) -> Column:
    """The term and its singular, plural and stem."""
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return F.array_compact(
        F.array(
            t,
            F.when(t.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y"))),
            F.when(t.endswith("s") & (n > 4), cut(1)).otherwise(F.concat(t, F.lit("s"))),
            F.when(t.endswith("ing") & (n > 5), cut(3)),
            F.when(t.endswith("ed") & (n > 4), cut(2)),
        )
    )


def query_terms(text: Column | str) -> Column:
    """Distinct search terms of a query: the first MAX_TERMS words that are no stopwords, with variants.

    A query without any such word is one term as a whole.
    """
    text = F.col(text) if isinstance(text, str) else text
    base = F.slice(F.filter(pieces(F.lower(text), 3), lambda t: ~t.isin(*STOPWORDS)), 1, MAX_TERMS)
    base = F.when(F.size(base) > 0, base).otherwise(F.array(F.lower(text)))
    return F.array_distinct(F.filter(F.flatten(F.transform(base, variants)), lambda t: F.length(t) >= 3))


def rerank_terms(text: Column | str) -> Column:
    """Words of a query of three characters or more, repeats kept."""
    return pieces(F.lower(F.col(text) if isinstance(text, str) else text), 3)


def query_aliases(text: Column | str) -> Column:
    """Rerank terms and their runs of two and three, joined by ``_`` and by nothing."""
    t = rerank_terms(text)
    n = F.size(t)

    def runs(k: int) -> Column:
        at = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(at, lambda i: F.array(F.array_join(F.slice(t, i, k), "_"), F.array_join(F.slice(t, i, k), ""))))

    return F.array_distinct(F.filter(F.concat(t, runs(2), runs(3)), lambda a: F.length(a) >= 3))


def total(terms: Column | str, points) -> Column:
    """Sum of ``points(term)`` over the terms."""
    return F.aggregate(terms, F.lit(0).cast("int"), lambda acc, t: acc + points(t).cast("int"))


def points(*cases: tuple[Column, int]) -> Column:
    """Sum of the values whose condition holds; a null condition does not."""
    out = F.lit(0)
    for when, value in cases:
        out = out + F.when(when, value).otherwise(0)
    return out


def module_key(path: Column | str) -> Column:
    """Dotted module name of a path."""
    return F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/", ".")


def glob_regex(glob: str) -> str:
    """fnmatch pattern as a regular expression; ``*`` crosses slashes."""
    out = ""
    i = 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            body = glob[i:j].replace("\\", "\\\\")
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            i = j + 1
        else:
            out += "\\" + c if c in r"\.^$+{}()|[]" else c
    return f"^{out}$"
