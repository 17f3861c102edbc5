"""Normal forms of loosely written keys (kinds, states, checksums)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(c: Column | str) -> Column:
    """Lower case without surrounding white space."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def node_kind(c: Column | str) -> Column:
    """Kind of a graph node; ``doc`` names a row of files."""
    k = plain(c)
    return F.when(k == "doc", "file").otherwise(k)


def checksum(c: Column | str) -> Column:
    """Digest without letter case, blanks and a prefix naming the hash; blank is null."""
    bare = F.regexp_replace(F.regexp_replace(plain(c), r"\s+", ""), r"^[a-z0-9_-]+[:=]", "")
    return F.when(bare != "", bare)
