"""Source trees as a Spark data source: every regular file, hidden and empty ones included.

Spark's own ``binaryFile`` leaves out names that begin with ``_`` or ``.`` and
empty files, which a source tree is full of. Partitions are the subtrees below
the root, so that listing and reading are spread over the executors.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import glob_regex


class _Subtree(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


def included(path: str, include: list[str], exclude: list[str]) -> bool:
    """Whether a relative path matches an include glob (none means any) and no exclude glob.

    Globs are those of ``functions.text.glob_regex``: ``*`` crosses slashes, and
    ``**/`` asks for at least one folder.
    """
    hit = lambda g: re.search(glob_regex(g), path, re.S) is not None
    return (not include or any(map(hit, include))) and not any(map(hit, exclude))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        split = lambda k: [g for g in options.get(k, "").split(",") if g]
        self.include, self.exclude = split("include"), split("exclude")

    def partitions(self) -> list[InputPartition]:
        """The root's own files, and each folder two levels down with all below it."""
        out = [_Subtree(self.root, False)]
        for a in sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False)):
            out.append(_Subtree(a, False))
            out += [_Subtree(b, True) for b in sorted(e.path for e in os.scandir(a) if e.is_dir(follow_symlinks=False))]
        return out

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        for folder, dirs, names in os.walk(partition.folder):
            dirs.sort()
            if not partition.deep:
                dirs.clear()
            for name in sorted(names):
                full = os.path.join(folder, name)
                path = os.path.relpath(full, self.root).replace(os.sep, "/")
                if os.path.isfile(full) and included(path, self.include, self.exclude):
                    with open(full, "rb") as f:
                        data = f.read()
                    yield (path, data, len(data), data.decode("utf-8", "ignore"))


class SourceTree(DataSource):
    """``spark.read.format("source_tree").option("include", "**/*.py,**/*.md").load(root)``"""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, content binary, length long, text string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    from ..session import ship

    ship(spark)
    spark.dataSource.register(SourceTree)


def git_head(root: str) -> tuple[str | None, str | None]:
    """(branch, commit) of a checkout; nulls without ``.git`` or on failure."""
    if not os.path.exists(os.path.join(root, ".git")):
        return None, None

    def ask(*args):
        try:
            out = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=30)
        except (OSError, subprocess.SubprocessError):
            return None
        return out.stdout.strip() or None if out.returncode == 0 else None

    return ask("rev-parse", "--abbrev-ref", "HEAD"), ask("rev-parse", "HEAD")
