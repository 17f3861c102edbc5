"""Where vectors come from: the token buckets of ``vectors.embed``, or a client of a remote model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors

#: Texts of one call of a remote client.
CALL = 64


class EmbeddingProvider(Protocol):
    model_name: str
    dimensions: int

    def embed(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, vector array<double>): one row for every row of ``df``; null and blank texts get zeros."""
        ...


class LocalProvider:
    """Signed token buckets, computed by Spark alone; the same text always gives the same vector."""

    def __init__(self, dimensions: int = 1024, model_name: str = "deterministic-local"):
        self.dimensions, self.model_name = dimensions, model_name

    def embed(self, df: DataFrame, key: str, text: str) -> DataFrame:
        made = vectors.embed(df.where(F.col(text).isNotNull()), key, text, self.dimensions)
        zeros = F.array_repeat(F.lit(0.0), self.dimensions)
        return df.select(key).distinct().join(made, key, "left").select(key, F.coalesce("vector", zeros).alias("vector"))


class RemoteProvider:
    """Vectors of a remote model. ``client`` makes, on a worker, a function from a list of texts to their vectors."""

    def __init__(self, client: Callable[[], Callable[[list[str]], list[list[float]]]], model_name: str, dimensions: int = 1024):
        self.client, self.model_name, self.dimensions = client, model_name, dimensions

    def embed(self, df: DataFrame, key: str, text: str) -> DataFrame:
        make, kind, dims = self.client, dict(df.dtypes)[key], self.dimensions

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = make()
            for b in batches:
                for lo in range(0, len(b), CALL):
                    part = b.iloc[lo : lo + CALL]
                    texts = [t if isinstance(t, str) else "" for t in part["t"]]
                    asked = [t for t in texts if t.strip()]
                    answers = iter(call(asked) if asked else [])
                    yield pd.DataFrame({"k": part["k"], "vector": [list(map(float, next(answers))) if t.strip() else [0.0] * dims for t in texts]})

        return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, vector array<double>").withColumnRenamed("k", key)


def provider(dimensions: int = 1024, client=None, model_name: str | None = None) -> EmbeddingProvider:
    """The remote provider if there is a client, else the local one."""
    if client is None:
        return LocalProvider(dimensions)
    return RemoteProvider(client, model_name or "remote", dimensions)
