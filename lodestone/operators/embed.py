"""Vectors of texts by an injected model, in Arrow batches."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship

SIZE = 1024


def stand_in(texts: list[str], size: int = SIZE) -> list[list[float]]:
    """Unit vectors that follow from a text's code points alone: for tests, and where no model is at hand."""
    out = []
    for t in texts:
        v = np.random.RandomState(sum(map(ord, t)) % (1 << 32)).randn(size).astype(np.float32)
        out.append((v / np.linalg.norm(v)).tolist())
    return out


def embedded(df: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]] = stand_in, name: str = "embedding") -> DataFrame:
    """df with the unit vector of each text; a null text has none, a vector of length 0 stays as it is.

    embed takes a batch of texts on a worker (load a model there once, by an lru_cache). Its errors fail the query: no other
    vectors are put in a model's place.
    """
    ship(df.sparkSession)

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        known = [t for t in texts if t is not None]
        rows = iter(embed(known) if known else [])
        out = []
        for t in texts:
            v = None if t is None else np.asarray(next(rows), np.float32)
            out.append(None if v is None else v / max(float(np.linalg.norm(v)), 1e-30) if np.any(v) else v)
        return pd.Series(out, dtype="object")

    return df.withColumn(name, vectors(F.col(text)))
