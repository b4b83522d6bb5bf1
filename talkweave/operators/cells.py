"""Approximate vector search by an inverted file: vectors lie in the cells of a k-means, a search looks into few of them.

The centroids are fitted to a bounded sample; every vector is filed under its nearest centroid. A search reads the folders
of the cells nearest to the question, applies its filters there, and ranks by exact cosine. Centroids are as many as the
square root of the rows, SAMPLE / 64 at most, so they are small; vectors that have no direction are filed under cell -1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.operators import search as S

#: Vectors that the centroids are fitted to, at most; the least by a hash of their key.
SAMPLE = 16_384
ROUNDS = 12
PROBES = 12


@dataclass(frozen=True)
class Cells:
    at: str
    key: str
    vector: str
    centroids: np.ndarray
    columns: T.StructType

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType([*self.columns, T.StructField("cell", T.IntegerType())])).parquet(f"{self.at}/rows")

    def nearest(self, query: Sequence[float], probes: int) -> list[int]:
        """The cells nearest to a question, nearest first; ties by number."""
        q = np.asarray(query, np.float64)
        return np.argsort(-(self.centroids @ q), kind="stable")[:probes].tolist()


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros or with a number that isn't finite becomes NaN."""
    with np.errstate(all="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(vectors: pd.Series, size: int) -> np.ndarray:
    """The vectors as rows; NaN for null ones, those with a null and those of another size."""
    out = np.full((len(vectors), size), np.nan)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == size:
            out[i] = np.asarray(v, np.float64)
    return out


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors by cosine: the start is spread by taking, each time, the vector farthest from all so far."""
    chosen, best = [0], sample @ sample[0]
    while len(chosen) < min(cells, len(sample)):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, sample @ sample[chosen[-1]])
    centroids = sample[chosen]
    for _ in range(rounds):
        own = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        full = np.linalg.norm(sums, axis=1) > 0
        centroids = np.where(full[:, None], np.divide(sums, np.linalg.norm(sums, axis=1, keepdims=True), where=full[:, None], out=np.zeros_like(sums)), centroids)
    return centroids


def build(df: DataFrame, key: str, vector: str, at: str, *, cells: int | None = None, sample: int = SAMPLE) -> Cells:
    """File df's rows (all columns, none named cell) by the cells of their vectors into the folder `at`, which must not exist."""
    spark = df.sparkSession
    good = df.where(F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double"))))
    few = good.orderBy(F.xxhash64(F.col(key)), key).limit(sample).select(vector).toPandas()[vector]
    size = max((len(v) for v in few), default=0)
    known = unit(matrix(few, size))
    known = known[np.isfinite(known).all(axis=1)]
    n = cells or max(1, min(sample // 64, round(df.count() ** 0.5)))
    centroids = fitted(known, n) if len(known) else np.zeros((0, size))

    def filed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = unit(matrix(batch, size))
            ok = np.isfinite(x).all(axis=1) & (len(centroids) > 0)
            own = np.full(len(x), -1, np.int32)
            if ok.any():
                own[ok] = np.argmax(x[ok] @ centroids.T, axis=1)
            yield pd.Series(own)

    cell = F.pandas_udf(filed, "int")(F.col(vector))
    # A cell may be large: its rows are dealt by key as well, so that no task writes one alone.
    df.withColumn("cell", cell).repartition("cell", F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy("cell").parquet(f"{at}/rows")
    return Cells(at, key, vector, centroids, df.schema)


def vector_search(index: Cells, spark: SparkSession, query: Sequence[float], *, where: Column | None = None, limit: int = 20, probes: int = PROBES) -> DataFrame:
    """As search.vector_search, but only over the cells nearest to the question. `where` is applied within the cells."""
    near = index.rows(spark).where(F.col("cell").isin(*index.nearest(query, probes)))
    return S.vector_search(near, index.key, index.vector, query, where=where, limit=limit)
