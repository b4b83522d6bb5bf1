"""Embedding near-dedup by collision-counting projections.

Equal vectors of a label are one class. The classes of a label are dealt by hash into chunks of about `CHUNK`, and every
pair of chunks is a tile: a group of its own, of bounded size, whatever a label holds. In a tile each vector is
projected on `PROJECTIONS` random lines. On each line one side is sorted, and a window around every query of the other
side collides with a run of it. A pair's collisions are counted over all lines; pairs that reach the calibrated count
are verified by the cosine in double precision.

Calibration: on a Gaussian line the projections of two unit vectors at distance d differ by N(0, d^2). With windows of
half width 1.5 d at the threshold's d, a pair at the threshold collides on a line with probability erf(1.5 / sqrt 2),
closer pairs more often; the least count is the largest that such a pair reaches with probability 1 - MISS.

A tile gives back sums and a spanning forest, not its pairs: how many vectors each of its vectors links with, and the
links that connect. The tiles of a label are a query set against all its rows in blocks, so their number grows with the
square of a label's classes; the counting is what makes a pair cheap, not rare.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm.common import read, stored
from talkweave.llm.components import components, least_names
from talkweave.llm.simhash import Forest

THRESHOLD = 0.93
CHUNK = 2048
PROJECTIONS = 32
MISS = 1e-6


def calibrated(threshold: float, lines: int = PROJECTIONS, miss: float = MISS) -> tuple[float, int]:
    """Half width of the windows and least count of collisions."""
    half = 1.5 * math.sqrt(2 - 2 * threshold)
    p = math.erf(1.5 / math.sqrt(2))
    below, count = 0.0, 0
    while below + (term := math.comb(lines, count) * p**count * (1 - p) ** (lines - count)) <= miss:
        below += term
        count += 1
    return half, count


@lru_cache(maxsize=8)
def lines_of(dim: int, lines: int) -> np.ndarray:
    return np.random.default_rng(20_240_607).standard_normal((dim, lines))


def candidates(a: np.ndarray, b: np.ndarray, threshold: float, lines: int = PROJECTIONS) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of the pairs of unit vectors that collide often enough."""
    half, least = calibrated(threshold, lines)
    frame = lines_of(a.shape[1], lines)
    pa_, pb = a @ frame, b @ frame
    count = np.zeros((len(a), len(b)), np.uint8)
    rows = np.arange(len(a))
    for k in range(lines):
        order = np.argsort(pb[:, k], kind="stable")
        line = pb[order, k]
        step = np.zeros((len(a), len(b) + 1), np.int8)
        np.add.at(step, (rows, np.searchsorted(line, pa_[:, k] - half, "left")), 1)
        np.add.at(step, (rows, np.searchsorted(line, pa_[:, k] + half, "right")), -1)
        back = np.empty(len(b), np.int64)
        back[order] = np.arange(len(b))
        count += np.cumsum(step[:, :-1], axis=1, dtype=np.int8).view(np.uint8)[:, back]
    return np.nonzero(count >= least)


def _tile(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        chunk = table["chunk"].to_numpy()
        node, weight = table["node"].to_numpy(), table["weight"].to_numpy()
        x = np.array(table["embedding"].to_pylist(), np.float64)
        size = np.sqrt((x * x).sum(axis=1))
        x /= size[:, None]
        one = np.flatnonzero(chunk == table["a"][0].as_py())
        same = table["a"][0].as_py() == table["b"][0].as_py()
        two = one if same else np.flatnonzero(chunk == table["b"][0].as_py())
        links, forest = np.zeros(len(node), np.int64), Forest(len(node))
        if len(one) and len(two):
            i, j = candidates(x[one], x[two], threshold)
            i, j = one[i], two[j]
            if same:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 200_000):
                u, v = i[s : s + 200_000], j[s : s + 200_000]
                near = np.einsum("nd,nd->n", x[u], x[v]) >= threshold
                u, v = u[near], v[near]
                np.add.at(links, u, weight[v])
                np.add.at(links, v, weight[u])
                for p, q in zip(u.tolist(), v.tolist()):
                    forest.join(p, q)
        has = np.flatnonzero(links)
        edges = np.array(forest.links, np.int64).reshape(-1, 2)
        return pa.table(
            {
                "u": pa.array(np.concatenate([node[has], node[edges[:, 0]]])),
                "v": pa.array([None] * len(has) + node[edges[:, 1]].tolist(), pa.int64()),
                "n": pa.array(np.concatenate([links[has], np.zeros(len(edges), np.int64)])),
            }
        )

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label).

    Rows with a null label, and vectors that are null, empty, zero or hold null or non-finite components, link with
    nothing: n_links 0, component_id their own id. Vectors of different lengths don't link. Repeated rows are vectors of
    their own that link with each other. A null vec_id takes part; its component_id is the least id of its component,
    null if there is none, and kept is then null too. An empty table gives no rows; other columns are ignored.
    """
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    valid = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & F.when(finite, square > 0), F.lit(False))
    rows = vectors.select("vec_id", "label", "embedding").withColumn("valid", valid)
    rows = rows.withColumn("node", F.when(F.col("valid"), F.xxhash64("label", "embedding")))
    classes = stored(
        rows.where("valid").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.min("node").alias("node")), "vector-classes"
    )
    sizes = classes.groupBy("label", F.size("embedding").alias("dim")).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    dealt = classes.withColumn("dim", F.size("embedding")).join(sizes, ["label", "dim"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    sides = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, F.col("chunk")).alias("a"), F.greatest(o, F.col("chunk")).alias("b")))
    tiles = dealt.select("label", "dim", "chunk", "node", "weight", "embedding", F.explode(sides).alias("t")).select("label", "dim", "t.a", "t.b", "chunk", "node", "weight", "embedding")
    found = stored(tiles.groupBy("label", "dim", "a", "b").applyInArrow(_tile(threshold), "u long, v long, n long"), "vector-links")
    roots = components(found.where("v is not null").select("u", "v"))
    more = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("more"))
    names = least_names(classes.select("node", "least"), roots)
    named = classes.select("node", "weight").join(names, "node").join(more, "node", "left").select("node", "component_id", (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    return rows.select("vec_id", "node").join(named, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
