"""Approximate search of a vector collection by inverted cells.

Vectors are dealt to the nearest of some centroids; a query is compared exactly with
the vectors of its nearest cells only.  The centroids are k-means of at most FIT_ROWS
rows, chosen by a hash of their id; every row is indexed.  How many cells a query
needs is measured, on CALIBRATION of the rows as queries against the sample: the
fewest that find WANTED of their true neighbours.  A cell of more than CELL_ROWS is
kept in parts, so a crowded one loads no single task, and queries meet vectors by cell
and part: no query meets all vectors.

Vectors that are null, hold null or non-finite entries, or another number of entries
than the most, are neither indexed nor asked.  Rows that repeat an id are found once each.
An empty collection finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gleaner.operators.retrieval import best_of_block, top
from gleaner.sources.tables import save

FIT_ROWS = 50_000
#: Cells of a collection at most; below, the square root of its rows.
CELLS = 2_048
CELL_ROWS = 10_000
CALIBRATION, WANTED = 200, 0.97


@dataclass(frozen=True)
class Cells:
    """``index``: cell, part, id, v; ``parts``: how many parts each cell has."""

    centroids: np.ndarray
    probes: int
    index: DataFrame
    parts: DataFrame


def _fine(vectors: DataFrame, width: int | None = None) -> DataFrame:
    v = F.col("vector").cast("array<double>")
    rows = vectors.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).withColumn("v", v).drop("vector")
    return rows.where(F.size("v") == (F.lit(width) if width is not None else rows.agg(F.max(F.size("v"))).scalar()))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)


def _nearest(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """``rows`` with ``cells``: the ``probes`` nearest, nearest first."""

    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            near = np.argsort(_distances(np.stack(v.to_numpy()), centroids), axis=1, kind="stable")[:, :probes]
            yield pd.Series(list(near.astype(np.int32)))

    return rows.withColumn("cells", F.pandas_udf(assign, "array<int>")("v"))


def enough_probes(sample: np.ndarray, centroids: np.ndarray, k: int, wanted: float = WANTED) -> int:
    """The fewest cells in which the calibration queries find ``wanted`` of their k
    nearest of the sample."""
    asked = sample[np.linspace(0, len(sample) - 1, min(CALIBRATION, len(sample))).astype(int)]
    true = np.argsort(_distances(asked, sample), axis=1, kind="stable")[:, :k]
    home = _distances(sample, centroids).argmin(1)
    order = np.argsort(_distances(asked, centroids), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each cell, by nearness to the query
    needed = np.sort(np.take_along_axis(place, home[true], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(wanted * len(needed))) - 1)]) + 1


def build(vectors: DataFrame, k: int = 20, cells: int | None = None, probes: int | None = None, seed: int = 7) -> Cells | None:
    """The index of ``vectors`` (id, vector); None if no row can be indexed."""
    rows = save(_fine(vectors), "vectors")
    n = rows.count()
    if not n:
        return None
    # A share of the rows by the hash of their id: about FIT_ROWS, whatever their number.
    share = min(1.0, 0.9 * FIT_ROWS / n)
    sample = save(rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else rows, "sample")
    points = np.array([r["v"] for r in sample.select("v").limit(FIT_ROWS).collect()], float)
    cells = min(cells or max(1, min(CELLS, int(np.sqrt(n)))), len(np.unique(points, axis=0)))
    if cells < 2:
        centroids = points[:1]
    else:
        centroids = np.array(KMeans(k=cells, seed=seed, maxIter=10, featuresCol="f").fit(sample.select(array_to_vector("v").alias("f"))).clusterCenters())
    placed = save(_nearest(rows, centroids, 1).select("id", "v", F.get("cells", F.lit(0)).alias("cell")), "cells")
    parts = save(placed.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts")), "cell-parts")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    index = placed.join(F.broadcast(parts), "cell").select("cell", part.alias("part"), "id", "v")  # CELLS rows at most
    index = save(index.repartition("cell", "part").sortWithinPartitions("cell", "part"), "cell-index")
    return Cells(centroids, probes or enough_probes(points, centroids, k), index, parts)


def search(queries: DataFrame, cells: Cells | None, k: int = 20, measure: str = "l2", digits: int = 6) -> DataFrame:
    """(query_id, id, dense_score, dense_rank) for ``queries`` (query_id, vector), as
    retrieval.dense() scores and ranks them, of the vectors in the queries' cells."""
    if cells is None:
        return queries.select("query_id").where("false").selectExpr("query_id", "cast(null as long) id", "cast(null as double) dense_score", "cast(null as int) dense_rank")
    asked = _nearest(_fine(queries, cells.centroids.shape[1]), cells.centroids, cells.probes)
    asked = asked.select("query_id", F.col("v").alias("q"), F.explode("cells").alias("cell")).join(F.broadcast(cells.parts), "cell")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    # A part of a cell and the queries that look there meet as two matrices.
    by = ("cell", "part")
    schema = StructType([cells.index.schema["id"], asked.schema["query_id"], StructField("dense_score", DoubleType())])
    best = cells.index.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(best_of_block(k, measure, digits), schema)
    rows = best.select("query_id", "id", "dense_score")
    return top(rows, "dense_score", k, ["id"], "dense_rank")
