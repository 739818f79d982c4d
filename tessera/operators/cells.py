"""An exact vector index (J23, X10, K11): k-means cells, of which a search skips those that can't hold a result.

Centroids are fitted on a sample of SAMPLE rows at most, chosen by hash; every row is assigned to its nearest centroid and
stored in the order of cells. A cell knows its radius, so the similarity of any of its rows to a query is bounded: by the triangle
inequality for euclidean, by query x centroid + |query| x radius for dot, and for cosine by the same on unit vectors. A search scans each query's
few most promising cells, then all whose bound reaches its k-th similarity so far. Results are those of a full scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.cut import cut
from tessera.operators.search import best_of_blocks, plain_vector, ranked, rows_a_block

SAMPLE, STEPS, MOST_CELLS, FIRST = 20_000, 8, 1024, 3
SLACK = 1e-9  # relative, for rounding of bounds


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(STEPS):
        near = (((x * x).sum(1)[:, None] - 2 * x @ c.T) + (c * c).sum(1)).argmin(1)
        for j in range(len(c)):
            own = x[near == j]
            if len(own):
                c[j] = own.mean(0)
    return c


def _matrix(column: pa.Array, unit: bool) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    if unit:
        n = np.sqrt((x * x).sum(1, keepdims=True))
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    return x


class CellIndex:
    """rows: (key, vector, cell); cells: (cell, centroid, radius, n), MOST_CELLS at most."""

    def __init__(self, rows: DataFrame, cells: DataFrame, metric: str, key: str, vector: str) -> None:
        self.rows, self.cells, self.metric, self.key, self.vector = rows, cells, metric, key, vector
        self.scanned: DataFrame | None = None

    @classmethod
    def build(cls, rows: DataFrame, path: str, metric: str = "euclidean", key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> CellIndex:
        """Writes the index of rows below path. Vectors are of one length; rows without vector are left out."""
        if metric not in ("cosine", "euclidean", "dot"):
            raise ValueError(metric)
        spark, unit = rows.sparkSession, metric == "cosine"
        rows = rows.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias(vector))
        n = rows.count()
        some = rows.orderBy(F.xxhash64(key)).limit(SAMPLE).toArrow()
        fitted = _centroids(_matrix(some.column(vector).combine_chunks(), unit), min(MOST_CELLS, cells or max(1, math.isqrt(n)))) if n else np.zeros((0, 0))
        held = spark.sparkContext.broadcast(fitted)
        kind = dict(rows.dtypes)[key]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(vector), unit)
                near = (((x * x).sum(1)[:, None] - 2 * x @ c.T) + (c * c).sum(1)).argmin(1)
                away = np.sqrt(((x - c[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(away)], [*batch.schema.names, "cell", "away"])

        dealt = rows.mapInArrow(assign, f"`{key}` {kind}, `{vector}` array<double>, cell int, away double")
        dealt.repartitionByRange("cell", F.xxhash64(key)).sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/rows")
        saved = spark.read.parquet(f"{path}/rows")
        sums = saved.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
        centres = spark.createDataFrame([(j, c.tolist()) for j, c in enumerate(fitted)], "cell int, centroid array<double>")
        sums.join(centres, "cell").withColumn("metric", F.lit(metric)).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return cls.load(spark, path, key, vector)

    @classmethod
    def load(cls, spark: SparkSession, path: str, key: str = "vec_id", vector: str = "embedding") -> CellIndex:
        try:
            cells = spark.read.parquet(f"{path}/cells")
        except AnalysisException as e:
            raise FileNotFoundError(path) from e
        first = cells.select("metric").first()
        return cls(spark.read.parquet(f"{path}/rows").drop("away"), cells.drop("metric"), first.metric if first else "euclidean", key, vector)

    def _blocks(self, held: list, length: int) -> tuple[dict[int, int], dict[int, int]]:
        """By cell its first block and how many it has: small cells share a block of rows_a_block(), large ones have several."""
        first, parts, block, room = {}, {}, 0, 0
        for r in held:
            need = -(-r.n // rows_a_block(length))
            if need > 1 or r.n > room:
                block, room = block + 1, rows_a_block(length)
            first[r.cell], parts[r.cell] = block, need
            block, room = block + need - 1, 0 if need > 1 else room - r.n
        return first, parts

    def _wanted(self, queries: DataFrame, query_key: str, held: list, blocks: tuple, first: int, rest: bool) -> DataFrame:
        """(query_key, _q, _rb, _cells, _met): by query and block the cells to scan there, and how many rows they have. These are the first most
        promising cells; if rest, the others whose bound reaches _least, the k-th similarity so far, or all if that is null."""
        ids, n, radius = (np.array([r[c] for r in held]) for c in ("cell", "n", "radius"))
        c = np.array([r.centroid for r in held])
        metric = self.metric
        kind, vector = dict(queries.dtypes)[query_key], dict(queries.dtypes)["_q"]
        start, parts = (np.array([b[r.cell] for r in held]) for b in blocks)

        def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 64):
                    part = batch.slice(lo, 64)
                    if not part.num_rows or not len(ids):
                        continue
                    q = _matrix(part.column("_q"), metric == "cosine")
                    if metric == "euclidean":
                        most = -np.maximum(0, np.sqrt(((q[:, None] - c) ** 2).sum(2)) - radius)
                    else:
                        most = q @ c.T + np.sqrt((q * q).sum(1))[:, None] * radius
                    place = np.argsort(np.argsort(-most, axis=1, kind="stable"), axis=1)
                    take = place < first
                    if rest:
                        least = part.column("_least").to_numpy(zero_copy_only=False).astype(np.float64)  # null as NaN
                        take = ~take & ~(most + SLACK * (1 + np.abs(most)) < least[:, None])
                    i, j = np.nonzero(take)
                    copies = parts[j]  # a large cell is scanned in each of its blocks, and counted in its first
                    nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                    i, j = np.repeat(i, copies), np.repeat(j, copies)
                    block, rows = start[j] + nth, np.where(nth == 0, n[j], 0)
                    order = np.lexsort((block, i))
                    i, j, block, rows = i[order], j[order], block[order], rows[order]
                    begins = np.flatnonzero((np.diff(i, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
                    own = pa.array(i[begins])
                    cells = pa.ListArray.from_arrays(pa.array(np.append(begins, len(i)), pa.int32()), pa.array(ids[j], pa.int32()))
                    met = np.add.reduceat(rows, begins) if len(begins) else rows
                    yield pa.RecordBatch.from_arrays([part.column(query_key).take(own), part.column("_q").take(own), pa.array(block[begins], pa.int32()), cells, pa.array(met, pa.int64())], [query_key, "_q", "_rb", "_cells", "_met"])

        return queries.mapInArrow(lists, f"`{query_key}` {kind}, _q {vector}, _rb int, _cells array<int>, _met long")

    def search(self, queries: DataFrame, k: int = 5, query_key: str = "query_id", vector: str = "embedding", first: int = FIRST) -> DataFrame:
        """(query_key, key, similarity, rank), ties by key. `scanned` then has the number of rows that queries met and of all.

        Rows are scanned in blocks of whole cells (a large cell by parts), to each of which go the queries that want any of its cells."""
        spark = self.rows.sparkSession
        queries = queries.select(query_key, plain_vector(queries, vector).alias("_q"))
        held = self.cells.orderBy("cell").collect()  # MOST_CELLS rows
        length = len(held[0].centroid) if held else 1
        blocks = self._blocks(held, length)
        asked = queries.count()
        n_queries = max(1, -(-asked // rows_a_block(length)))
        places = spark.createDataFrame([(r.cell, blocks[0][r.cell], blocks[1][r.cell]) for r in held], "cell int, _first int, _parts int")

        def met(lists: DataFrame) -> DataFrame:
            wanted = [r.cell for r in lists.select(F.explode("_cells").alias("cell")).distinct().collect()]  # MOST_CELLS at most; row groups of others are skipped
            rows = self.rows.where(F.col("cell").isin(wanted)) if wanted else self.rows.limit(0)
            rows = rows.join(F.broadcast(places), "cell").withColumn("_rb", (F.col("_first") + F.pmod(F.xxhash64(self.key, self.vector), F.col("_parts"))).cast("int"))
            rows = rows.select(self.key, F.col(self.vector).alias("_v"), F.col("cell").alias("_cell"), "_rb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("_qb"))
            lists = lists.withColumn("_qb", F.pmod(F.xxhash64(query_key, "_q"), F.lit(n_queries)).cast("int"))
            return best_of_blocks(lists, rows, k, self.metric, query_key, self.key)

        most = self._wanted(queries, query_key, held, blocks, first, False)
        some = cut(ranked(met(most), k, query_key, self.key))
        last = some.where(F.col("rank") == k).select(query_key, F.col("similarity").alias("_least"))
        more = self._wanted(queries.join(last, query_key, "left"), query_key, held, blocks, first, True)
        share = most.union(more).agg(F.coalesce(F.sum("_met"), F.lit(0)).alias("met"))
        self.scanned = share.withColumn("all_rows", F.lit(asked * sum(r.n for r in held)).cast("long"))  # one row
        return ranked(some.drop("rank").union(met(more)), k, query_key, self.key)
