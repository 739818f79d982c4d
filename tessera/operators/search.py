"""Vector top-k."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import similarity

BLOCK_BYTES = 4 << 20  # of vectors as doubles
TILE = 1 << 21  # scores, or components of pairs, at a time


def top_k(index: DataFrame, query: list[float], k: int = 5, metric: str = "cosine", vector: str = "embedding", ord_: str = "ord") -> DataFrame:
    """The k rows of index most similar to one query; ties by ord. Each task keeps k rows."""
    scored = index.withColumn("similarity", similarity(F.col(vector), F.array(*[F.lit(float(x)) for x in query]), metric))
    return scored.orderBy(F.desc("similarity"), ord_).limit(k)


def _rows_of(vectors: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The places of vectors that have no score (null, or with a null component), and by length the places and the matrix of the others."""
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).copy()
    missing = vectors.flatten().is_null().to_numpy(zero_copy_only=False)
    size[pc.list_parent_indices(vectors).to_numpy()[missing]] = -1
    parts = []
    for d in np.unique(size[size >= 0]).tolist():
        at = np.flatnonzero(size == d)
        parts.append((at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)))
    return np.flatnonzero(size < 0), parts


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added in the order of components as functions.vectors.dot() does."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """functions.vectors.similarity() of the rows of q and x, by the same sums."""
    with np.errstate(all="ignore"):
        if metric == "euclidean":
            return -np.sqrt(_dots(q - x, q - x))
        total = _dots(q, x)
        if metric == "dot":
            return total
        norms = np.sqrt(_dots(q, q)) * np.sqrt(_dots(x, x))
        return np.divide(total, norms, out=np.zeros_like(total), where=norms != 0)


def _firsts(x: np.ndarray, k: int) -> np.ndarray:
    """Places of rows of x without those that k equal rows come before, which are among no query's k best."""
    if len(x) <= k or not x.shape[1]:
        return np.arange(len(x))
    same = np.unique((x + 0.0).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)[1]
    order = np.argsort(same, kind="stable")
    return np.sort(order[_first_of_each(same[order], k)])


def _first_of_each(groups: np.ndarray, k: int) -> np.ndarray:
    """The first k places of each run of equal numbers."""
    begins = np.flatnonzero(np.diff(groups, prepend=-1))
    return np.arange(len(groups)) - np.repeat(begins, np.diff(begins, append=len(groups))) < k


def _candidates(q: np.ndarray, x: np.ndarray, k: int, metric: str) -> np.ndarray:
    """By query the rows of x that may be among its k best: those whose score by matrix product reaches the k-th, less all that rounding can do."""
    with np.errstate(all="ignore"):
        nq, nx = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
        odd = lambda m, n: ~((n > 1e-140) & (n < 1e140)) & (m != 0).any(1)  # noqa: E731  (squares lose digits or aren't finite: no bound)
        odd_q, odd_x = odd(q, nq), odd(x, nx)
        x, nx = np.where(odd_x[:, None], 0.0, x), np.where(odd_x, 0.0, nx)
        if metric == "euclidean":
            near = 2 * (q @ x.T)
            near -= nx * nx  # the query's own square is the same for all rows
            reach = (nq + nx.max()) ** 2
        elif metric == "cosine":
            near = (q / np.where(nq > 0, nq, 1.0)[:, None]) @ (x / np.where(nx > 0, nx, 1.0)[:, None]).T
            reach = np.ones(len(q))
        else:
            near, reach = q @ x.T, nq * nx.max()
        near[:, odd_x] = -np.inf
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        found = ~(near < (least - 8 * (x.shape[1] + 8) * np.finfo(float).eps * reach - 1e-290)[:, None])
        found[odd_q] = True
        found[:, odd_x] = True
    return found


def _kept(k: int, at: np.ndarray, to: np.ndarray, score: np.ndarray, null: np.ndarray) -> list[np.ndarray]:
    """The k best of each at: NaN is largest, null scores are last, ties go by to."""
    order = np.lexsort((to, -score, ~np.isnan(score), null, at))
    order = order[_first_of_each(at[order], k)]
    return [c[order] for c in (at, to, score, null)]


def _best(q: np.ndarray, x: np.ndarray, k: int, metric: str) -> list[np.ndarray]:
    """Places in q and in x of the k best rows of x for each of q, their similarities, and that none is null. TILE bounds the memory, whatever ties."""
    firsts, out = _firsts(x, k), []
    x = x[firsts]
    tile, pairs = max(1, TILE // len(x)), max(1, TILE // max(1, x.shape[1]))
    for lo in range(0, len(q), tile):
        at, to = np.nonzero(_candidates(q[lo : lo + tile], x, min(k, len(x)), metric))
        at += lo
        score = np.empty(len(at))
        for b in range(0, len(at), pairs):
            part = slice(b, b + pairs)
            score[part] = _exact(q[at[part]], x[to[part]], metric)
        out.append(_kept(k, at, firsts[to], score, np.zeros(len(at), bool)))
    return [np.concatenate(c) for c in zip(*out)]


def _block_best(k: int, metric: str, query_key: str, key: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best rows of a block (key, _v, _cell) for each of a block of queries (query_key, _q, _cells), of its cells' rows."""

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [(key, "ascending")], null_placement="at_start"))  # so ties go by place
        vectors, asked, wanted = (c.combine_chunks() for c in (rows["_v"], queries["_q"], queries["_cells"]))
        cell, by_cell, whose = rows["_cell"].to_numpy(), wanted.flatten().to_numpy(), pc.list_parent_indices(wanted).to_numpy()
        odd_q, own_q = _rows_of(asked)
        out = [[np.zeros(0, t) for t in (np.int64, np.int64, np.float64, bool)]]
        for c in np.unique(cell).tolist():
            inside, wants = np.flatnonzero(cell == c), np.zeros(len(asked), bool)
            wants[whose[by_cell == c]] = True
            odd_x, own_x = _rows_of(vectors.take(pa.array(inside)))
            for places, q in [*own_q, (odd_q, None)]:
                mine = wants[places]
                places = places[mine]
                if not len(places):
                    continue
                apart = [odd_x]  # rows that don't go with these queries, as similarity() has them: 0 by cosine, else null
                for there, x in own_x:
                    if q is None or q.shape[1] != x.shape[1]:
                        apart.append(there)
                        continue
                    at, to, score, null = _best(q[mine], x, k, metric)
                    out.append([places[at], inside[there[to]], score, null])
                lone = np.sort(np.concatenate(apart))[:k]
                n = len(places) * len(lone)
                out.append([np.repeat(places, len(lone)), np.tile(inside[lone], len(places)), np.zeros(n), np.full(n, metric != "cosine")])
        at, to, score, null = _kept(k, *map(np.concatenate, zip(*out)))
        return pa.table({query_key: queries[query_key].take(pa.array(at)), key: rows[key].take(pa.array(to)), "similarity": pa.array(score, pa.float64(), mask=null)})

    return best


def plain_vector(df: DataFrame, vector: str) -> Column:
    """The column as floats or doubles."""
    return F.col(vector) if dict(df.dtypes)[vector] in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")


def rows_a_block(length: int) -> int:
    return max(1, BLOCK_BYTES // (8 * max(1, length)))


def best_of_blocks(queries: DataFrame, rows: DataFrame, k: int, metric: str, query_key: str, key: str) -> DataFrame:
    """(query_key, key, similarity): by query (query_key, _q, _cells) and block of rows (key, _v, _cell) its k best, ties by key. Blocks of both are
    named by _qb and _rb. A task holds one block of each: a matrix product finds the rows that can be among the best, whose similarity
    is then computed as functions.vectors.similarity() has it."""
    kinds = dict(queries.dtypes) | dict(rows.dtypes)
    schema = f"`{query_key}` {kinds[query_key]}, `{key}` {kinds[key]}, similarity double"
    return queries.groupBy("_qb", "_rb").cogroup(rows.groupBy("_qb", "_rb")).applyInArrow(_block_best(k, metric, query_key, key), schema)


def ranked(found: DataFrame, k: int, query_key: str, key: str) -> DataFrame:
    order = Window.partitionBy(query_key).orderBy(F.desc("similarity"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_key, key, "similarity", "rank")


def top_k_join(index: DataFrame, queries: DataFrame, k: int, metric: str, vector: str = "embedding", key: str = "vec_id", query_key: str = "query_id") -> DataFrame:
    """(query_id, key, similarity, rank) for a table of queries, the stated query set, against all rows, both dealt to blocks of BLOCK_BYTES: every
    block of queries meets every block of rows, and k rows a query leave each meeting."""
    size = queries.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    per = rows_a_block(size.d or 1)
    n_queries, n_rows = max(1, -(-size.n // per)), max(1, -(-index.count() // per))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    asked = queries.select(query_key, plain_vector(queries, vector).alias("_q"), F.array(F.lit(0)).alias("_cells"))
    asked = asked.withColumn("_qb", block(n_queries, query_key, "_q")).withColumn("_rb", every(n_rows))
    rows = index.select(key, plain_vector(index, vector).alias("_v"), F.lit(0).alias("_cell"))
    rows = rows.withColumn("_rb", block(n_rows, key, "_v")).withColumn("_qb", every(n_queries))
    return ranked(best_of_blocks(asked, rows, k, metric, query_key, key), k, query_key, key)


class SimilarityIndex:
    """Vectors with labels and metadata in one DataFrame: add, search, get, size, save and load."""

    SCHEMA = "ord long, label string, embedding array<double>, metadata map<string,string>"

    def __init__(self, spark: SparkSession, metric: str = "cosine", rows: DataFrame | None = None) -> None:
        self.spark, self.metric = spark, metric
        self.rows = rows if rows is not None else spark.createDataFrame([], self.SCHEMA)

    def add_batch(self, rows: DataFrame) -> None:
        """rows (ord, label, embedding, metadata); ord gives the order for ties and must be new."""
        self.rows = self.rows.unionByName(rows.select("ord", "label", F.col("embedding").cast("array<double>").alias("embedding"), "metadata"))

    def add(self, ord_: int, label: str, embedding: list[float], metadata: dict | None = None) -> None:
        self.add_batch(self.spark.createDataFrame([(ord_, label, embedding, metadata or {})], self.SCHEMA))

    def search(self, query: list[float], k: int = 5) -> DataFrame:
        """Each row comes with its own metadata."""
        return top_k(self.rows, query, k, self.metric)

    def get(self, label: str) -> DataFrame:
        return self.rows.where(F.col("label") == label)

    def size(self) -> int:
        return self.rows.count()

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, metric: str = "cosine") -> SimilarityIndex:
        return cls(spark, metric, spark.read.parquet(path))
