"""Spatial matching of large frames (J8, W16): the results of the folds of operators.matching as joins and rounds, so that no task
holds a frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.cut import cut

ROUNDS = 10_000


def near_pairs(left: DataFrame, right: DataFrame, by: list[str], reach: float) -> DataFrame:
    """(key, l, r, d, score): pairs of points (*by, ord, x, y, label) of one frame closer than reach. Points are dealt to squares of that
    side; a left point meets the right ones of its own and the eight squares around."""
    key = F.to_json(F.struct(*by)).alias("key")  # nulls are a key like others
    square = [F.floor(F.col(c) / reach).alias(f"s{c}") for c in "xy"]
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = left.select(key, F.col("ord").alias("l"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.lower("label").alias("al"), *square, F.inline(around))
    a = a.select("key", "l", "ax", "ay", "al", (F.col("sx") + F.col("i")).alias("sx"), (F.col("sy") + F.col("j")).alias("sy"))
    b = right.select(key, F.col("ord").alias("r"), F.col("x").alias("bx"), F.col("y").alias("by"), F.lower("label").alias("bl"), *square)
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    pairs = a.join(b, ["key", "sx", "sy"]).withColumn("d", d).where(F.col("d") < reach)
    score = F.least(F.lit(1.0), 1 - F.col("d") / reach + F.when(F.col("al") == F.col("bl"), 0.2).otherwise(0.0))
    return pairs.select("key", "l", "r", "d", score.alias("score"))


def greedy_rows(left: DataFrame, right: DataFrame, by: list[str], reach: float = 5.0, rounds: int = ROUNDS) -> DataFrame:
    """(*by, l, r, d, score) as matching.greedy_pairs() finds them: left points in order take the nearest free right point within reach, ties
    go to the smaller ord. ord is unique within a frame.

    In each round a left point is settled if no earlier one that isn't yet could take the right point it wants; the first of
    those left is always. Rounds are as many as the longest chain of points that wait for each other."""
    open_, found = cut(near_pairs(left, right, by, reach)), None
    names = F.from_json("key", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.select(*by).schema))
    for _ in range(rounds):
        wants = open_.groupBy("key", "l").agg(F.min(F.struct("d", "r", "score")).alias("w")).select("key", "l", "w.*")
        first = open_.groupBy("key", "r").agg(F.min("l").alias("first"))
        settled = cut(wants.join(first, ["key", "r"]).where("l = first").select("key", "l", "r", "d", "score"))
        if settled.isEmpty():
            found = settled if found is None else found
            return found.select(names.alias("_by"), "l", "r", "d", "score").select("_by.*", "l", "r", "d", "score")
        found = settled if found is None else found.union(settled)
        open_ = cut(open_.join(settled.select("key", "l"), ["key", "l"], "left_anti").join(settled.select("key", "r"), ["key", "r"], "left_anti"))
    raise RuntimeError(f"not settled after {rounds} rounds")


def sequential_dedup_rows(points: DataFrame, by: list[str], reach: float, least: float, axis: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """The rows of points (*by, confidence, ord, *axis) that matching.sequential_dedup() keeps: by falling confidence, those under least go, and
    those within reach of the last one kept.

    Rows come sorted, and a task remembers the last one kept, so groups of any size are never gathered."""
    key = F.to_json(F.struct(*by))
    rows = points.where(F.col("confidence") >= least).withColumn("_key", key).repartition("_key").sortWithinPartitions("_key", F.desc("confidence"), "ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = None, None
        for batch in batches:
            keys = batch.column("_key").to_pylist()
            at = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in axis], axis=1).tolist()
            keep = []
            for k, (name, p) in enumerate(zip(keys, at)):
                if name != group or last is None or sum((a - b) ** 2 for a, b in zip(p, last)) ** 0.5 >= reach:
                    group, last = name, p
                    keep.append(k)
            yield batch.drop_columns("_key").take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(run, points.schema)


def placed(points: DataFrame, by: list[str], ord_: str = "ord") -> DataFrame:
    """points with ord from 0 in each frame."""
    return points.withColumn("ord", F.row_number().over(Window.partitionBy(*by).orderBy(ord_)) - 1)
