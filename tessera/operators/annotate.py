"""Annotators (X1, X3, X4 as a boundary): a protocol for models that label frames, and an operator that runs them over Arrow batches.

An annotator is made once in each worker process by its factory. A batch that fails is tried again row by row, a row that fails
again up to `retries` times. After `budget` failed calls in a row the model counts as down, and the task's other rows are not tried. No
row is lost: what failed has an error.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.matching import sequential_dedup

RETRIES, BUDGET, BATCH = 2, 100, 32
POINT = "struct<x:double,y:double,label:string,confidence:double>"


class Annotator:
    """annotate_frame() gives the points of one row, dicts with x, y, label and confidence (missing ones are null, confidence 1).
    annotate_batch() may do several at once."""

    name = "annotator"

    def annotate_frame(self, row: dict) -> list[dict]:
        raise NotImplementedError

    def annotate_batch(self, rows: list[dict]) -> list[list[dict]]:
        return [self.annotate_frame(row) for row in rows]


class Copier(Annotator):
    """Gives a row's own x, y and label, as sure as its y is high: a stand-in for a model, and a check of its boundary."""

    def annotate_frame(self, row: dict) -> list[dict]:
        return [{"x": row["x"], "y": row["y"], "label": row["label"], "confidence": row["y"] / 100}]


class Picky(Annotator):
    """Fails on rows whose source is error; else two points, one on the row's and one ten beside it."""

    def annotate_frame(self, row: dict) -> list[dict]:
        if row["source"] == "error":
            raise ValueError("no frame")
        return [{"x": row["x"] + 1, "y": row["y"], "label": row["label"], "confidence": 0.6}, {"x": row["x"] + 10, "y": row["y"], "label": row["label"], "confidence": 0.4}]


_made: dict[str, Annotator] = {}


def _point(p: dict) -> dict:
    number = lambda v: None if v is None else float(v)
    return {"x": number(p.get("x")), "y": number(p.get("y")), "label": p.get("label"), "confidence": float(p.get("confidence", 1.0))}


class _Runner:
    def __init__(self, tool: Annotator, retries: int, budget: int, pause: float) -> None:
        self.tool, self.retries, self.budget, self.left, self.pause = tool, retries, budget, budget, pause

    def rows(self, rows: list[dict]) -> list[tuple[list[dict] | None, str | None, int]]:
        """(points, error, calls) of each row."""
        try:
            found = self.tool.annotate_batch(rows)
            if len(found) != len(rows):
                raise ValueError(f"{len(found)} results for {len(rows)} rows")
            found = [([_point(p) for p in f], None, 1) for f in found]
            self.left = self.budget
            return found
        except Exception:  # noqa: BLE001  whatever a model raises
            self.left -= 1
        return [self.row(r) for r in rows]

    def row(self, row: dict) -> tuple[list[dict] | None, str | None, int]:
        calls, error = 1, ""
        for attempt in range(self.retries + 1):
            if self.left < 0:
                return None, f"not tried, too many failures: {error}".rstrip(": "), calls
            try:
                calls += 1
                found = [_point(p) for p in self.tool.annotate_frame(row)]
                self.left = self.budget
                return found, None, calls
            except Exception as e:  # noqa: BLE001
                error, self.left = f"{type(e).__name__}: {e}", self.left - 1
                time.sleep(self.pause * 2**attempt)
        return None, error, calls


def annotated(frames: DataFrame, factory: Callable[[], Annotator], name: str, columns: list[str], retries: int = RETRIES, budget: int = BUDGET, batch: int = BATCH, pause: float = 0.0) -> DataFrame:
    """Frames with annotator, points, error and calls; the annotator sees `columns`. Points are null where there is an error.

    budget: failed calls of a task, none good between them, after which its rows are not tried; pause: seconds before the first retry, doubled for each
    further one. A factory that fails fails the task, since nothing could be annotated."""
    kept = frames.drop("annotator", "points", "error", "calls")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    point = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("label", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _made:
            _made[name] = factory()
        runner = _Runner(_made[name], retries, budget, pause)  # a budget for each task
        for big in batches:
            for lo in range(0, big.num_rows, batch):
                part = big.slice(lo, batch)
                found = runner.rows(part.select(columns).to_pylist())
                points, errors, calls = zip(*found)
                more = [pa.array([name] * len(part), pa.string()), pa.array(points, point), pa.array(errors, pa.string()), pa.array(calls, pa.int32())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "annotator", "points", "error", "calls"])

    return kept.mapInArrow(run, ", ".join([*fields, "annotator string", f"points array<{POINT}>", "error string", "calls int"]))


def merged(rows: DataFrame, by: list[str], reach: float = 0.1, least: float = 0.3) -> DataFrame:
    """Z3: the points of all annotators of a frame as one list: by label, sequential dedup (W16); a frame whose annotators all failed has none.

    rows: those of annotated(), several annotators in union. Returns (*by, points, annotators, errors)."""
    from pyspark.sql import Window

    each = rows.select(*by, "annotator", F.posexplode("points").alias("_place", "_p")).where("_p.confidence >= 0").withColumn("_label", F.col("_p.label"))
    rank = F.row_number().over(Window.partitionBy(*by, "_label").orderBy("annotator", "_place"))
    one = F.struct("_p.x", "_p.y", "_p.label", "_p.confidence", F.col("annotator"), F.col("_rank").alias("ord"))
    lists = each.withColumn("_rank", rank).groupBy(*by, "_label").agg(F.collect_list(one).alias("p"))
    kept = lists.select(*by, F.explode(sequential_dedup(F.col("p"), reach, least)).alias("_p"))
    points = kept.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("_p.confidence")).alias("_c"), *[F.col(f"_p.{c}").alias(c) for c in ("label", "ord", "x", "y", "confidence", "annotator")]))).alias("points"))
    sums = rows.groupBy(*by).agg(F.count_if(F.col("error").isNull()).alias("annotators"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    a, b = sums.alias("a"), points.alias("b")
    same = F.lit(True)
    for k in by:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    plain = F.transform("b.points", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), p.label.alias("label"), p.confidence.alias("confidence"), p.annotator.alias("annotator")))
    return a.join(b, same, "left").select("a.*", F.coalesce(plain, F.array().cast("array<struct<x:double,y:double,label:string,confidence:double,annotator:string>>")).alias("points"))


def as_json(points: Column) -> Column:
    """Z3: a frame's points as text."""
    return F.to_json(points, {"ignoreNullFields": "false"})


def from_json(text: str) -> list[dict]:
    return json.loads(text)
