"""Stateful streams against batch queries and simulations, over several micro-batches and a restart; annotators that fail."""

import hashlib
import json
import math
import sys
from collections import OrderedDict

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.functions import images as I
from tessera.operators import annotate
from tessera.streaming import ingest, state

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file
HOURS = 472_222
FRAMES = "video string, frame long, pixels array<int>, content string"


def write_batches(spark, folder, rows, size, first=0):
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], FRAMES).coalesce(1).write.mode("append").parquet(f"{folder}/b{first + k:05d}")


def drained(spark, df_of, folder, tmp, name):
    """Runs what is there to the end and returns all that was written so far."""
    source = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    ingest.run_available(df_of(source), f"{tmp}/{name}", f"{tmp}/{name}_point")
    return spark.read.parquet(f"{tmp}/{name}")


def made_frames(n, seed):
    rng = np.random.default_rng(seed)
    level = np.cumsum(rng.choice([0, 5, 60], (n, 1)), axis=0)
    return [(f"v{k % 3}", k, (level[k] + rng.integers(0, 9, 6)).tolist() if k % 17 else [int(k)], f"c{int(rng.integers(0, 9))}") for k in range(n)]


def test_scene_stream(spark, tmp_path):
    rows = made_frames(60, 1)
    of = lambda s: state.scene_stream(s, "video", "frame", "pixels")
    write_batches(spark, f"{tmp_path}/in", rows[:33], 17)
    first = drained(spark, of, f"{tmp_path}/in", tmp_path, "scenes").count()
    assert first == 33
    write_batches(spark, f"{tmp_path}/in", rows[33:], 17, 33)
    found = {(r.video, r.frame): (r.difference, r.change) for r in drained(spark, of, f"{tmp_path}/in", tmp_path, "scenes").collect()}
    wanted, last = {}, {}
    for video, frame, pixels, _ in rows:
        before = last.get(video)
        d = float(np.abs(np.array(pixels) - before).mean()) if before is not None and len(before) == len(pixels) else None
        wanted[video, frame] = (d, d is None or d > 30.0)
        last[video] = np.array(pixels)
    assert found == wanted and {c for _, c in wanted.values()} == {True, False}
    even = spark.createDataFrame([r for r in rows if len(r[2]) == 6], FRAMES)
    batch = {(r.video, r.frame): (r.difference, r.change) for r in I.scene_changes(even, "video", "frame", "pixels").collect()}
    write_batches(spark, f"{tmp_path}/even", [r for r in rows if len(r[2]) == 6], 40)
    assert {(r.video, r.frame): (r.difference, r.change) for r in drained(spark, of, f"{tmp_path}/even", tmp_path, "even").collect()} == batch


def test_cache_stream(spark, tmp_path):
    rows = made_frames(90, 2)
    rows[40] = (*rows[40][:3], None)
    of = lambda s: state.cached_stream(s, "video", "frame", "content", capacity=4)
    write_batches(spark, f"{tmp_path}/in", rows[:50], 25)
    drained(spark, of, f"{tmp_path}/in", tmp_path, "cache")
    write_batches(spark, f"{tmp_path}/in", rows[50:], 25, 50)
    found = {(r.video, r.frame): (r.content_md5, r.hit) for r in drained(spark, of, f"{tmp_path}/in", tmp_path, "cache").collect()}
    wanted, caches = {}, {}
    for video, frame, _, content in rows:
        cache = caches.setdefault(video, OrderedDict())
        digest = hashlib.md5((content or "").encode()).hexdigest()
        wanted[video, frame] = (digest, digest in cache)
        cache[digest] = True
        cache.move_to_end(digest)
        if len(cache) > 4:
            cache.popitem(last=False)
    assert found == wanted and {h for _, h in wanted.values()} == {True, False}


# Annotators


class Flaky(annotate.Annotator):
    """Fails for good on frames divisible by seven, once on those divisible by five, and on any batch with either."""

    made = 0

    def __init__(self):
        Flaky.made += 1
        self.tried = set()

    def annotate_frame(self, row):
        k = row["frame"]
        if k % 7 == 0:
            raise ValueError(f"frame {k}")
        if k % 5 == 0 and k not in self.tried:
            self.tried.add(k)
            raise TimeoutError("slow")
        return [{"x": k / 10, "y": 1, "label": f"l{k % 2}", "confidence": 0.5 + k % 5 / 10}, {"x": k / 10 + 0.05, "y": 1, "label": f"l{k % 2}"}]


class Steady(annotate.Annotator):
    def annotate_frame(self, row):
        return [{"x": row["frame"] / 10, "y": 1.02, "label": "l0", "confidence": 0.95}] if row["frame"] % 3 else []


class Down(annotate.Annotator):
    def annotate_frame(self, row):
        raise ConnectionError("no answer")


def test_annotators_lose_no_row(spark):
    frames = spark.range(40, numPartitions=3).select(F.col("id").alias("frame"), F.lit("x").alias("error"), F.concat(F.lit("v"), F.col("id") % 4).alias("video"))
    rows = {r.frame: r for r in annotate.annotated(frames, Flaky, "flaky", ["frame"], batch=4).collect()}
    assert rows.keys() == set(range(40))
    for k, r in rows.items():
        assert r.video == f"v{k % 4}" and r.annotator == "flaky"
        if k % 7 == 0:
            assert r.points is None and r.error == f"ValueError: frame {k}" and r.calls == 4
        else:
            assert r.error is None and [p.x for p in r.points] == [k / 10, k / 10 + 0.05] and r.points[1].confidence == 1.0
    down = annotate.annotated(frames.coalesce(1), Down, "down", ["frame"], budget=10).collect()
    assert len(down) == 40 and all(r.points is None for r in down)
    assert sum(r.calls for r in down) < 60 and sum("not tried" in r.error for r in down) >= 30


def test_points_of_several_annotators(spark):
    frames = spark.range(40).select(F.col("id").alias("frame"), F.when(F.col("id") % 2 == 0, "even").alias("video"))
    makers = {"flaky": Flaky, "steady": Steady, "down": Down}
    rows = None
    for name, make in makers.items():
        one = annotate.annotated(frames, make, f"{name} 2", ["frame"])
        rows = one if rows is None else rows.unionByName(one)
    found = {r.frame: r for r in annotate.merged(rows, ["frame", "video"]).select("*", annotate.as_json(F.col("points")).alias("text")).collect()}
    assert found.keys() == set(range(40))
    for k, r in found.items():
        points = ([] if k % 7 == 0 else [(k / 10, 1.0, f"l{k % 2}", 0.5 + k % 5 / 10, "flaky 2"), (k / 10 + 0.05, 1.0, f"l{k % 2}", 1.0, "flaky 2")]) + ([(k / 10, 1.02, "l0", 0.95, "steady 2")] if k % 3 else [])
        kept = []
        for label in {p[2] for p in points}:
            last = None
            for p in sorted((p for p in points if p[2] == label and p[3] >= 0.3), key=lambda p: (-p[3], p[4], points.index(p))):
                if last is None or math.dist(p[:2], last[:2]) >= 0.1:
                    kept.append(p)
                    last = p
        assert sorted(tuple(p) for p in r.points) == sorted(kept)
        assert [p.confidence for p in r.points] == sorted((p.confidence for p in r.points), reverse=True)
        assert (r.annotators, r.errors) == ((1, 2) if k % 7 == 0 else (2, 1)) and r.video == (None if k % 2 else "even")
        assert annotate.from_json(r.text) == [p.asDict() for p in r.points]


def test_a_factory_is_called_once_a_worker(spark):
    frames = spark.range(30, numPartitions=1).withColumnRenamed("id", "frame")

    def make():
        class Counted(annotate.Annotator):
            made = 0

            def annotate_frame(self, row):
                return [{"x": 0, "y": 0, "label": str(id(self))}]

        return Counted()

    assert annotate.annotated(frames, make, "counted", ["frame"], batch=3).select(F.explode("points").alias("p")).select("p.label").distinct().count() == 1


def test_hooks_without_a_test_before(spark, tmp_path):
    """ST6, ST7, windows of a stream, and rewards of made-up frames."""
    folder = f"{tmp_path}/in"
    rows = made_frames(20, 3)
    write_batches(spark, folder, rows, 7)
    source = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    progress = ingest.Progress()
    spark.streams.addListener(progress)
    try:
        bad = ingest.annotate(source, lambda c: F.when(c % 4 != 0, c * 2), "frame")
        bad.writeStream.foreachBatch(ingest.two_sinks(f"{tmp_path}/good", f"{tmp_path}/bad")).option("checkpointLocation", f"{tmp_path}/point").trigger(availableNow=True).start().awaitTermination()
        stamped = source.withColumn("time", F.timestamp_seconds(HOURS * 3600 + F.col("frame") * 1200))
        counts = ingest.windowed_counts(stamped, "time", "video")
        counts.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        seen = ingest.once_by_content(stamped, F.col("content").cast("binary"), "time", "10 days")
        seen.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.streams.removeListener(progress)
    assert {r.frame for r in spark.read.parquet(f"{tmp_path}/good").collect()} == {k for k in range(20) if k % 4}
    assert {(r.frame, r.error) for r in spark.read.parquet(f"{tmp_path}/bad").collect()} == {(k, f"no annotation for {k}") for k in range(0, 20, 4)}
    wanted = {}
    for video, k, *_ in rows:
        wanted[video, k // 3] = wanted.get((video, k // 3), 0) + 1
    assert {(r.video, int(r.start.timestamp()) // 3600 - HOURS): r.n for r in spark.table("windows").collect()} == wanted
    assert sorted(r.content_md5 for r in spark.table("seen").collect()) == sorted({hashlib.md5(c.encode()).hexdigest() for *_, c in rows})
    assert progress.rows >= 20 and progress.batches >= 3


def test_points_as_json(spark):
    df = spark.createDataFrame([([(1.0, None)],)], "p array<struct<x:double,label:string>>")
    assert json.loads(df.select(annotate.as_json(F.col("p"))).first()[0]) == [{"x": 1.0, "label": None}]
    with pytest.raises(NotImplementedError):
        annotate.Annotator().annotate_batch([{}])
