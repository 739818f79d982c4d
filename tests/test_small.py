"""Helpers that no query shows."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import generate, metrics, samples
from tessera.sources import readers


def test_instruments_of_three_encodings(spark):
    df = spark.createDataFrame([(["a", None], [("b", None, "left"), ("c", "Not Visible", None)], {"d": ("Visible", None)})], "n array<string>, s array<struct<name:string,presence:string,position:string>>, m map<string,struct<presence:string,position:string>>")
    found = df.select(*[generate.normal_instruments(k, c).alias(c) for k, c in (("names", "n"), ("structs", "s"), ("map", "m"))]).first()
    assert [tuple(x) for x in found.n] == [("a", "Visible", "Unknown"), (None, "Visible", "Unknown")]
    assert [tuple(x) for x in found.s] == [("b", "Visible", "left"), ("c", "Not Visible", "Unknown")]
    assert [tuple(x) for x in found.m] == [("d", "Visible", "Unknown")]
    with pytest.raises(ValueError):
        generate.normal_instruments("other", "n")


def test_chat_text_and_leading_points(spark):
    df = spark.createDataFrame([([("user", "hi"), ("assistant", "yes\nno")], [("x", "i"), ("y", "a"), ("z", "i"), ("w", "i"), ("v", "a")])], "m array<struct<role:string,content:string>>, p array<struct<label:string,category:string>>")
    r = df.select(T.chat_text(F.col("m")).alias("text"), samples.leading(F.col("p"), {"i": 2, "a": 3}).alias("p")).first()
    assert r.text == "User: hi\nAssistant: yes\nno"
    assert [x.label for x in r.p] == ["x", "z", "y", "v"]


def test_made_up_frames(spark):
    rows = readers.sample_annotations(spark, ["one", "two"], 7).collect()
    assert [r.frame_id for r in rows] == [f"video_01_frame_{k:06d}" for k in range(7)] and {r.phase for r in rows} <= {"one", "two"}


def test_task_metrics_of_few_rows(spark):
    rows = [("t", "a", "a"), ("t", "a", "b"), ("t", "b", None), ("t", None, "a"), ("u", "a", None), (None, "a", "a")]
    found = {r.task: r for r in metrics.task_metrics(spark.createDataFrame(rows, "task string, truth string, predicted string")).collect()}
    assert found["t"].n == 3 and found["t"].accuracy == pytest.approx(1 / 3)
    assert (found["t"].precision, found["t"].recall) == (pytest.approx((1 + 0) / 2), pytest.approx((0.5 + 0) / 2))
    assert (found["u"].precision, found["u"].recall, found["u"].f1) == (0.0, 0.0, 0.0)
    assert found[None].f1 == pytest.approx(1.0)


def test_order_of_ground_truth_over_files(spark, tmp_path):
    for video, n in ((2, 3), (10, 200), (1, 1)):
        (tmp_path / f"video_{video}.csv").write_text("int_time,str_step\n" + "".join(f"{k},s{k}\n" for k in range(n)))
    rows = readers.ground_truth(spark, str(tmp_path / "*.csv"), "steps").orderBy("ord").collect()
    assert [(r.video, r.int_time) for r in rows] == [(v, k) for v, n in ((1, 1), (2, 3), (10, 200)) for k in range(n)]
    assert len({r.ord for r in rows}) == len(rows)
