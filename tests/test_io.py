"""Readers, writers, images and column functions on small fixtures."""

import io
import json
import math
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import images as I
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import filters, generate, matching, sampling
from tessera.sources import readers, writers
from tessera.streaming import ingest

ROWS = [
    {"video_id": "v1", "label": "Drill ", "two_fps_timestamps": [1.0, 1.5], "points": [[{"x": 10, "y": 20}, {"x": 1, "y": 1}], [{"x": 30, "y": 40}]], "category": "instruments", "confidence": 0.9},
    {"video_id": "v1", "label": "gland", "two_fps_timestamps": [1.0], "points": [[]], "category": "anatomy", "confidence": 0.95},
    {"video_id": "v2", "label": "probe", "two_fps_timestamps": [2.5], "points": [[{"x": 5, "y": 6}]], "category": "instruments", "confidence": 0.5},
    {"video_id": "v2", "label": "bone", "two_fps_timestamps": [0.5], "points": [[{"x": 7}]], "category": "anatomy"},
]


@pytest.fixture
def annotations(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(ROWS))
    return readers.annotations(spark, str(tmp_path / "none.json"), str(tmp_path / "a.json"))


def test_annotation_scans(spark, annotations, tmp_path):
    assert annotations.count() == 4
    assert readers.annotations(spark, str(tmp_path / "none.json")).count() == 0
    assert readers.annotations(spark, str(tmp_path / "a.json"), category="anatomy").count() == 2
    first = sorted((r.video_id, r.label, r.ts, r.x, r.y) for r in readers.first_points(annotations).collect())
    assert first == [("v1", "Drill ", 1.0, 10.0, 20.0), ("v2", "bone", 0.5, 7.0, None), ("v2", "probe", 2.5, 5.0, 6.0)]
    sure = sorted((r.video_id, r.frame, r.label, r.x) for r in readers.confident_points(annotations).collect())
    assert sure == [("v1", 2, "drill", 10.0), ("v1", 3, "drill", 30.0)]
    by_time = filters.by_first_time(annotations).collect()
    assert [r.label for r in by_time] == ["Drill ", "gland", "bone", "probe"]


def test_ground_truth_files(spark, tmp_path):
    for video, text in ((1, "int_time,str_step\n0,a\n10,\n"), (12, "int_time,str_step\n5,b\n")):
        (tmp_path / f"steps_{video:02d}.csv").write_text(text)
    rows = sorted((r.video, r.int_time, r.str_step) for r in readers.ground_truth(spark, str(tmp_path / "steps_*.csv"), "steps").collect())
    assert rows == [(1, 0, "a"), (1, 10, None), (12, 5, "b")]
    assert readers.ground_truth(spark, str(tmp_path / "none_*.csv"), "instruments").count() == 0
    (tmp_path / "i_03.csv").write_text("int_time,str_instrument1,str_instrument2,pos_instrument1,pos_instrument2\n0,drill,,1,\n0,ring,probe,2,3\n")
    last = matching.last_per_key(readers.ground_truth(spark, str(tmp_path / "i_*.csv"), "instruments"), ["video", "int_time"]).collect()
    assert [(r.str_instrument1, r.pos_instrument2) for r in last] == [("ring", "3")]


def test_folders_of_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"annotations": [{"frame_id": "f1", "phase": "p"}, {"id": "f2"}]}')
    (tmp_path / "in/b.json").write_text('[{"frame_id": "f3"}]')
    (tmp_path / "in/c.json").write_text("{broken")
    found = readers.frame_annotations(spark, str(tmp_path / "in")).collect()
    assert sorted(r.frame_id for r in found if not r.corrupt) == ["f1", "f2", "f3"] and sum(r.corrupt for r in found) == 1
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/a.json").write_text('[{"frame_id": "f3"}]')
    (tmp_path / "csv/b.csv").write_text("frame_id,phase\nf9,x\n")
    both = {r.frame_id: json.loads(r.body) for r in readers.documents_of(spark, str(tmp_path / "csv")).where("file like '%.csv'").collect()}
    assert both == {"f9": {"frame_id": "f9", "phase": "x"}}


@pytest.mark.parametrize("text", ['[{"question": "q?", "answer": "a"}]', '{"qa_pairs": [{"question": "q?", "answer": "a"}]}', '{"annotations": [{"question": "q?", "answer": "a"}]}', '{"data": [{"question": "q?", "answer": "a"}]}'])
def test_question_files(spark, tmp_path, text):
    (tmp_path / "q.json").write_text(text)
    assert [(r.question, r.answer) for r in readers.qa_pairs(spark, str(tmp_path / "q.json")).collect()] == [("q?", "a")]
    (tmp_path / "q.csv").write_text("frame_id,question,answer,question_type,video_id\nf,q?,a,t,v\n")
    assert [(r.question, r.answer) for r in readers.qa_pairs(spark, str(tmp_path / "q.csv")).collect()] == [("q?", "a")]


def test_split_datasets(spark, tmp_path):
    df = spark.createDataFrame([(i, "train" if i < 8 else "validation") for i in range(10)], "i long, split string")
    writers.parquet_by_split(df, str(tmp_path / "by"))
    assert {(r.split, r["count"]) for r in readers.split_dataset(spark, str(tmp_path / "by")).groupBy("split").count().collect()} == {("train", 8), ("validation", 2)}
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "files/data").mkdir(parents=True)
    for name, n in (("train-0", 3), ("test", 2), ("validation", 0)):
        pq.write_table(pa.table({"i": list(range(n))}, schema=pa.schema([("i", pa.int64())])), tmp_path / f"files/data/{name}.parquet")
    assert {(r.split, r["count"]) for r in readers.split_dataset(spark, str(tmp_path / "files")).groupBy("split").count().collect()} == {("train", 3), ("test", 2)}
    done = spark.createDataFrame([(1,), (2,)], "i long")
    assert [r.i for r in readers.unprocessed(spark.range(6).toDF("i").withColumn("ord", F.col("i")), done, "i", 2).collect()] == [0, 3]


def test_vectors_and_archives(spark, tmp_path):
    df = spark.createDataFrame([(2, [0.5, 1.0]), (1, [2.0, 3.0])], "k long, embedding array<float>")
    writers.vectors(df, str(tmp_path / "v"), "k")
    assert np.load(tmp_path / "v.npy").tolist() == [[2.0, 3.0], [0.5, 1.0]]
    assert [r.embedding for r in readers.stored_vectors(spark, str(tmp_path)).orderBy("ord").collect()] == [[2.0, 3.0], [0.5, 1.0]]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("b.MP4", b"two")
        z.writestr("a.mp4", b"one")
        z.writestr("note.txt", b"no")
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    assert [(r.name, bytes(r.content)) for r in readers.zip_entries(spark, str(tmp_path)).collect()] == [("a.mp4", b"one"), ("b.MP4", b"two")]


def png(pixels, kinds):
    h, w, n = pixels.shape
    raw, before = b"", np.zeros(w * n, int)
    for y in range(h):
        line, kind = pixels[y].reshape(-1).astype(int), kinds[y % len(kinds)]
        left, corner = np.concatenate([np.zeros(n, int), line[:-n]]), np.concatenate([np.zeros(n, int), before[:-n]])
        p = left + before - corner
        d = np.abs([p - left, p - before, p - corner])
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], before, corner))
        raw += bytes([kind]) + ((line - [0, left, before, (left + before) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
        before = line
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return I.PNG_MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_png_pixels(n):
    pixels = np.random.default_rng(n).integers(0, 256, (11, 7, n)).astype(np.uint8)
    assert (I.png_pixels(png(pixels, [0, 1, 2, 3, 4])) == pixels).all()


def brute_blur(g):
    h, w = g.shape
    at = lambda y, x: g[abs(y) if y < h else 2 * h - 2 - y, abs(x) if x < w else 2 * w - 2 - x]
    out = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(h) for x in range(w)]
    return float(np.var(out))


def test_images(spark, tmp_path):
    sharp = np.random.default_rng(0).integers(0, 256, (9, 8, 3)).astype(np.uint8)
    flat = np.full((6, 6, 1), 90, np.uint8)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 30, 40, 3) + bytes(9)
    files = {"v1/f_1.png": png(sharp, [4]), "v1/f_10.png": png(flat, [0]), "v1/f_2.png": png(sharp, [0])[:-20], "v2/x_3.jpg": jpeg, "v2/y_4.png": b"no image"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    listed = readers.frames(spark, str(tmp_path), content=True)
    found = {(r.video, r.frame): r for r in I.inspected(listed).collect()}
    one = found["v1", 1]
    assert (one.format, one.mode, one.width, one.height, one.valid, one.reason) == ("PNG", "RGB", 8, 9, True, None)
    luma = np.rint(sharp @ np.array([0.299, 0.587, 0.114]))
    assert one.blur == pytest.approx(brute_blur(luma)) and found["v1", 10].blur == 0
    assert (found["v2", 3].format, found["v2", 3].width, found["v2", 3].height) == ("JPEG", 40, 30)
    assert found["v1", 2].reason == "truncated" and found["v2", 4].reason == "unknown format" and not found["v2", 4].valid
    blurry = I.inspected(listed).where(I.is_blurry(F.col("blur"))).collect()
    assert [r.frame for r in blurry] == [10]
    assert [r.frame for r in readers.frames(spark, str(tmp_path / "v1"), every=2).orderBy("path").collect()] == [1, 2]


def test_image_columns(spark):
    raw = b"\x00\xff"
    df = spark.createDataFrame([(raw, (raw, "p"), ((raw, "p"),), "data:image/png;base64,AP8=")], "a binary, b struct<bytes:binary,path:string>, c struct<image:struct<bytes:binary,path:string>>, d string")
    assert [bytes(x) for x in df.select(*[readers.image_bytes(df, c).alias(c) for c in "abcd"]).first()] == [raw] * 4
    assert df.select(I.encoded(F.col("a"))).first()[0] == "AP8="
    with pytest.raises(ValueError):
        readers.image_bytes(spark.range(1), "id")


def test_followed_points(spark):
    df = spark.createDataFrame([(10.0, 10.0, [(11.0, 10.0, -1, 0.0, 0.0), (13.0, 14.0, 2, 50.0, 60.0), (20.0, 20.0, 3, 1.0, 1.0)]), (0.0, 0.0, [(30.0, 0.0, 1, 5.0, 5.0)]), (0.0, 0.0, [])], "x double, y double, k array<struct<x:double,y:double,match:int,mx:double,my:double>>")
    assert [r[0] and tuple(r[0]) for r in df.select(I.followed(F.col("x"), F.col("y"), F.col("k"))).collect()] == [(50.0, 60.0), None, None]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 2 else f"t{i}") for i in range(20)], "i long, text string")
    writers.json_array(df.orderBy("i"), str(tmp_path / "a.json"))
    assert json.loads((tmp_path / "a.json").read_text())[:3] == [{"i": 0, "text": "t0"}, {"i": 1, "text": "t1"}, {"i": 2, "text": None}]
    writers.training_lines(df, str(tmp_path / "set"), "i", "A set")
    assert (tmp_path / "set/README.md").read_text() == "# A set\n\n- train: 18\n- validation: 2\n"
    assert spark.read.json(str(tmp_path / "set")).count() == 20
    points = spark.createDataFrame([("v", "drill", 1.0, 2.0, 3.0, "instruments", 0.5)], "video_id string, label string, ts double, x double, y double, category string, confidence double")
    writers.annotation_export(points, str(tmp_path / "out"))
    assert json.loads((tmp_path / "out/statistics.json").read_text())["n"] == 1 and "| 1 |" in (tmp_path / "out/report.md").read_text()
    assert spark.read.json(str(tmp_path / "out/points")).first().annotator_unsure
    writers.csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 20


def test_review_is_resumed(spark, tmp_path):
    items, path = spark.range(5).toDF("k"), str(tmp_path / "review")
    assert writers.open_items(items, path, "k").count() == 5
    writers.save_review(spark.createDataFrame([(1, "accepted"), (3, "rejected")], "k long, decision string"), path)
    assert sorted(r.k for r in writers.open_items(items, path, "k").collect()) == [0, 2, 4]
    writers.save_review(spark.createDataFrame([(0, "modified")], "k long, decision string"), path)
    assert sorted(r.k for r in writers.open_items(items, path, "k").collect()) == [2, 4]


def test_detections_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("f", "a", 0.5, [0.0, 0.0, 1.0, 0.5], None), ("g", "b", 0.5, [0.0, 0.0, 1.0, 1.0], [0.1, 0.2])], "frame_id string, label string, confidence double, bbox array<double>, center array<double>")
    writers.detections(df, str(tmp_path / "d"))
    assert {r.frame_id: r.center for r in writers.read_detections(spark, str(tmp_path / "d")).collect()} == {"f": [0.5, 0.25], "g": [0.1, 0.2]}
    writers.by_decision(spark.createDataFrame([(1, "accepted")], "k long, decision string"), str(tmp_path / "by"))
    assert (tmp_path / "by/decision=accepted").is_dir()


def test_reports_have_bounds(spark):
    df = spark.createDataFrame([("a_b", 0.5, None)], "name string, x double, y double")
    assert "| a_b | 0.500 | - |" in writers.markdown(df, "T") and r"a\_b & 0.500 & -" in writers.latex(df, "T") and "<td>a_b</td>" in writers.html(df, "T")
    with pytest.raises(ValueError):
        writers.markdown(spark.range(2000), "T")


def brute_rouge(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    p, r = n[-1][-1] / len(a) if a else 0, n[-1][-1] / len(b) if b else 0
    return 2 * p * r / (p + r) if p + r else 0.0


def test_rouge_l(spark):
    pairs = [("the drill is at left", "The drill, it is left."), ("", "x"), (None, None), ("a b c d", "d c b a"), ("same words", "same words"), ("cuts cut", "cut cuts")]
    found = T.rouge_l(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    import re

    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    assert [r.rouge_l for r in found] == pytest.approx([brute_rouge(words(a), words(b)) for a, b in pairs])
    stemmed = T.rouge_l(spark.createDataFrame(pairs[-1:], "a string, b string"), "a", "b", stem=lambda w: w.rstrip("s"))
    assert stemmed.first().rouge_l == 1


def test_skill_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(V.normalised(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_preferences_differ(spark):
    rows = [("q1", "The answer", "i"), ("q2", "ANOTHER one", "i"), ("q3", "see the, The end", "i"), ("q4", "then", "i"), ("q5", None, "i")]
    found = {r.prompt: (r.chosen, r.rejected) for r in generate.dpo_rows(spark.createDataFrame(rows, "prompt string, answer string, image string"), ["the", "a b"], "none").collect()}
    assert found == {"q1": ("The answer", "a b answer"), "q2": ("ANOTHER one", "none"), "q3": ("see the, The end", "see a b, a b end"), "q4": ("then", "none"), "q5": (None, "none")}


def test_positions_are_those_of_the_named(spark):
    frames = spark.createDataFrame([("f", "p", None, [("drill", "Not Visible", "left"), ("ring", "Visible", "top"), ("hook", None, "")], None), ("g", None, None, [], None)], "frame_id string, phase string, step string, instruments array<struct<name:string,presence:string,position:string>>, operation_note string")
    found = {(r.frame_id, r.question_type): (r.question, r.answer) for r in generate.frame_questions(frames, ["p", "q"], ["s"], ["drill", "ring"]).collect()}
    assert found["f", "instrument_position"][1] == "top" and "ring" in found["f", "instrument_position"][0]
    assert found["f", "instrument_what"][1] == "ring and hook" and ("g", "instrument_what") not in found and found["g", "instrument_count"][1] == "None"
    one = generate.frame_questions(frames, ["p", "q"], ["s"], ["drill", "ring"], slots=2)
    assert {r.question_type for r in one.collect()} <= {"phase", "step"}


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else f"g{i % 4}") for i in range(40)], "i long, g string")
    split = sampling.group_split(df, "g").collect()
    assert len(split) == 40 and len({r.split for r in split if r.g is None}) == 1
    sample = sampling.sample_by_rate(df, "i", "g", {"g1": 0.5, "g2": 0.1}).collect()
    assert {k: sum(r.g == k for r in sample) for k in (None, "g1", "g2", "g3")} == {None: 1, "g1": 5, "g2": 1, "g3": 1}
    assert "_take" not in sample[0].asDict()


def test_hooks(spark):
    df = ingest.hooked(spark.range(4), lambda d: d.where("id > 0"), lambda d: d.withColumn("x", F.col("id") * 2))
    out = ingest.with_columns_of(df, {"reward": lambda d: F.col("x") + 1, "prediction": lambda d: F.lit("p")}).collect()
    assert [(r.id, r.reward, r.prediction) for r in out] == [(1, 3, "p"), (2, 5, "p"), (3, 7, "p")]
