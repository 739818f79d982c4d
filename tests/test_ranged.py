"""Files read by ranges: vectors, archives and videos, against the files' contents."""

import os
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.sources import ranged, readers, writers
from test_io import brute_blur

# Vectors


@pytest.mark.parametrize("size", [37, 400, 1 << 20])
def test_arrays_by_ranges(spark, tmp_path, size):
    rng = np.random.default_rng(2)
    arrays = {"a": rng.normal(size=(101, 7)).astype(np.float32), "sub/b": np.asfortranarray(rng.normal(size=(33, 5))), "c": rng.integers(0, 9, 11), "d": np.zeros((0, 4), np.float32), "e": rng.normal(size=(50, 1)).astype(np.float16)}
    (tmp_path / "sub").mkdir()
    for name, a in arrays.items():
        np.save(tmp_path / f"{name}.npy", a)
    df = readers.stored_vectors(spark, str(tmp_path), size)
    found = {}
    for r in df.collect():
        found.setdefault(os.path.relpath(r.file, tmp_path)[:-4], {})[r.ord] = r.embedding
    assert {k: [v[i] for i in range(len(v))] for k, v in found.items()} == {k: np.atleast_2d(a).astype(np.float32).tolist() for k, a in arrays.items() if a.size}
    assert size > 1000 or df.rdd.getNumPartitions() > 10


def test_array_written_by_many_tasks(spark, tmp_path):
    n, width = 20_000, 8
    df = spark.range(n, numPartitions=7).select((n - F.col("id")).alias("k"), F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (F.col("id") * 10 + i).cast("float")).alias("embedding"), F.lit("x").alias("file"))
    writers.vectors(df, str(tmp_path / "v"), "k")
    wanted = (np.arange(n - 1, -1, -1)[:, None] * 10 + np.arange(width)).astype(np.float32)
    assert np.array_equal(np.load(tmp_path / "v.npy"), wanted)
    first = (tmp_path / "v.npy").read_bytes()
    again = readers.stored_vectors(spark, str(tmp_path / "v.npy"), 50_000)
    assert again.rdd.getNumPartitions() > 10
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # one part would hold these few rows
    try:
        writers.vectors(again.withColumnRenamed("ord", "k"), str(tmp_path / "w"), "k")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (tmp_path / "w.npy").read_bytes() == first
    assert len(list((tmp_path / "w").glob("*.parquet"))) > 1


def test_arrays_that_cannot_be_written(spark, tmp_path):
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [1.0]), (2, None)]):
        with pytest.raises(ValueError, match="one length"):
            writers.vectors(spark.createDataFrame(bad, "k long, embedding array<float>"), str(tmp_path / "v"), "k")
    writers.vectors(spark.createDataFrame([], "k long, embedding array<float>"), str(tmp_path / "none"), "k")
    assert np.load(tmp_path / "none.npy").shape == (0, 0)


# Archives


def test_archives_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(4)
    wanted = {}
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w", zipfile.ZIP_DEFLATED if k else zipfile.ZIP_STORED) as z:
            for i in range(20):
                body = rng.bytes(int(rng.integers(0, 3000)))
                z.writestr(f"dir/v{i}.{'mp4' if i % 3 else 'txt'}", body)
                if i % 3:
                    wanted[f"{k}.zip", f"dir/v{i}.mp4"] = body
    (tmp_path / "broken.zip").write_bytes(b"PK nothing")
    df = readers.zip_entries(spark, str(tmp_path), range_bytes=2000)
    found = df.collect()
    assert {(os.path.basename(r.archive), r.name): bytes(r.content) for r in found} == wanted and len(found) == len(wanted)
    assert df.rdd.getNumPartitions() > 20


# Videos


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(frames, fps, size, raw=False, index=True, absolute=False, records=False, audio_first=False):
    """A file of frames, 00dc or 00db chunks, with sound between them."""
    width, height = size
    video = 1 if audio_first else 0
    scale, rate = (1, fps) if fps else (0, 0)
    strh = lambda kind: kind + b"MJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, scale, rate, 0, len(frames), 0, 0, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0 if raw else 0x47504A4D, 0, 0, 0, 0, 0)
    streams = [chunk(b"LIST", b"strl" + chunk(b"strh", strh(b"vids")) + chunk(b"strf", strf)), chunk(b"LIST", b"strl" + chunk(b"strh", strh(b"auds")) + chunk(b"strf", b"\1\0" * 8))]
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<14I", 0, 0, 0, 0, len(frames), 0, 2, 0, width, height, 0, 0, 0, 0)) + b"".join(streams[::-1] if audio_first else streams))
    start = 12 + len(head) + 8  # of the name "movi"
    body, table = b"movi", b""
    for f in frames:
        for name, data in ((b"%02d" % video + (b"db" if raw else b"dc"), f), (b"%02dwb" % (1 - video), b"sound")):
            table += name + struct.pack("<III", 16, len(body) + (start if absolute else 0), len(data))
            body += chunk(b"LIST", b"rec " + chunk(name, data)) if records else chunk(name, data)
    whole = head + chunk(b"LIST", body) + (chunk(b"idx1", table) if index else b"")
    return b"RIFF" + struct.pack("<I", 4 + len(whole)) + b"AVI " + whole


def picture(size, sharp, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 256, (size[1], size[0], 3)) if sharp else np.full((size[1], size[0], 3), 40 + seed % 100)
    return a.astype(np.uint8)


def jpeg(jvm, pixels):
    h, w, _ = pixels.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    packed = pixels.astype(int) @ np.array([1 << 16, 1 << 8, 1])
    for y in range(h):
        for x in range(w):
            image.setRGB(x, y, int(packed[y, x]) - (1 << 24))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def dib(pixels):
    h, w, _ = pixels.shape
    rows = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, -1)
    return rows.tobytes()


@pytest.fixture(scope="module")
def videos(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("videos")
    size = (70, 66)
    sharp, flat = (jpeg(spark._jvm, picture(size, s, 3)) for s in (True, False))
    tagged = lambda f, k: f[:2] + b"\xff\xfe" + struct.pack(">H", 6) + b"%04d" % k + f[2:]  # noqa: E731  a comment tells frames apart
    jpegs = [tagged(sharp if k % 3 else flat, k) for k in range(47)]
    raws = [picture(size, k % 4 == 0, k) for k in range(65)]
    (folder / "sub").mkdir()
    (folder / "a.avi").write_bytes(avi(jpegs, 10, size))
    (folder / "sub" / "B.AVI").write_bytes(avi(jpegs, 10, size, absolute=True, audio_first=True))
    (folder / "c.avi").write_bytes(avi(jpegs, 10, size, index=False, records=True))
    (folder / "raw.avi").write_bytes(avi([dib(p) for p in raws], 0, size, raw=True))
    (folder / "broken.avi").write_bytes(b"RIFF????AVI nothing")
    (folder / "text.avi").write_bytes(b"no video")
    (folder / "empty.avi").write_bytes(b"")
    (folder / "none.avi").write_bytes(avi([], 10, size))
    (folder / "small.avi").write_bytes(avi([jpeg(spark._jvm, picture((20, 10), True, 1)), b"no picture"], 1, (20, 10)))
    cut = avi(jpegs, 10, size)
    (folder / "cut.avi").write_bytes(cut[: len(cut) * 2 // 3])
    return folder, jpegs, raws


@pytest.mark.parametrize(("fps", "start", "end", "size"), [(1.0, None, None, 1 << 25), (3.0, 0.7, 3.95, 4000), (100.0, None, 2.0, 1000), (4.0, 2.5, 99.0, 30_000)])
def test_sampled_frames(spark, videos, fps, start, end, size):
    folder, jpegs, raws = videos
    found = ranged.video_frames(spark, str(folder), fps, start, end, range_bytes=size).collect()
    by = {}
    for r in found:
        by.setdefault(r.video, []).append(r)
    for name, frames, rate in (("a", jpegs, 10.0), ("B", jpegs, 10.0), ("c", jpegs, 10.0), ("raw", raws, 30.0)):
        stride, lo, hi = max(1, int(rate / fps)), int((start or 0) * rate), len(frames) if end is None else min(int(end * rate), len(frames))
        wanted = list(range(lo, hi, stride))
        rows = sorted(by.get(name, []), key=lambda r: r.frame)
        assert [r.frame for r in rows] == wanted
        assert [(r.time, r.video_fps, r.video_frames, r.width, r.height, r.reason) for r in rows] == [(k / rate, rate, len(frames), 70, 66, None) for k in wanted]
        assert name == "raw" or [bytes(r.content) for r in rows] == [frames[k] for k in wanted]
    for name in ("broken", "text", "empty", "none"):
        (r,) = by[name]
        assert r.frame is None and r.content is None and r.reason
    assert "cut" in by


def test_broken_and_small_frames(spark, videos):
    folder, jpegs, _ = videos
    small = sorted(ranged.video_frames(spark, str(folder / "small.avi")).collect(), key=lambda r: r.frame)
    assert [(r.frame, r.content, r.reason) for r in small] == [(0, None, "too small: 20x10"), (1, None, "unknown format")]
    cut = sorted(ranged.video_frames(spark, str(folder / "cut.avi"), 100).collect(), key=lambda r: r.frame)
    good = [r for r in cut if r.content is not None]
    assert [bytes(r.content) for r in good] == jpegs[: len(good)] and 0 < len(good) < len(jpegs)
    assert {r.reason for r in cut[len(good) :]} == {"truncated"} and len(cut) == len(good) + 1  # without its index, up to the cut
    with pytest.raises(ValueError):
        ranged.video_frames(spark, str(folder), 0)


def test_extraction(spark, videos, tmp_path):
    folder, jpegs, raws = videos
    frames, totals = ranged.extracted(spark, str(folder), f"{tmp_path}/out", 5.0, threshold=100.0, end=4.0)
    rows = {(r.video, r.frame): r for r in frames.collect()}
    luma = lambda p: np.rint(p.astype(float) @ np.array([0.299, 0.587, 0.114]))
    for k in range(0, 65, 6):
        r = rows["raw", k]
        assert r.blur == pytest.approx(brute_blur(luma(raws[k])), rel=1e-9) and r.saved == (k % 4 == 0) and r.blurry == (k % 4 != 0)
    kept = [k for k in range(0, 40, 2) if k % 3]
    assert [rows["a", k].name for k in kept] == [f"a_frame_{i:06d}.png" for i in range(len(kept))]
    assert all(rows["a", k].name is None and rows["a", k].blurry for k in range(0, 40, 6))
    found = {r.video: r for r in totals.collect()}
    assert found.keys() == {"a", "B", "c", "raw", "broken", "text", "empty", "none", "small", "cut"}
    for name in "aBc":
        assert (found[name].sampled, found[name].blurry, found[name].saved, found[name].errors, found[name].blur_rate) == (20, 7, 13, 0, 35.0)
    assert (found["small"].sampled, found["small"].errors, found["small"].saved, found["small"].reason) == (2, 2, 0, None)
    assert found["text"].reason == "not an AVI file" and found["text"].sampled == 0
    total = stats.extraction_totals(totals.select("sampled", F.col("saved").alias("kept"), "blurry")).first()
    assert total.sampled == sum(r.sampled for r in found.values()) and total.blurry == sum(r.blurry for r in found.values())
    every, _ = ranged.extracted(spark, str(folder / "a.avi"), f"{tmp_path}/all", 5.0, filter_blur=False)
    assert every.where("saved").count() == 24 and every.where("blurry").count() == 0
