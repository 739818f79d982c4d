"""Images of all kinds, written and read again by the JVM, and transforms against loops over pixels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import images as I
from tessera.functions import pixels as P
from test_io import brute_blur

W, H = 23, 17
# fixed values: image types of the JVM
INT_RGB, INT_ARGB, BYTE_GRAY, USHORT_GRAY, BYTE_BINARY, BYTE_INDEXED = 1, 2, 10, 11, 12, 13
KINDS = {"rgb.png": INT_RGB, "rgba.png": INT_ARGB, "gray.png": BYTE_GRAY, "wide.png": USHORT_GRAY, "bits.png": BYTE_BINARY, "palette.png": BYTE_INDEXED, "photo.jpg": INT_RGB, "gray.jpeg": BYTE_GRAY, "old.gif": BYTE_INDEXED, "plain.bmp": INT_RGB}


def write(jvm, path, kind, interlaced=False):
    rng = np.random.default_rng(kind)
    image = jvm.java.awt.image.BufferedImage(W, H, kind)
    for y in range(H):
        for x in range(W):
            if kind == USHORT_GRAY:
                image.getRaster().setSample(x, y, 0, int(rng.integers(0, 1 << 16)))
            else:
                image.setRGB(x, y, int(rng.integers(0, 1 << 24)) - (1 << 24))
    name = path.rsplit(".", 1)[1]
    file = jvm.java.io.File(path)
    if not interlaced:
        assert jvm.javax.imageio.ImageIO.write(image, name, file)
        return
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(name).next()
    param = writer.getDefaultWriteParam()
    param.setProgressiveMode(1)
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(file)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.close()


def brute_luma(jvm, path):
    """Rounded luma of each pixel as the JVM reads it; the upper byte of 16-bit greys."""
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(path))
    raster, bands, space = image.getRaster(), image.getRaster().getNumBands(), image.getColorModel().getColorSpace().getType()
    out = np.zeros((H, W))
    for y in range(H):
        for x in range(W):
            if space == 6:
                v = raster.getSample(x, y, 0)
                out[y, x] = v >> 8 if image.getColorModel().getComponentSize(0) == 16 else v
            else:
                c = image.getRGB(x, y)
                out[y, x] = np.rint(0.299 * (c >> 16 & 255) + 0.587 * (c >> 8 & 255) + 0.114 * (c & 255))
    assert bands
    return out


def test_blur_of_all_kinds(spark, tmp_path):
    jvm = spark._jvm
    (tmp_path / "clip").mkdir()
    wanted = {}
    for name, kind in KINDS.items():
        path = f"{tmp_path}/clip/{name.replace('.', '_7.')}"
        write(jvm, path, kind)
        wanted[path] = brute_blur(brute_luma(jvm, path))
    for name, kind in (("layers_8.png", INT_RGB), ("wide_9.png", USHORT_GRAY), ("bits_10.png", BYTE_BINARY)):
        path = f"{tmp_path}/clip/{name}"
        write(jvm, path, kind, interlaced=True)
        wanted[path] = brute_blur(brute_luma(jvm, path))
    whole = (tmp_path / "clip" / "photo_7.jpg").read_bytes()
    (tmp_path / "clip" / "called_11.png").write_bytes(whole)  # a JPEG by another name
    wanted[f"{tmp_path}/clip/called_11.png"] = wanted[f"{tmp_path}/clip/photo_7.jpg"]
    (tmp_path / "clip" / "cut_12.png").write_bytes((tmp_path / "clip" / "rgb_7.png").read_bytes()[:-30])
    (tmp_path / "clip" / "none_13.jpg").write_bytes(b"no image")
    (tmp_path / "clip" / "head_14.jpg").write_bytes(whole[:200])
    found = {r.path.removeprefix("file://"): r for r in I.inspected_files(spark, str(tmp_path)).collect()}
    assert found.keys() == {*wanted, *(f"{tmp_path}/clip/{x}" for x in ("cut_12.png", "none_13.jpg", "head_14.jpg"))}
    for path, blur in wanted.items():
        r = found[path]
        assert r.blur == pytest.approx(blur, rel=1e-9), path
        assert (r.width, r.height, r.valid, r.reason, r.video) == (W, H, True, None, "clip"), path
    bad = [found[f"{tmp_path}/clip/{x}"] for x in ("cut_12.png", "none_13.jpg", "head_14.jpg")]
    assert [(r.valid, r.blur) for r in bad] == [(False, None)] * 3 and [r.frame for r in bad] == [12, 13, 14]
    assert bad[1].reason == "unknown format"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path", "content")
    own = {r.path.rpartition("/")[2]: r.blur for r in I.inspected(listed).collect() if r.format == "PNG" and r.valid}
    assert own == {p.rpartition("/")[2]: pytest.approx(b) for p, b in wanted.items() if p.endswith(".png") and "called" not in p}


def test_transforms_run_over_decoded_files(spark, tmp_path):
    jvm = spark._jvm
    write(jvm, f"{tmp_path}/a_1.jpg", INT_RGB)
    (tmp_path / "b_2.jpg").write_bytes(b"?")
    files = I.decoded_files(spark, str(tmp_path)).withColumn("extra", F.lit(5))
    steps = (P.cropped, lambda a: P.resized(a, 9, 31), P.contrasted, P.sharpened)
    found = sorted(P.transformed(files, *steps, tensor=True).collect(), key=lambda r: r.path)
    first = I.as_array(*[files.orderBy("path").first()[c] for c in I.PIXELS])
    for step in steps:
        first = step(first)
    assert (found[0].height, found[0].width, found[0].channels, bytes(found[0].pixels), found[0].extra) == (31, 9, 3, first.tobytes(), 5)
    assert found[0]["values"] == pytest.approx([(first[y, x, c] / 255 - P.MEAN[c]) / P.DEVIATION[c] for c in range(3) for y in range(31) for x in range(9)], abs=1e-5)
    assert found[1].pixels is None and found[1]["values"] is None


IMAGES = [np.random.default_rng(7).integers(0, 256, s).astype(np.uint8) for s in ((17, 23, 3), (1, 1, 1), (2, 9, 4), (5, 3, 2), (33, 8, 1))]


@pytest.mark.parametrize("image", IMAGES, ids=str)
@pytest.mark.parametrize("size", [(7, 5), (40, 33), (1, 1)])
def test_resampling(image, size):
    def axis(values, to):
        n, scale = len(values), len(values) / to
        reach, out = max(scale, 1), []
        for k in range(to):
            w = [max(0, 1 - abs(j + 0.5 - (k + 0.5) * scale) / reach) for j in range(n)]
            out.append(sum(a * b for a, b in zip(w, values)) / sum(w))
        return out

    h, w, n = image.shape
    for c in range(n):
        rows = [axis(image[:, x, c].tolist(), size[1]) for x in range(w)]
        wanted = [axis([rows[x][y] for x in range(w)], size[0]) for y in range(size[1])]
        assert np.abs(P.resized(image, *size)[:, :, c] - np.array(wanted)).max() <= 0.5 + 1e-9
    assert min(P.at_least(image, 40).shape[:2]) >= 40 and P.at_least(image, 1) is image


@pytest.mark.parametrize("image", IMAGES, ids=str)
def test_contrast_and_sharpness(image):
    h, w, n = image.shape
    luma = [float(np.rint(np.dot(image[y, x, :3], [0.299, 0.587, 0.114]))) if n > 2 else float(image[y, x, 0]) for y in range(h) for x in range(w)]
    base = math.floor(sum(luma) / len(luma) + 0.5)
    near = lambda found, wanted: np.abs(found.astype(float) - np.clip(wanted, 0, 255)).max() <= 0.5 + 1e-9
    assert near(P.contrasted(image, 1.3), np.array([[[base + (float(v) - base) * 1.3 for v in p] for p in row] for row in image]))
    smooth = image.astype(float)
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            for c in range(n):
                smooth[y, x, c] = round(sum((5 if (i, j) == (0, 0) else 1) * float(image[y + j, x + i, c]) for j in (-1, 0, 1) for i in (-1, 0, 1)) / 13)
    assert near(P.sharpened(image, 1.7), smooth + (image - smooth) * 1.7)
    assert (P.sharpened(image, 1.0) == image).all() and (P.contrasted(image, 1.0) == image).all()


def test_border_crop():
    image = np.zeros((20, 30, 3), np.uint8)
    image[4:9, 7:21] = 60
    image[2, 3] = 10  # not above the threshold
    assert (P.cropped(image) == image[4:9, 7:21]).all() and P.cropped(np.zeros((3, 4, 1), np.uint8)).shape == (3, 4, 1)
    assert P.cropped(image, 9).shape == (7, 18, 3)


@pytest.mark.parametrize("image", IMAGES, ids=str)
def test_equalisation(image):
    h, w, n = image.shape
    tiles, clip = 3, 2.0
    ys, xs = ([int(v) for v in np.linspace(0, size, min(tiles, size) + 1)] for size in (h, w))
    found = P.equalised(image, tiles, clip)

    def mapped(j, i, c, v):
        part = image[ys[j] : ys[j + 1], xs[i] : xs[i + 1], c].reshape(-1).tolist()
        most = max(1.0, clip * len(part) / 256)
        counts = [part.count(g) for g in range(256)]
        over = sum(max(0, k - most) for k in counts)
        return 255 * sum(min(k, most) + over / 256 for k in counts[: v + 1]) / len(part)

    def between(edges, at):
        centres = [(a + b) / 2 for a, b in zip(edges, edges[1:])]
        if at + 0.5 <= centres[0]:
            return 0, 0, 0.0
        for k in range(len(centres) - 1):
            if at + 0.5 < centres[k + 1]:
                return k, k + 1, (at + 0.5 - centres[k]) / (centres[k + 1] - centres[k])
        return len(centres) - 1, len(centres) - 1, 0.0

    rng = np.random.default_rng(1)
    for y, x, c in {(int(rng.integers(h)), int(rng.integers(w)), int(rng.integers(n))) for _ in range(12)} | {(0, 0, 0), (h - 1, w - 1, n - 1)}:
        (j0, j1, fy), (i0, i1, fx), v = between(ys, y), between(xs, x), int(image[y, x, c])
        wanted = (1 - fy) * ((1 - fx) * mapped(j0, i0, c, v) + fx * mapped(j0, i1, c, v)) + fy * ((1 - fx) * mapped(j1, i0, c, v) + fx * mapped(j1, i1, c, v))
        assert abs(float(found[y, x, c]) - min(255, wanted)) <= 0.5 + 1e-6


def test_a_large_png_takes_seconds():
    import time

    from test_io import png

    image = np.random.default_rng(0).integers(0, 256, (360, 480, 3)).astype(np.uint8)
    data = png(image, [4, 3, 1, 2, 0])
    began = time.perf_counter()
    assert (I.png_pixels(data) == image).all() and time.perf_counter() - began < 3
