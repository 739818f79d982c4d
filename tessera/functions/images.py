"""Image headers, PNG pixels, blur and scene changes (P50-P52, P54, W5, J21, ST4). Pixels are read in Arrow batches; differences of
stored frame features are column expressions."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLUR_THRESHOLD, SCENE_THRESHOLD = 100.0, 30.0
# fixed values: marks of file formats, and PNG colour types
PNG_MARK, JPEG_MARK, GIF_MARKS, BMP_MARK = b"\x89PNG\r\n\x1a\n", b"\xff\xd8", (b"GIF87a", b"GIF89a"), b"BM"
PNG_MODES = {0: ("L", 1), 2: ("RGB", 3), 3: ("P", 1), 4: ("LA", 2), 6: ("RGBA", 4)}


def _png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 12 <= len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data):
            raise ValueError("truncated")
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(name + body):
            raise ValueError("bad checksum")
        yield name, body
        if name == b"IEND":
            return
        at += 12 + n
    raise ValueError("truncated")


def header(data: bytes) -> tuple[str, str, int, int]:
    """(format, mode, width, height); ValueError if it is no image."""
    if data[:8] == PNG_MARK and len(data) >= 29:
        width, height, depth, colour = struct.unpack_from(">IIBB", data, 16)
        return "PNG", "1" if depth == 1 and not colour else PNG_MODES.get(colour, ("?", 0))[0], width, height
    if data[:6] in GIF_MARKS and len(data) >= 10:
        return "GIF", "P", *struct.unpack_from("<HH", data, 6)
    if data[:2] == BMP_MARK and len(data) >= 30:
        width, height = struct.unpack_from("<ii", data, 18)
        return "BMP", {8: "P", 24: "RGB", 32: "RGBA"}.get(struct.unpack_from("<H", data, 28)[0], "?"), width, abs(height)
    if data[:2] == JPEG_MARK:
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            mark, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                height, width, parts = struct.unpack_from(">HHB", data, at + 5)
                return "JPEG", {1: "L", 3: "RGB", 4: "CMYK"}.get(parts, "?"), width, height
            at += 2 + n
        raise ValueError("truncated")
    raise ValueError("unknown format")


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Bytes of PNG scan lines (height, 1 + bytes) without their filters; a pixel has `step` bytes.

    Lines whose filters look only up or left go one by one. Otherwise pixels go by anti-diagonals: what a pixel depends on lies on
    the two before its own, so a diagonal is one step for all lines."""
    height, kinds, size = len(lines), lines[:, 0], lines.shape[1] - 1
    width = -(-size // step)
    cells = np.zeros((height, width * step), np.uint8)
    cells[:, :size] = lines[:, 1:]
    cells = cells.reshape(height, width, step)
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    out = np.zeros((height + 1, width + 1, step), np.uint8)  # a row above and a pixel to the left, of zeros
    if kinds.max(initial=0) < 3:
        for y, kind in enumerate(kinds.tolist()):
            out[y + 1, 1:] = np.cumsum(cells[y], axis=0, dtype=np.uint8) if kind == 1 else cells[y] + out[y, 1:] if kind == 2 else cells[y]
        return out[1:, 1:].reshape(height, -1)[:, :size]
    for t in range(height + width - 1):
        y = np.arange(max(0, t - width + 1), min(height, t + 1))
        x, kind = t - y, kinds[y, None]
        left, up, corner = (v.astype(np.int16) for v in (out[y + 1, x], out[y, x + 1], out[y, x]))
        near = left + up - corner
        d_left, d_up, d_corner = np.abs(near - left), np.abs(near - up), np.abs(near - corner)
        paeth = np.where((d_left <= d_up) & (d_left <= d_corner), left, np.where(d_up <= d_corner, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, paeth], 0)
        out[y + 1, x + 1] = cells[y, x] + guess.astype(np.uint8)
    return out[1:, 1:].reshape(height, -1)[:, :size]


# fixed values: first pixel and distance of pixels, across and down, of the seven passes of interlaced PNGs
PNG_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def png_pixels(data: bytes) -> np.ndarray:
    """(height, width, channels) of a PNG as bytes; ValueError if it isn't sound.

    Of 16-bit samples the upper byte counts, samples of fewer than 8 bits are spread over 0 to 255, palettes become RGB."""
    chunks = list(_png_chunks(data))
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[0][1])
    if colour not in PNG_MODES or depth not in (1, 2, 4, 8, 16):
        raise ValueError("unsupported kind of PNG")
    n = PNG_MODES[colour][1]
    raw = np.frombuffer(zlib.decompress(b"".join(b for name, b in chunks if name == b"IDAT")), np.uint8)
    out, at = np.zeros((height, width, n), np.uint8), 0
    for x0, y0, dx, dy in PNG_PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = len(range(x0, width, dx)), len(range(y0, height, dy))
        if not w or not h:
            continue
        stride = -(-w * n * depth // 8)
        part = raw[at : at + h * (1 + stride)]
        at += len(part)
        if len(part) < h * (1 + stride):
            raise ValueError("truncated")
        rows = _unfiltered(part.reshape(h, 1 + stride), max(1, n * depth // 8))
        if depth == 16:
            rows = rows[:, ::2]
        elif depth < 8:
            bits = np.unpackbits(rows, axis=1)[:, : w * n * depth].reshape(h, w * n, depth)
            rows = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)
            rows = rows if colour == 3 else rows * np.uint8(255 // ((1 << depth) - 1))
        out[y0::dy, x0::dx] = rows.reshape(h, w, n)
    if colour == 3:
        palette = np.frombuffer(next((b for name, b in chunks if name == b"PLTE"), b""), np.uint8).reshape(-1, 3)
        if out.max(initial=0) >= len(palette):
            raise ValueError("palette too short")
        return palette[out[:, :, 0]]
    return out


def gray(pixels: np.ndarray) -> np.ndarray:
    """Luma of RGB, rounded; alpha is left out."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0].astype(np.float64)
    return np.rint(pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114]))


def laplacian_variance(image: np.ndarray) -> float:
    """P50: variance of the four-neighbour Laplacian, edges mirrored."""
    p = np.pad(image, 1, mode="reflect") if min(image.shape) > 1 else np.pad(image, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


INFO = {"format": "string", "mode": "string", "width": "int", "height": "int", "valid": "boolean", "reason": "string", "blur": "double"}


def _inspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for lo in range(0, big.num_rows, 64):
            batch, rows = big.slice(lo, 64), []
            for data in batch.column("content"):
                data, found, reason, blur = data.as_py(), (None,) * 4, None, None
                try:
                    if data is None:
                        raise ValueError("no content")
                    found = header(data)
                    if found[2] <= 0 or found[3] <= 0:
                        raise ValueError("no extent")
                    if found[0] == "PNG":
                        blur = laplacian_variance(gray(png_pixels(data)))
                except (ValueError, struct.error, zlib.error) as e:
                    reason = str(e) or type(e).__name__
                rows.append((*found, reason is None, reason, blur))
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.float64())
            kept = [n for n in batch.schema.names if n != "content"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *(pa.array(x, t) for x, t in zip(zip(*rows), types))], [*kept, *INFO])


def inspected(images: DataFrame) -> DataFrame:
    """Images (content, ..) with format, mode, width, height, valid, reason and blur in place of content.

    What can't be read stays as a row with a reason. blur is the Laplacian variance of PNGs of any kind, null for others, whose
    pixels inspected_files() takes from the JVM."""
    kept = images.drop(*INFO)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "content"]
    return kept.mapInArrow(_inspected, ", ".join([*fields, *[f"{k} {v}" for k, v in INFO.items()]]))


PIXELS = {"height": "int", "width": "int", "channels": "int", "pixels": "binary"}


def _png_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, PIXELS) of the contents of PNGs; without pixels where they aren't sound."""
    for big in batches:
        for lo in range(0, big.num_rows, 16):
            batch, rows = big.slice(lo, 16), []
            for data in batch.column("content"):
                try:
                    found = png_pixels(data.as_py())
                    rows.append((*found.shape, found.tobytes()))
                except (ValueError, struct.error, zlib.error, IndexError):
                    rows.append((None,) * 4)
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(),) * 3 + (pa.binary(),)))], ["path", *PIXELS])


def decoded_files(spark: SparkSession, folder: str, glob: str = "*.{png,jpg,jpeg,gif,bmp}") -> DataFrame:
    """(path, height, width, channels, pixels) of image files; L, LA, RGB or RGBA bytes by row. What can't be decoded stays
    without pixels.

    The JVM's image source decodes JPEG, GIF and BMP files, also those called .png. PNGs are decoded from their bytes, because the source keeps
    the lower byte of 16-bit greys."""
    scan = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    plain = F.regexp_replace("path", "^file:/+", "file:///")
    held = scan.format("binaryFile").load(folder)
    is_png = F.col("content").startswith(F.lit(PNG_MARK))
    own = held.where(is_png).select(plain.alias("path"), "content").mapInArrow(_png_rows, ", ".join(["path string", *(f"{k} {v}" for k, v in PIXELS.items())]))
    others = held.where(~is_png).select(plain.alias("path"))
    found = scan.format("image").option("dropInvalid", False).load(folder).select(F.regexp_replace("image.origin", "^file:/+", "file:///").alias("path"), "image.*").where("height > 0")
    found = found.select("path", "height", "width", F.col("nChannels").alias("channels"), F.col("data").alias("pixels")).mapInArrow(_turned, ", ".join(["path string", *(f"{k} {v}" for k, v in PIXELS.items())]))
    return own.unionByName(others.join(found, "path", "left"))


def _turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pixels with blue first, as the JVM gives them, with red first."""
    for batch in batches:
        out = []
        for raw, n in zip(batch.column("pixels"), batch.column("channels").to_pylist()):
            a = np.frombuffer(raw.as_py(), np.uint8).reshape(-1, n)
            out.append((a[:, [2, 1, 0, 3][:n]] if n > 2 else a).tobytes())
        yield batch.set_column(batch.schema.get_field_index("pixels"), "pixels", pa.array(out, pa.binary()))


def as_array(height: int, width: int, channels: int, pixels: bytes) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width, channels)


def _blurred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for lo in range(0, big.num_rows, 16):
            batch = big.slice(lo, 16)
            shapes = zip(*(batch.column(c).to_pylist() for c in PIXELS))
            blur = [None if p is None else laplacian_variance(gray(as_array(h, w, c, p))) for h, w, c, p in shapes]
            kept = batch.drop_columns("pixels")
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(blur, pa.float64())], [*kept.schema.names, "blur"])


def blurred(pixels: DataFrame) -> DataFrame:
    """P50: rows of PIXELS with the Laplacian variance `blur` in place of the pixels, null without pixels."""
    kept = pixels.drop("blur")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "pixels"]
    return kept.mapInArrow(_blurred, ", ".join([*fields, "blur double"]))


def inspected_files(spark: SparkSession, folder: str, glob: str = "*.{png,jpg,jpeg,gif,bmp}") -> DataFrame:
    """(path, video, frame, *INFO) of the image files under a folder, JPEGs with blur too.

    What has a header but no pixels is not valid."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    plain = F.regexp_replace("path", "^file:/+", "file:///")
    heads = scan.select(plain.alias("path"), "content").mapInArrow(_headed, "path string, format string, mode string, width int, height int, reason string")
    found = blurred(decoded_files(spark, folder, glob)).select("path", "blur")
    rows = heads.join(found, "path").withColumn("reason", F.coalesce("reason", F.when(F.col("blur").isNull(), F.lit("no pixels"))))
    parts = F.split("path", "/")
    return rows.select("path", F.element_at(parts, -2).alias("video"), F.regexp_extract("path", r"(\d+)\.[^.]*$", 1).try_cast("int").alias("frame"), "format", "mode", "width", "height", F.col("reason").isNull().alias("valid"), "reason", "blur")


def _headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data in batch.column("content"):
            try:
                rows.append((*header(data.as_py()), None))
            except (ValueError, struct.error) as e:
                rows.append((None,) * 4 + (str(e),))
        types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array(x, t) for x, t in zip(zip(*rows), types))], ["path", "format", "mode", "width", "height", "reason"])


def is_blurry(blur: Column, threshold: float = BLUR_THRESHOLD) -> Column:
    """P50: strictly under the threshold."""
    return blur < threshold


def encoded(content: Column) -> Column:
    """base64."""
    return F.base64(content)


def scene_changes(frames: DataFrame, by: str, ord_: str, pixels: str, threshold: float = SCENE_THRESHOLD) -> DataFrame:
    """W5, ST4: frames with difference, the mean absolute difference to the frame before (null for the first), and change, true for
    the first frame and where the difference is above the threshold."""
    before = F.lag(pixels).over(Window.partitionBy(by).orderBy(ord_))
    total = F.aggregate(F.zip_with(pixels, "_before", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    rows = frames.withColumn("_before", before).withColumn("difference", total / F.size(pixels))
    return rows.withColumn("change", F.col("_before").isNull() | (F.col("difference") > threshold)).drop("_before")


def followed(x: Column, y: Column, keypoints: Column, reach: float = 30.0) -> Column:
    """Where a point moves to: the match (mx, my) of the nearest keypoint (x, y, match, mx, my) that has one, within reach; else null."""
    d = lambda k: F.sqrt((k.x - x) ** 2 + (k.y - y) ** 2)
    near = F.transform(F.filter(keypoints, lambda k: k.match > -1), lambda k, i: F.struct(d(k).alias("d"), i.alias("i"), k.mx.alias("x"), k.my.alias("y")))
    best = F.array_min(near)
    return F.when(best.d < reach, F.struct(best.x.alias("x"), best.y.alias("y")))
