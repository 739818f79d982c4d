"""Image transforms on pixels (P52): border crop, resampling, contrast, sharpness, histogram equalisation, normalisation. Each works on
(height, width, channels) bytes; transformed() runs them over Arrow batches of decoded images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.functions.images import PIXELS, as_array, gray

# fixed values: channel means and deviations of the usual normalisation, and the smoothing kernel of sharpening
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
SMOOTH = np.array([[1, 1, 1], [1, 5, 1], [1, 1, 1]]) / 13


def rgb(image: np.ndarray) -> np.ndarray:
    """Three channels: greys three times, alpha left out."""
    return np.repeat(image[:, :, :1], 3, axis=2) if image.shape[2] < 3 else image[:, :, :3]


def cropped(image: np.ndarray, threshold: int = 10) -> np.ndarray:
    """Without the borders in which no pixel is brighter than the threshold; an image without such pixels stays."""
    bright = gray(image) > threshold
    y, x = np.flatnonzero(bright.any(axis=1)), np.flatnonzero(bright.any(axis=0))
    return image[y[0] : y[-1] + 1, x[0] : x[-1] + 1] if len(y) else image


def _weights(n: int, to: int) -> np.ndarray:
    """(to, n) weights of triangles as wide as a pixel of the smaller of the two grids."""
    scale = n / to
    reach = max(scale, 1.0)
    centres = (np.arange(to) + 0.5) * scale
    w = np.maximum(0, 1 - np.abs(np.arange(n) + 0.5 - centres[:, None]) / reach)
    return w / w.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resampled along each axis with triangles that cover the area of a target pixel."""
    out = np.tensordot(_weights(image.shape[0], height), image.astype(np.float64), (1, 0))
    out = np.tensordot(_weights(image.shape[1], width), out, (1, 1)).transpose(1, 0, 2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def at_least(image: np.ndarray, least: int = 512) -> np.ndarray:
    """Enlarged, sides in proportion, so that the shorter side has `least` pixels; larger images stay."""
    height, width = image.shape[:2]
    if min(height, width) >= least:
        return image
    scale = least / min(height, width)
    return resized(image, max(least, int(width * scale)), max(least, int(height * scale)))


def _blend(image: np.ndarray, base: np.ndarray | float, factor: float) -> np.ndarray:
    return np.clip(np.rint(base + (image.astype(np.float64) - base) * factor), 0, 255).astype(np.uint8)


def contrasted(image: np.ndarray, factor: float = 1.2) -> np.ndarray:
    """Away from (above 1) or towards the mean grey."""
    return _blend(image, float(np.floor(gray(image).mean() + 0.5)), factor)


def sharpened(image: np.ndarray, factor: float = 1.1) -> np.ndarray:
    """Away from (above 1) or towards a smoothed image; the outermost pixels are not smoothed."""
    smooth = image.astype(np.float64)
    if min(image.shape[:2]) > 2:
        h, w = image.shape[:2]
        smooth = smooth.copy()
        smooth[1:-1, 1:-1] = np.rint(sum(SMOOTH[j, i] * image[j : h - 2 + j, i : w - 2 + i] for j in range(3) for i in range(3)))
    return _blend(image, smooth, factor)


def equalised(image: np.ndarray, tiles: int = 8, clip: float = 4.0) -> np.ndarray:
    """Each channel equalised by histograms of tiles x tiles parts, cut at `clip` times their mean count and mixed
    linearly between the parts' centres."""
    height, width, n = image.shape
    ys, xs = (np.linspace(0, size, min(tiles, size) + 1).astype(int) for size in (height, width))
    out = np.empty_like(image)
    y, x = (np.interp(np.arange(size) + 0.5, (e[:-1] + e[1:]) / 2, np.arange(len(e) - 1)) for size, e in ((height, ys), (width, xs)))
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, len(ys) - 2), np.minimum(x0 + 1, len(xs) - 2)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    for c in range(n):
        plane = image[:, :, c]
        maps = np.empty((len(ys) - 1, len(xs) - 1, 256))
        for j in range(len(ys) - 1):
            for i in range(len(xs) - 1):
                part = plane[ys[j] : ys[j + 1], xs[i] : xs[i + 1]]
                counts = np.bincount(part.reshape(-1), minlength=256).astype(np.float64)
                most = max(1.0, clip * part.size / 256)
                over = np.maximum(counts - most, 0).sum()
                maps[j, i] = 255 * np.cumsum(np.minimum(counts, most) + over / 256) / part.size
        at = lambda j, i: maps[j[:, None], i[None, :], plane]  # noqa: B023, E731
        mixed = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x1)) + fy * ((1 - fx) * at(y1, x0) + fx * at(y1, x1))
        out[:, :, c] = np.clip(np.rint(mixed), 0, 255)
    return out


def normalised(image: np.ndarray) -> np.ndarray:
    """(3, height, width) floats: bytes as shares of 255, less MEAN, by DEVIATION."""
    shares = rgb(image).astype(np.float32) / 255
    return ((shares - np.array(MEAN, np.float32)) / np.array(DEVIATION, np.float32)).transpose(2, 0, 1)


def transformed(images: DataFrame, *steps: Callable[[np.ndarray], np.ndarray], tensor: bool = False) -> DataFrame:
    """Rows of PIXELS with the steps applied in turn; rows without pixels stay so. With `tensor` a column `values` has normalised()."""
    kept = images.drop("values") if tensor else images
    others = [c for c in kept.columns if c not in PIXELS]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in others]
    schema = ", ".join([*fields, *(f"{k} {v}" for k, v in PIXELS.items()), *(["`values` array<float>"] if tensor else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 16):
                batch, rows = big.slice(lo, 16), []
                for height, width, channels, raw in zip(*(batch.column(c).to_pylist() for c in PIXELS)):
                    if raw is None:
                        rows.append((None,) * (4 + tensor))
                        continue
                    image = as_array(height, width, channels, raw)
                    for step in steps:
                        image = step(image)
                    rows.append((*image.shape, np.ascontiguousarray(image).tobytes(), *([normalised(image).reshape(-1)] if tensor else [])))
                types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.float32()))
                names = [*PIXELS, *(["values"] if tensor else [])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *(pa.array(x, t) for x, t in zip(zip(*rows), types))], [*others, *names])

    return kept.mapInArrow(run, schema)
