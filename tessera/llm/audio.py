"""Media columns: WAV samples and audio features as fixed-shape tensors with time spans.

A text's UTF-8 bytes, filled with zeros to a positive multiple of 64, are the samples of an 8-bit mono WAV file.
A chunk "blen" before the samples holds the number of bytes without the filling. Features are computed
from the stored file:

* polyphase resampling by UP / DOWN with a windowed-sinc filter of TAPS taps a phase,
* log-mel energies of frames of FRAME samples, HOP apart, in tensors of PATCH frames x MELS bands,
* hysteresis segmentation of the frame energies: a span opens above mean + RISE deviations and closes below
  mean - FALL deviations.

Features are stored as well: a table of Arrow streams, each a column of fixed-shape tensors with the time span of each
patch and the energy spans, and read back.

All steps run over blocks of a few patches, so memory doesn't grow with the length of a text beyond the
text itself and one energy a frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, text_bytes, work_path

RATE, PAD = 8000, 64
UP, DOWN, TAPS = 5, 8, 12
FRAME, HOP, MELS, PATCH = 256, 128, 16, 32
BLOCK = 64  # patches at a time
RISE, FALL = 0.5, 0.25


def to_wav(data: bytes) -> bytes:
    """An 8-bit mono WAV file of data and its filling."""
    samples = data + bytes(PAD - len(data) if not data else -len(data) % PAD)
    chunks = b"".join([b"fmt ", struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8), b"blen", struct.pack("<IQ", 8, len(data)), b"data", struct.pack("<I", len(samples)), samples])
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def from_wav(media: bytes) -> tuple[int, bytes]:
    """(bytes without the filling, samples) of a file by to_wav()."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, length = 12, None
    while at < len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"blen":
            length = struct.unpack_from("<Q", media, at + 8)[0]
        if name == b"data":
            samples = media[at + 8 : at + 8 + n]
            return len(samples) if length is None else length, samples
        at += 8 + n + n % 2
    raise ValueError("no samples")


def _filter() -> np.ndarray:
    """Weights (DOWN + TAPS - 1 inputs, UP outputs) of one step of the polyphase filter."""
    half = TAPS * UP // 2
    t = np.arange(-half, half)
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(len(t)) * UP / max(UP, DOWN)
    out = np.zeros((DOWN + TAPS - 1, UP))
    for p in range(UP):
        phase, first = p * DOWN % UP, p * DOWN // UP
        for k in range(TAPS):
            out[first + TAPS - 1 - k, p] = h[k * UP + phase]
    return out.astype(np.float32)


def _mel_bands() -> np.ndarray:
    """Triangular bands (FRAME // 2 + 1, MELS) on the mel scale of the resampled rate."""
    top = RATE * UP / DOWN / 2
    mel = np.linspace(0, 2595 * np.log10(1 + top / 700), MELS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1) / top * (FRAME // 2)
    k = np.arange(FRAME // 2 + 1)[:, None]
    rise, fall = (k - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - k) / np.diff(edges)[1:]
    return np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


_FIR, _BANDS, _HANN = _filter(), _mel_bands(), np.hanning(FRAME).astype(np.float32)


def resampled(samples: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Samples lo to hi of the resampled signal; lo is a multiple of UP. Silence surrounds the input."""
    steps, before = -(-(hi - lo) // UP), TAPS // 2
    begin = lo // UP * DOWN - (TAPS - 1) + before
    end = begin + steps * DOWN + TAPS - 1
    part = np.zeros(end - begin, np.float32)
    a, b = max(begin, 0), min(end, len(samples))
    if b > a:
        part[a - begin : b - begin] = (samples[a:b].astype(np.float32) - 128) / 128
    windows = np.lib.stride_tricks.sliding_window_view(part, DOWN + TAPS - 1)[::DOWN]
    return (np.ascontiguousarray(windows) @ _FIR).reshape(-1)[: hi - lo]


def features(samples: np.ndarray) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """(tensors (n, PATCH, MELS) float16, spans (start, end) in seconds). Frames after the end are silent."""
    rate = RATE * UP / DOWN
    total = max(1, -(-(len(samples) * UP // DOWN) // HOP))
    patches = -(-total // PATCH)
    tensors, energy = np.zeros((patches, PATCH, MELS), np.float16), np.zeros(patches * PATCH, np.float32)
    for lo in range(0, patches, BLOCK):
        n = min(BLOCK, patches - lo) * PATCH
        # a multiple of UP at or before the first sample
        first = lo * PATCH * HOP // UP * UP
        wave = resampled(samples, first, lo * PATCH * HOP + (n - 1) * HOP + FRAME)[lo * PATCH * HOP - first :]
        frames = np.lib.stride_tricks.sliding_window_view(wave, FRAME)[::HOP][:n] * _HANN
        spectrum = np.fft.rfft(frames, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        tensors[lo : lo + n // PATCH] = np.log(power @ _BANDS + 1e-6).reshape(-1, PATCH, MELS)
        energy[lo * PATCH : lo * PATCH + n] = np.log(power.sum(axis=1) + 1e-6)
    return tensors, spans(energy[:total], HOP / rate)


def spans(energy: np.ndarray, seconds: float) -> list[tuple[float, float]]:
    """Runs of frames that open above the upper and close below the lower threshold."""
    mean, dev = float(energy.mean()), float(energy.std())
    mark = np.where(energy > mean + RISE * dev, 1, np.where(energy < mean - FALL * dev, 0, -1))
    at = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.concatenate([[0], np.where(at >= 0, mark[at], 0), [0]])
    edge = np.flatnonzero(np.diff(on))
    return [(a * seconds, b * seconds) for a, b in edge.reshape(-1, 2).tolist()]


def tensor_ipc(tensors: np.ndarray, found: list[tuple[float, float]]) -> bytes:
    """An Arrow stream: fixed-shape tensors with the time span of each patch, and the energy spans as metadata."""
    kind = pa.fixed_shape_tensor(pa.float16(), tensors.shape[1:])
    storage = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1)), PATCH * MELS)
    seconds = PATCH * HOP * DOWN / UP / RATE
    start = np.arange(len(tensors)) * seconds
    schema = pa.schema([("mel", kind), ("start", pa.float64()), ("end", pa.float64())], {"spans": ";".join(f"{a:.6f}-{b:.6f}" for a, b in found)})
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(kind, storage), pa.array(start), pa.array(start + seconds)], schema=schema)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_tensor_ipc(data: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[float, float]]]:
    """(tensors, (start, end) of each patch, energy spans) of a stream by tensor_ipc()."""
    read = pa.ipc.open_stream(data).read_all()
    kind = read.schema.field("mel").type
    tensors = np.concatenate([c.storage.flatten().to_numpy() for c in read["mel"].chunks]).reshape(-1, *kind.shape)
    times = np.stack([read["start"].to_numpy(), read["end"].to_numpy()], axis=1)
    marked = read.schema.metadata[b"spans"].decode()
    return tensors, times, [tuple(map(float, x.split("-"))) for x in marked.split(";")] if marked else []


def digest(tensors: np.ndarray, found: list[tuple[float, float]]) -> str:
    """Number of patches and spans, and a SHA-256 of the tensors' values and the spans."""
    raw = np.ascontiguousarray(tensors, "<f2").tobytes() + ";".join(f"{a:.6f}-{b:.6f}" for a, b in found).encode()
    return f"{len(tensors)}:{len(found)}:{hashlib.sha256(raw).hexdigest()}"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for lo in range(0, big.num_rows, 256):
            batch, found = big.slice(lo, 256), []
            for x in batch.column("tensors"):
                tensors, _, spans_ = from_tensor_ipc(x.as_py())
                found.append(digest(tensors, spans_))
            names = [n for n in batch.schema.names if n != "tensors"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.string())], [*names, "feature"])


def store_features(media: DataFrame) -> DataFrame:
    """Writes media_features() to the shared folder and returns the table as read back."""
    found = media_features(media)
    path = work_path(media.sparkSession, "features")
    found.write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.schema(found.schema).parquet(path)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for lo in range(0, big.num_rows, 512):
            batch = big.slice(lo, 512)
            media = [to_wav(x) for x in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])


def store_media(docs: DataFrame) -> DataFrame:
    """Writes (doc_id, media) to the shared folder and returns the table as read back."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data")).mapInArrow(_store, "doc_id long, media binary")
    path = work_path(docs.sparkSession, "media")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors binary, spans array<struct<start:double,end:double>>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), span]
    for big in batches:
        for lo in range(0, big.num_rows, 256):
            batch, rows = big.slice(lo, 256), []
            for media in batch.column("media").to_pylist():
                n, samples = from_wav(media)
                tensors, found = features(np.frombuffer(samples, np.uint8))
                rows.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), tensor_ipc(tensors, found), [{"start": a, "end": b} for a, b in found]))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [f.split()[0] for f in FEATURES.split(", ")])


def media_features(media: DataFrame) -> DataFrame:
    """Features of stored media; see FEATURES. tensors holds an Arrow stream by tensor_ipc()."""
    return media.mapInArrow(_features, FEATURES)


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores all documents as audio and computes features from what is read back.

    Rows with null doc_id keep it; a null text is 64 samples of value 0. Equal texts have equal values, and repeated rows
    come back repeated. Other columns are ignored; an empty table gives an empty one.
    """
    stored = store_features(store_media(documents(spark, sf_dir).select("doc_id", "text")))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    return stored.drop("spans").mapInArrow(_digests, f"{schema}, feature string")
