"""Large binary files read by ranges of bytes: vectors in .npy files (S17), members of zip archives (S28), frames of AVI videos.

Each is a Python data source. Planning lists files and sizes only; a file is cut into ranges of `rangeBytes`, a partition each. A task reads
the file's own directory (npy header, zip central directory, AVI index), which is small, and owns what begins inside its
range, so nothing is read twice and no task holds a file. Files are opened through pyarrow's file systems.
"""

from __future__ import annotations

import io
import os
import re
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.images import header

RANGE_BYTES, BATCH_BYTES = 32 << 20, 4 << 20


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if re.match("[A-Za-z][A-Za-z0-9+.-]*://", path) else f"file://{os.path.abspath(path)}")


def listed(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files below a folder that end so, in order of their paths."""
    files, root = _store(path)
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    info = files.get_file_info(root)
    found = [info] if info.type == pyarrow.fs.FileType.File else files.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if info.type == pyarrow.fs.FileType.Directory else []
    return sorted((prefix + x.path, x.size) for x in found if x.type == pyarrow.fs.FileType.File and x.path.lower().endswith(suffixes))


class Range(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int) -> None:
        self.path, self.size, self.start, self.end = path, size, start, end


class RangedReader(DataSourceReader):
    """Deals files to ranges; rows() gives the batches of what begins inside one."""

    suffixes: tuple[str, ...] = ()

    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def option(self, name: str, default: str | None = None) -> str | None:
        return next((v for k, v in self.options.items() if k.lower() == name.lower()), default)

    def partitions(self) -> list[Range]:
        step = int(self.option("rangeBytes", str(RANGE_BYTES)))
        suffixes = tuple(x.lower() for x in self.option("suffixes", ",".join(self.suffixes)).split(","))
        return [Range(path, size, at, min(at + step, size)) for path, size in listed(self.option("path"), suffixes) for at in range(0, max(size, 1), step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, name = _store(partition.path)
        with files.open_input_file(name) as f:
            yield from self.rows(f, partition)

    def rows(self, f: pa.NativeFile, part: Range) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class NpyReader(RangedReader):
    suffixes = (".npy",)

    def rows(self, f: pa.NativeFile, part: Range) -> Iterator[pa.RecordBatch]:
        head = io.BytesIO(f.read_at(min(part.size, 1 << 16), 0))
        version = np.lib.format.read_magic(head)
        shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
        if kind.hasobject or len(shape) > 2:
            raise ValueError(f"{part.path}: not an array of vectors")
        n, width = shape if len(shape) == 2 else (1, shape[0] if shape else 1)
        begin, size = head.tell(), max(1, width * kind.itemsize)
        # a row begins in a range by its number, also where the file holds columns
        lo, hi = (min(n, max(0, -(-(at - begin) // size))) for at in (part.start, part.end))
        hi = n if part.end >= part.size else hi
        step = max(1, BATCH_BYTES // size)
        for at in range(lo, hi, step):
            m = min(step, hi - at)
            if by_column and width > 1 and n > 1:
                rows = np.stack([np.frombuffer(f.read_at(m * kind.itemsize, begin + (c * n + at) * kind.itemsize), kind) for c in range(width)], axis=1)
            else:
                rows = np.frombuffer(f.read_at(m * width * kind.itemsize, begin + at * width * kind.itemsize), kind).reshape(m, width)
            flat = pa.array(np.ascontiguousarray(rows, np.float32).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * width), flat)
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * m), pa.array(np.arange(at, at + m)), lists], ["file", "ord", "embedding"])


class _Seekable(io.RawIOBase):
    """A file as Python's own libraries take it."""

    def __init__(self, f: pa.NativeFile, size: int) -> None:
        self.f, self.size, self.at = f, size, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.at, self.size)[whence]
        if at < 0:
            raise OSError("before the file's start")
        self.at = at
        return at

    def readinto(self, buffer: memoryview) -> int:
        data = self.f.read_at(max(0, min(len(buffer), self.size - self.at)), self.at)
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


class ZipReader(RangedReader):
    suffixes = (".zip",)

    def rows(self, f: pa.NativeFile, part: Range) -> Iterator[pa.RecordBatch]:
        wanted = tuple(x.lower() for x in self.option("entries", "").split(",") if x)
        try:
            with zipfile.ZipFile(io.BufferedReader(_Seekable(f, part.size), 1 << 16)) as z:
                for entry in sorted(z.infolist(), key=lambda e: e.filename):
                    if part.start <= entry.header_offset < part.end and not entry.is_dir() and (not wanted or entry.filename.lower().endswith(wanted)):
                        yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([entry.filename]), pa.array([z.read(entry)], pa.binary())], ["archive", "name", "content"])
        except zipfile.BadZipFile:
            return


# AVI: RIFF lists of chunks; frames are chunks "NNdc" or "NNdb" of the list "movi", with an index "idx1"
DEFAULT_FPS = 30.0
FRAME_FIELDS = {"path": pa.string(), "video": pa.string(), "frame": pa.int32(), "time": pa.float64(), "video_fps": pa.float64(), "video_frames": pa.int32(), "width": pa.int32(), "height": pa.int32(), "content": pa.binary(), "reason": pa.string()}
FRAME_SCHEMA = "path string, video string, frame int, time double, video_fps double, video_frames int, width int, height int, content binary, reason string"


class Avi:
    """Rate, picture format and places of frames of an AVI file."""

    def __init__(self, f: pa.NativeFile, size: int) -> None:
        self.f, self.size, self.fps, self.format, self.places = f, size, 0.0, None, []
        self.stream, self._seen, index, movi = None, 0, None, None
        if self._bytes(0, 4) != b"RIFF" or self._bytes(8, 4) != b"AVI ":
            raise ValueError("not an AVI file")
        lists = []  # of frames, each segment's
        for kind, at, n, name in self._chunks(0, size):
            if kind == b"RIFF" and name in (b"AVI ", b"AVIX"):
                for kind, at, n, name in self._chunks(at + 4, at + n):  # noqa: B020, PLW2901
                    if kind == b"LIST" and name == b"hdrl":
                        self._headers(at + 4, at + n)
                    elif kind == b"LIST" and name == b"movi":
                        lists.append((at + 4, min(at + n, size)))
                        movi = at if movi is None else movi
                    elif kind == b"idx1" and index is None:
                        index = (at, min(n, size - at))
        if self.stream is None:
            raise ValueError("no video stream")
        ids = tuple(b"%02d" % self.stream + x for x in (b"dc", b"db"))
        if index is not None:
            table = np.frombuffer(self._bytes(*index)[: index[1] // 16 * 16], np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("n", "<u4")]))
            own = table[np.isin(table["id"], ids)]
            base = movi if len(own) and int(own["at"][0]) < movi else 0  # places count from the list or from the file's start
            self.places = [(base + int(a) + 8, int(n)) for a, n in zip(own["at"], own["n"])]
            lists = lists[1:]
        for a, b in lists:
            self._walk(a, b, ids)

    def _bytes(self, at: int, n: int) -> bytes:
        return self.f.read_at(max(0, min(n, self.size - at)), at)

    def _chunks(self, at: int, end: int) -> Iterator[tuple[bytes, int, int, bytes]]:
        """(id, place of the body, length, first four bytes) of chunks."""
        while at + 8 <= min(end, self.size):
            kind, n, name = struct.unpack("<4sI4s", self._bytes(at, 12).ljust(12, b"\0"))
            yield kind, at + 8, n, name
            at += 8 + n + n % 2

    def _headers(self, at: int, end: int) -> None:
        for kind, a, n, name in self._chunks(at, end):
            if kind != b"LIST" or name != b"strl":
                continue
            number, self._seen = self._seen, self._seen + 1
            parts = {k: self._bytes(b, m) for k, b, m, _ in self._chunks(a + 4, a + n)}
            head = parts.get(b"strh", b"")
            if self.stream is None and head[:4] == b"vids" and len(head) >= 36:
                scale, rate = struct.unpack_from("<II", head, 20)
                self.stream, self.fps, self.format = number, rate / scale if scale else 0.0, parts.get(b"strf", b"")

    def _walk(self, at: int, end: int, ids: tuple[bytes, ...]) -> None:
        for kind, a, n, name in self._chunks(at, end):
            if kind == b"LIST" and name == b"rec ":
                self._walk(a + 4, a + n, ids)
            elif kind in ids:
                self.places.append((a, n))

    def picture(self, at: int, n: int) -> bytes:
        """The bytes of an image file of a frame: the chunk itself, or raw pixels behind a BMP's headers."""
        data = self._bytes(at, n)
        if len(data) < n:
            raise ValueError("truncated")
        if len(self.format) >= 40 and struct.unpack_from("<I", self.format, 16)[0] == 0 and data[:2] != b"\xff\xd8":
            return struct.pack("<2sIII", b"BM", 14 + len(self.format) + n, 0, 14 + len(self.format)) + self.format + data
        return data


class AviReader(RangedReader):
    suffixes = (".avi",)

    def rows(self, f: pa.NativeFile, part: Range) -> Iterator[pa.RecordBatch]:
        video = os.path.splitext(os.path.basename(part.path))[0]
        every, least = float(self.option("fps", "1.0")), int(self.option("minSize", "64"))
        first, last = self.option("startTime"), self.option("endTime")

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), FRAME_FIELDS.values())], [*FRAME_FIELDS])

        try:
            movie = Avi(f, part.size)
            if not movie.places:
                raise ValueError("no frames")
        except (ValueError, struct.error) as e:
            if not part.start:
                yield batch([(part.path, video, *(None,) * 7, str(e))])
            return
        fps, total = movie.fps if movie.fps > 0 else DEFAULT_FPS, len(movie.places)
        stride = max(1, int(fps / every))
        begin = int(float(first) * fps) if first is not None else 0
        end = min(int(float(last) * fps), total) if last is not None else total
        rows, held = [], 0
        for k in range(begin, end, stride):
            at, n = movie.places[k]
            # a frame whose place lies behind the file's end belongs to the last range
            if not part.start <= min(at, part.size - 1) < part.end:
                continue
            width = height = content = reason = None
            try:
                content = movie.picture(at, n)
                _, _, width, height = header(content)
                if min(width, height) < least:
                    content, reason = None, f"too small: {width}x{height}"
            except (ValueError, struct.error) as e:
                content, reason = None, str(e)
            rows.append((part.path, video, k, k / fps, fps, total, width, height, content, reason))
            held += len(content or b"")
            if held >= BATCH_BYTES:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)


def _source(kind: str, fields: str, reader: type[RangedReader]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return fields

        def reader(self, schema) -> RangedReader:  # noqa: ANN001
            return reader(self.options)

    return Source


SOURCES = {
    "npy_rows": ("file string, ord long, embedding array<float>", NpyReader),
    "zip_members": ("archive string, name string, content binary", ZipReader),
    "avi_frames": (FRAME_SCHEMA, AviReader),
}


def scan(spark: SparkSession, kind: str, path: str, **options: object) -> DataFrame:
    """One of SOURCES over a file or the files below a folder; options with value None are left out."""
    spark.dataSource.register(_source(kind, *SOURCES[kind]))
    given = {k: str(v) for k, v in options.items() if v is not None}
    return spark.read.format(kind).options(**given).load(path)


def video_frames(spark: SparkSession, path: str, fps: float = 1.0, start: float | None = None, end: float | None = None, min_size: int = 64, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """FRAME_SCHEMA of every max(1, int(video fps / fps))-th frame between two times, in seconds; a video of no rate counts as 30 a second.

    A file that can't be read is one row with a reason and no frame; a broken or small frame is a row with a reason and no content."""
    if fps <= 0:
        raise ValueError("fps must be positive")
    return scan(spark, "avi_frames", path, fps=fps, startTime=start, endTime=end, minSize=min_size, rangeBytes=range_bytes)


def save_frames(frames: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """Writes the contents of rows to <folder>/<name>; returns the other columns with `path`. A file appears when it is whole, so a
    task that runs again only replaces it."""
    others = [c for c in frames.columns if c not in ("content", "path")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name in others]

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _store(folder)
        for batch in batches:
            paths = []
            for file, content in zip(batch.column(name).to_pylist(), batch.column("content")):
                at = f"{root}/{file}"
                files.create_dir(os.path.dirname(at), recursive=True)
                part = f"{at}.{os.getpid()}-{len(paths)}.part"
                with files.open_output_stream(part, compression=None) as out:
                    out.write(content.as_py())
                files.move(part, at)
                paths.append(f"{folder}/{file}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(paths, pa.string())], [*others, "path"])

    return frames.mapInArrow(save, ", ".join([*fields, "path string"]))


def extracted(spark: SparkSession, videos: str, folder: str, fps: float = 1.0, threshold: float = 100.0, filter_blur: bool = True, **how: object) -> tuple[DataFrame, DataFrame]:
    """(frames, videos). Sampled frames are written below the folder, <video>/<frame>.jpg (or .bmp), and their blur is
    read from there; `saved` ones are not blurry, or all without filter_blur, and have a `name` that counts them by video.
    videos has a row for each video: sampled, blurry, saved, errors, blur_rate, and a reason where it can't be read."""
    from pyspark.sql import Window

    from tessera.functions.images import inspected_files

    rows = video_frames(spark, videos, fps, **how)
    kind = F.when(F.col("content").startswith(F.lit(b"BM")), ".bmp").otherwise(".jpg")
    good = rows.where("content is not null").withColumn("name", F.concat("video", F.lit("/"), F.format_string("%08d", "frame"), kind))
    save_frames(good, folder).write.mode("overwrite").parquet(f"{folder}/_sampled")
    kept = spark.read.parquet(f"{folder}/_sampled").drop("reason", "path", "name")
    found = inspected_files(spark, folder, "*.{jpg,bmp}").select("video", "frame", F.col("path").alias("file"), "blur", "reason")
    frames = kept.join(found, ["video", "frame"])
    saved = F.col("reason").isNull() & ((F.col("blur") >= threshold) if filter_blur else F.lit(True))
    frames = frames.withColumn("blurry", F.col("reason").isNull() & (F.col("blur") < threshold) & F.lit(filter_blur)).withColumn("saved", saved)
    n = F.row_number().over(Window.partitionBy("video", "saved").orderBy("frame"))
    frames = frames.withColumn("name", F.when(F.col("saved"), F.concat("video", F.format_string("_frame_%06d.png", n - 1))))
    bad = rows.drop("content").where("reason is not null")
    every = frames.select("video", "video_fps", "video_frames", F.lit(1).alias("sampled"), F.col("blurry").cast("int").alias("blurry"), F.col("saved").cast("int").alias("saved"), F.col("reason").isNotNull().cast("int").alias("errors"), F.lit(None).cast("string").alias("reason"))
    every = every.union(bad.select("video", "video_fps", "video_frames", F.col("frame").isNotNull().cast("int"), F.lit(0), F.lit(0), F.lit(1), F.when(F.col("frame").isNull(), F.col("reason"))))
    sums = every.groupBy("video").agg(F.max("video_fps").alias("video_fps"), F.max("video_frames").alias("video_frames"), *[F.sum(c).alias(c) for c in ("sampled", "blurry", "saved", "errors")], F.max("reason").alias("reason"))
    return frames, sums.withColumn("blur_rate", F.coalesce(F.round(F.try_divide(F.col("blurry") * 100.0, F.col("sampled")), 2), F.lit(0.0)))


def write_npy(df: DataFrame, path: str, rows_path: str, by: str, vector: str = "embedding") -> None:
    """K4: df in order of `by` as Parquet at rows_path, and its vectors in that order as one .npy file of 32-bit floats.

    Each task writes its rows at their own places in the file, so the folder must be one that all tasks share and can
    write inside files (not an object store). A vector that lacks, or is not as long as the others, fails the write."""
    spark = df.sparkSession
    df.repartitionByRange(F.col(by)).sortWithinPartitions(by).write.mode("overwrite").parquet(rows_path)
    rows = spark.read.parquet(rows_path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(vector).cast("array<float>").alias("vector"))
    files = sorted((r.file, r.n, r.low, r.high) for r in rows.groupBy("file").agg(F.count("*").alias("n"), F.min(F.coalesce(F.size("vector"), F.lit(-1))).alias("low"), F.max(F.size("vector")).alias("high")).collect())
    widths = {w for _, _, *both in files for w in both}
    if len(widths) > 1 or widths & {-1}:
        raise ValueError("vectors must be there and of one length")
    width, total = (widths or {0}).pop(), sum(n for _, n, _, _ in files)
    starts, at = {}, 0
    for name, n, _, _ in files:
        starts[name], at = at, at + n
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": "<f4", "fortran_order": False, "shape": (total, width)})
    files_, target = _store(path)
    if not isinstance(files_, pyarrow.fs.LocalFileSystem):
        raise ValueError("a single .npy file needs a folder whose files can be written inside")
    begin = head.tell()
    with open(target, "wb") as out:
        out.write(head.getvalue())
        out.truncate(begin + 4 * total * width)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        file = os.open(target, os.O_WRONLY)
        try:
            for batch in batches:
                names, numbers = batch.column("file").to_pylist(), batch.column("row").to_pylist()
                values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(names), width)
                lo = 0
                for hi in range(1, len(names) + 1):  # runs of rows that follow each other
                    if hi == len(names) or names[hi] != names[lo] or numbers[hi] != numbers[hi - 1] + 1:
                        data, where = memoryview(values[lo:hi].tobytes()), begin + 4 * width * (starts[names[lo]] + numbers[lo])
                        while data:
                            n = os.pwrite(file, data, where)
                            data, where = data[n:], where + n
                        lo = hi
                done += len(names)
            os.fsync(file)
        finally:
            os.close(file)
        yield pa.RecordBatch.from_arrays([pa.array([done])], ["n"])

    written = rows.mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0
    if written != total:
        raise RuntimeError(f"{written} of {total} vectors written")
