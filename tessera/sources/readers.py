"""Scans (S1-S24, S31, S32). A missing file is an empty table where the operator says so."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.filters import confident
from tessera.operators.generate import flat_points
from tessera.operators.matching import last_per_key
from tessera.sources.ranged import scan

ANNOTATION = (
    "video_id string, question string, label string, count int, two_fps_timestamps array<double>, points array<array<struct<x:double,y:double>>>, "
    "category string, confidence double, video_source string, annotator string"
)
FRAME = "frame_id string, id string, phase string, surgical_phase string, step string, surgical_step string, operation_note string, note string, video_id string"
QA_PAIR = "frame_id string, question string, answer string, question_type string, video_id string"
STEPS = "int_time int, str_step string"
INSTRUMENTS = "int_time int, str_instrument1 string, str_instrument2 string, pos_instrument1 string, pos_instrument2 string"


def _or_empty(spark: SparkSession, read, schema: str) -> DataFrame:  # noqa: ANN001
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def annotations(spark: SparkSession, *paths: str, category: str | None = None) -> DataFrame:
    """JSON arrays of point annotations; the first path that exists counts, none gives no rows.

    ord holds the order within a file."""
    for path in paths:
        df = _or_empty(spark, lambda path=path: spark.read.schema(ANNOTATION).option("multiLine", True).json(path), ANNOTATION)
        if df.inputFiles() or path == paths[-1]:
            break
    df = df.withColumn("ord", F.monotonically_increasing_id())  # in place at the scan, before any shuffle
    return df.where(F.col("category") == category) if category else df


def first_points(annotations_: DataFrame) -> DataFrame:
    """Of each annotation its first time and the first point of that time's list; rows without either go."""
    at = lambda c: F.get(c, F.lit(0))
    rows = annotations_.select("video_id", "category", "label", at("two_fps_timestamps").alias("ts"), at(at("points")).alias("p"), "confidence", "ord")
    return rows.where("ts is not null and p is not null").select("video_id", "category", "label", "ts", "p.x", "p.y", "confidence", "ord")


def confident_points(annotations_: DataFrame, least: float = 0.7, fps: int = 2) -> DataFrame:
    """S3: flat points of sure annotations by (video_id, frame)."""
    return flat_points(annotations_.where(confident(F.col("confidence"), least)), digits=None).withColumn("frame", (F.col("ts") * fps).cast("int"))


def ground_truth(spark: SparkSession, glob: str, kind: str) -> DataFrame:
    """CSV files of a video each, "steps" or "instruments"; the video is the number in the file name, empty strings are null."""
    schema = {"steps": STEPS, "instruments": INSTRUMENTS}[kind]
    full = schema + ", video int, ord long"
    df = _or_empty(spark, lambda: spark.read.schema(schema).option("header", True).csv(glob).withColumns({"video": F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.csv$", 1).cast("int"), "_at": F.monotonically_increasing_id()}), full)
    if "_at" in df.columns:
        # ids grow within a file, but files are dealt to tasks by size: the order is that of videos, then of lines
        line = F.row_number().over(Window.partitionBy("video").orderBy("_at"))
        df = df.withColumn("ord", F.coalesce("video", F.lit(0)).cast("long") * (1 << 32) + line).drop("_at")
    return df.select(*[F.nullif(F.col(f.name), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema])


def frame_annotations(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """JSON files of four shapes ({"frames": {id: ..}}, {"annotations": [..]}, {id: ..} or [..]) as rows (frame_id, body variant).

    Files that can't be parsed give one row with corrupt set; the last of several rows of a frame counts."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.json").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    root = files.withColumn("root", F.try_parse_json("value"))
    text = F.to_json
    rows = root.withColumns({"list": F.coalesce(F.try_variant_get("root", "$.annotations", "array<variant>"), F.try_variant_get("root", "$.data", "array<variant>"), F.try_variant_get("root", "$", "array<variant>")), "named": F.coalesce(F.try_variant_get("root", "$.frames", "map<string,variant>"), F.try_variant_get("root", "$", "map<string,variant>"))})
    listed = F.transform("list", lambda v: F.struct(F.coalesce(F.try_variant_get(v, "$.frame_id", "string"), F.try_variant_get(v, "$.id", "string")).alias("key"), v.alias("value")))
    pairs = F.when(F.col("list").isNotNull(), listed).otherwise(F.map_entries("named"))
    out = rows.select("file", F.col("root").isNull().alias("corrupt"), F.posexplode_outer(pairs).alias("_i", "e"))
    out = out.select("file", "corrupt", F.col("e.key").alias("frame_id"), text(F.col("e.value")).alias("body"), F.struct("file", "_i").alias("ord"))
    good = last_per_key(out.where("not corrupt and frame_id is not null"), ["frame_id"])
    return good.select("frame_id", "body", "corrupt", "file").union(out.where("corrupt").select("frame_id", "body", "corrupt", "file"))


def qa_pairs(spark: SparkSession, path: str) -> DataFrame:
    """CSV, or JSON as a list or wrapped as annotations, qa_pairs or data."""
    if path.endswith(".csv"):
        return spark.read.schema(QA_PAIR).option("header", True).csv(path)
    one = f"struct<{', '.join(f.replace(' ', ':') for f in QA_PAIR.split(', '))}>"
    whole = spark.read.option("wholetext", True).text(path)
    wrapped = F.from_json("value", f"annotations array<{one}>, qa_pairs array<{one}>, data array<{one}>")
    rows = F.coalesce(F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{one}>")), wrapped.annotations, wrapped.qa_pairs, wrapped["data"])
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def documents_of(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON files of a folder as frame_annotations(), and the rows of its CSV files, as rows (frame_id, body, corrupt, file)."""
    out = frame_annotations(spark, folder)
    tables = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").format("binaryFile").load(folder).select("path").limit(1)
    if tables.isEmpty():
        return out
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder)
    name = F.coalesce(*[F.col(c) for c in ("frame_id", "id") if c in rows.columns], F.lit(None).cast("string"))
    return out.unionByName(rows.select(name.alias("frame_id"), F.to_json(F.struct(*rows.columns)).alias("body"), F.lit(False).alias("corrupt"), F.col("_metadata.file_path").alias("file")))


def unprocessed(df: DataFrame, done: DataFrame, key: str, most: int | None = None, ord_: str = "ord") -> DataFrame:
    """Rows whose key isn't among done, the first `most` of them by ord."""
    rows = df.join(done.select(key), key, "left_anti").select(*df.columns)
    return rows if most is None else rows.orderBy(ord_).limit(most)


def zip_entries(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".mp4", ".avi", ".mov"), range_bytes: int | None = None) -> DataFrame:
    """(archive, name, content) of the entries of zip archives with these suffixes, each archive read by many tasks; a broken archive has none."""
    return scan(spark, "zip_members", path, entries=",".join(suffixes), rangeBytes=range_bytes)


def split_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files, the split from the file's name (or the folder split=..). Files without rows add none; files named "data" only
    are one split, train."""
    df = spark.read.option("recursiveFileLookup", True).parquet(folder) if not _partitioned(spark, folder) else spark.read.parquet(folder)
    if "split" not in df.columns:
        df = df.withColumn("split", F.regexp_extract(F.col("_metadata.file_name"), r"^([A-Za-z]+)", 1))
        df = df.withColumn("split", F.when(F.col("split").isin("data", "part"), "train").otherwise(F.col("split")))
    return df


def _partitioned(spark: SparkSession, folder: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return any(x.getPath().getName().startswith("split=") for x in files.listStatus(at))


def stored_vectors(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """.npy files of vectors as rows (file, ord, embedding); a file is one array, read by many tasks."""
    return scan(spark, "npy_rows", path, rangeBytes=range_bytes)


def frames(spark: SparkSession, folder: str, glob: str = "*.{png,jpg,jpeg}", every: int = 1, content: bool = False) -> DataFrame:
    """(path, video, frame[, content]): the video is the parent folder, the frame the number that ends the stem."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    parts = F.split("path", "/")
    rows = df.select("path", F.element_at(parts, -2).alias("video"), F.regexp_extract("path", r"(\d+)\.[^.]*$", 1).try_cast("int").alias("frame"), *(["content"] if content else []))
    if every == 1:
        return rows
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("video").orderBy("path"))).where((F.col("_r") - 1) % every == 0).drop("_r")


def decoded(frames_: DataFrame, decode, schema: str) -> DataFrame:  # noqa: ANN001
    """The boundary to decoders and models: decode maps iterators of Arrow batches."""
    return frames_.mapInArrow(decode, schema)


def image_bytes(df: DataFrame, image: str = "image") -> F.Column:
    """The bytes of an image column of any of four forms: binary, a struct with bytes, a struct whose image has bytes, base64 text."""
    kind, c = df.schema[image].dataType.simpleString(), F.col(image)
    if kind == "binary":
        return c
    if kind == "string":
        return F.try_to_binary(F.regexp_replace(c, "^data:[^,]*,", ""), F.lit("base64"))
    if kind.startswith("struct<"):
        inner = {f.name: f.dataType.simpleString() for f in df.schema[image].dataType}
        if inner.get("bytes") == "binary":
            return c["bytes"]
        if "image" in inner and "bytes:binary" in inner["image"]:
            return c["image"]["bytes"]
    raise ValueError(f"no image in a column of type {kind}")


def sample_annotations(spark: SparkSession, phases: list[str], n: int = 10) -> DataFrame:
    """N made-up frames."""
    pick = F.element_at(F.array(*map(F.lit, phases)), (F.pmod(F.xxhash64("id"), F.lit(len(phases))) + 1).cast("int"))
    return spark.range(n).select(F.format_string("video_01_frame_%06d", "id").alias("frame_id"), pick.alias("phase"))
