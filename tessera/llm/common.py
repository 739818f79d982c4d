"""What the operators share: table access, the shared work folder and row digests."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where the setting is missing and all of Spark runs in one process (tests) a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tessera-')}")
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def dealt(df: DataFrame) -> DataFrame:
    """df; where its files give fewer tasks than there are cores, rows are dealt anew: the work on a text takes far longer than
    its shuffle. Large tables have more tasks than cores and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents, dealt() to all cores."""
    return dealt(table(spark, sf_dir, "documents"))


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def full_uri(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, by which a task finds it without Spark's configuration."""
    files, at = _file_system(spark, path)
    return re.sub("^file:/+", "file:///", files.makeQualified(at).toString())


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. What is written there goes when the application ends."""
    path = f"{work_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    return path


def discard(df: DataFrame) -> None:
    """Deletes the table of a materialized df that nothing will read again."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        if os.path.basename(path).startswith("tessera-"):
            files, at = _file_system(df.sparkSession, path)
            files.delete(at, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: the lineage is cut, and a lost
    executor costs only a reread."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key_crc(column: str = "doc_id") -> Column:
    """Unsigned crc32 of the key as decimal text; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text, empty for null."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def set_aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns called as names renamed, and their new names by the old ones."""
    taken = {n.lower() for n in names}
    moved = {c: f"aside_{k}_{c}" for k, c in enumerate(docs.columns) if c.lower() in taken}
    return docs.withColumnsRenamed(moved), moved


def put_back(df: DataFrame, columns: list[str], moved: dict[str, str]) -> DataFrame:
    """The columns of df as they were called before set_aside()."""
    return df.select(*[F.col(f"`{moved[c]}`").alias(c) if c in moved else F.col(f"`{c}`") for c in columns])


GROUP_BYTES = 1 << 20


def groups(keys: list, texts: pa.Array) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and texts in groups of GROUP_BYTES or a little more."""
    some: list = []
    held = 0
    own: list = []
    for key, text in zip(keys, texts):
        own.append(key)
        some.append(text.as_py())
        held += len(some[-1])
        if held >= GROUP_BYTES:
            yield own, some
            own, some, held = [], [], 0
    if own:
        yield own, some
