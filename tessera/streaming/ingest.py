"""Streams over files: micro-batches, resume by checkpoint, per-row failures, deduplication and progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def stream(spark: SparkSession, path: str, schema: str, format_: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    """ST1, S19."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format_).load(path)


def run_available(df: DataFrame, path: str, checkpoint: str, format_: str = "parquet") -> None:
    """ST2, ST3: writes what is there and ends; a later run goes on from the checkpoint."""
    df.writeStream.format(format_).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def annotate(df: DataFrame, annotator: Callable[[Column], Column], on: str) -> DataFrame:
    """ST6: the annotator's column, and error where it gave none; the rows all stay."""
    out = df.withColumn("annotation", annotator(F.col(on)))
    return out.withColumn("error", F.when(F.col("annotation").isNull(), F.concat(F.lit("no annotation for "), F.coalesce(F.col(on).cast("string"), F.lit("null")))))


def two_sinks(good: str, bad: str) -> Callable[[DataFrame, int], None]:
    """ST6: a foreachBatch function. A batch that is run again replaces its own rows."""

    def write(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        batch.where("error is null").drop("error").write.mode("overwrite").parquet(f"{good}/batch={n}")
        batch.where("error is not null").write.mode("overwrite").parquet(f"{bad}/batch={n}")
        batch.unpersist()

    return write


def once_by_content(df: DataFrame, content: str, time: str, delay: str = "1 hour") -> DataFrame:
    """ST5: rows whose content hash was seen within the watermark go."""
    return df.withColumn("content_md5", F.md5(content)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_md5"])


def windowed_counts(df: DataFrame, time: str, by: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts by event-time window, an addition to the inventory."""
    return df.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def hooked(df: DataFrame, *hooks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Maps and filters in turn; each takes and returns a DataFrame, so they stay in the plan."""
    for hook in hooks:
        df = df.transform(hook)
    return df


def with_columns_of(df: DataFrame, registry: dict[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """A column for each registered function (rewards, predictions): f(df) gives its expression."""
    return df.withColumns({name: f(df) for name, f in registry.items()})


class Progress(StreamingQueryListener):
    """ST7: rows and rate of the batches so far."""

    def __init__(self) -> None:
        self.rows, self.batches, self.rate = 0, 0, 0.0

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.rows += event.progress.numInputRows
        self.batches += 1
        self.rate = event.progress.processedRowsPerSecond

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass
