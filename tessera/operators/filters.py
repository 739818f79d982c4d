"""Row filters by name (F1-F9, F13-F16), limits and offsets (T1-T7) and set operations on tables and arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: names that stand for no instrument
NO_PRIMARY = ("no_visible_instrument", "out_of_patient", "")
NO_SECONDARY = ("no_secondary_instrument", "-2", "")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def confident(confidence: Column, least: float = 0.7) -> Column:
    """null counts as unsure."""
    return F.coalesce(confidence, F.lit(0.0)) >= least


def sure_instrument(category: Column, confidence: Column, points: Column, least: float = 0.85) -> Column:
    """an instrument with a confidence of `least` and some point."""
    return F.coalesce((category == "instruments") & (confidence >= least) & (F.size(points) > 0), F.lit(False))


def unique_enough(confidence: Column, above: float = 0.9) -> Column:
    """F3."""
    return F.coalesce(confidence > above, F.lit(False))


def visible_instrument(name: Column) -> Column:
    """null counts as empty."""
    return ~_text(name).isin(*NO_PRIMARY)


def second_instrument(name: Column, zone: Column | None = None, strict: bool = True) -> Column:
    """a second instrument with a zone. Not strict: an empty name and a missing zone pass as well."""
    if not strict:
        return ~_text(name).isin(*[x for x in NO_SECONDARY if x])
    there = ~_text(name).isin(*NO_SECONDARY)
    return there if zone is None else there & (_text(zone) != "")


def seen_instruments(instruments: Column) -> Column:
    """of an array of (name, presence, ..) those that aren't "not visible"."""
    return F.filter(instruments, lambda i: F.lower(_text(i.presence)) != "not visible")


def with_image(df: DataFrame, files: DataFrame, path: str = "image_path") -> DataFrame:
    """rows whose image is among files (path)."""
    return df.join(files.select(F.col("path").alias(path)).distinct(), path, "left_semi").select(*df.columns)


def known_label(label: Column, classes: list[str] | None = None) -> Column:
    """F8: not unknown, or one of classes."""
    return F.coalesce(label.isin(*classes) if classes is not None else label != "unknown", F.lit(False))


def indexed(index: Column) -> Column:
    """F9."""
    return F.coalesce(index >= 0, F.lit(False))


def enough_overlap(n: Column, value: Column, least: int = 5) -> Column:
    """value where there are `least` common keys (5 for pairs of raters, 3 for more), else null."""
    return F.when(n >= least, value)


def near_keypoint(match: Column, distance: Column, reach: float = 30.0) -> Column:
    """a match that isn't -1, within reach."""
    return F.coalesce((match > -1) & (distance < reach), F.lit(False))


def in_vocabulary(df: DataFrame, words: DataFrame, column: str) -> DataFrame:
    """F16: rows whose column is among words (word)."""
    return df.join(words.select(F.col("word").alias(column)).distinct(), column, "left_semi").select(*df.columns)


# order, limits and offsets; ord is the input order


def by_first_time(df: DataFrame, group: str = "video_id", times: str = "two_fps_timestamps") -> DataFrame:
    """By group and first time; rows without times first."""
    return df.orderBy(group, F.get(times, F.lit(0)).asc_nulls_first(), "ord")


def by_count(df: DataFrame, kind: str) -> DataFrame:
    """(kind, n) by falling count, ties in order of appearance."""
    return df.groupBy(kind).agg(F.count("*").alias("n"), F.min("ord").alias("_first")).orderBy(F.desc("n"), "_first").drop("_first")


def first_rows(df: DataFrame, n: int, ord_: str = "ord") -> DataFrame:
    """The first n rows by ord."""
    return df.orderBy(ord_).limit(n)


def batch(df: DataFrame, start: int, size: int, ord_: str = "ord") -> DataFrame:
    """T5: rows start to start + size by a dense ord from 0; a filter that reaches the scan, not a rescan from the start."""
    return df.where((F.col(ord_) >= start) & (F.col(ord_) < start + size))


def top_k(probabilities: Column, names: list[str], k: int) -> Column:
    """The k most probable (name, p), ties in order of names."""
    pairs = F.transform(probabilities, lambda p, i: F.struct((-p).alias("_q"), i.alias("_i"), F.get(F.array(*map(F.lit, names)), i).alias("name"), p.alias("p")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: F.struct(x["name"].alias("name"), x.p.alias("p")))


def label_list(df: DataFrame, *columns: str) -> DataFrame:
    """One row, the sorted array of the labels in columns."""
    return df.select(F.explode(F.array(*columns)).alias("label")).agg(F.array_sort(F.collect_set("label")).alias("labels"))


def concatenated(*families: DataFrame) -> DataFrame:
    """All rows; columns that a family lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), families)


def common_keys(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys that all frames have."""
    return reduce(DataFrame.intersect, [f.select(*keys) for f in frames])


def share_token(a: Column, b: Column) -> Column:
    """A word in common, whatever the case."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != "")
    return F.coalesce(F.arrays_overlap(words(a), words(b)), F.lit(False))


def every(df: DataFrame, n: int, by: list[str], ord_: str = "ord", start: int = 0) -> DataFrame:
    """Of each group rows start, start + n, ..., numbered anew from 0 as "number" (W13)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(ord_)) - 1
    kept = df.withColumn("_p", place - start).where((F.col("_p") >= 0) & (F.col("_p") % n == 0))
    return kept.withColumn("number", F.floor(F.col("_p") / n).cast("int")).drop("_p")


def stride_of(video_fps: float, fps: float) -> int:
    """Every how many frames of a video one is taken for fps frames a second."""
    return max(1, int(video_fps / fps)) if fps > 0 else 1
