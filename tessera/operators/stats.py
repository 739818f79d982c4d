"""Statistics, vocabularies and validation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.cut import cut


def computed_once(df: DataFrame, *columns: Column) -> DataFrame:
    """df.select(columns), with costly expressions evaluated once a row: a generator of one row stands between them and
    what uses them, which the optimizer would else merge, repeating them wherever they occur."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def annotation_statistics(points: DataFrame, confidence: str = "confidence") -> DataFrame:
    """A missing confidence counts as 0."""
    c = F.coalesce(F.col(confidence), F.lit(0.0))
    return points.agg(F.count("*").alias("n"), F.avg(c).alias("avg_confidence"), F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"))


def frame_confidence(points: DataFrame, by: list[str], default: float = 0.5, ord_: str = "ord") -> DataFrame:
    """By frame the number of annotations, their mean confidence (default where it lacks) and the label of the first."""
    return points.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("confidence"), F.lit(default))).alias("confidence"), F.min_by("label", ord_).alias("primary_label"))


def qa_checks(pairs: DataFrame, types: list[str], most: int = 10) -> DataFrame:
    """(check, severity, failed, n_rows, examples) of question rows (frame_id, question, answer, question_type), in one pass.

    Examples are frame ids, `most` of them; the counts aren't capped."""
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    checks = {
        "missing_field": ("error", empty("frame_id") | empty("question") | F.col("answer").isNull()),
        "no_question_mark": ("warning", ~empty("question") & ~F.trim("question").endswith("?")),
        "empty_answer": ("error", F.col("answer").isNotNull() & empty("answer")),
        "bad_type": ("warning", ~F.coalesce(F.col("question_type").isin(*types), F.lit(False))),
    }
    rows = pairs.select("frame_id", F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.lit(s).alias("severity"), c.alias("bad")) for k, (s, c) in checks.items()])).alias("r")).select("frame_id", "r.*")
    # the least ids: a sketch of fixed size for each check, however many rows fail
    found = rows.groupBy("check", "severity").agg(F.count_if("bad").alias("failed"), F.count("*").alias("n_rows"))
    least = rows.where("bad and frame_id is not null").select("check", "frame_id").distinct().withColumn("_k", F.row_number().over(Window.partitionBy("check").orderBy("frame_id"))).where(F.col("_k") <= most)
    return found.join(least.groupBy("check").agg(F.array_sort(F.collect_list("frame_id")).alias("examples")), "check", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def qa_totals(pairs: DataFrame) -> DataFrame:
    """(n, frames, per_frame)."""
    return pairs.agg(F.count("*").alias("n"), F.count_distinct("frame_id").alias("frames")).withColumn("per_frame", F.coalesce(F.try_divide("n", "frames"), F.lit(0.0)))


def top_labels(points: DataFrame, label: str = "label", k: int = 20, ord_: str = "ord") -> DataFrame:
    """The k most frequent labels, ties by first occurrence, with their rank."""
    counts = points.groupBy(label).agg(F.count("*").alias("n"), F.min(ord_).alias("first")).orderBy(F.desc("n"), "first").limit(k)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).drop("first")


def distribution(df: DataFrame, label: str) -> DataFrame:
    """Counts and percentages, two decimals."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_n"))
    return counts.join(F.broadcast(total)).select(label, "n", F.round(F.col("n") * 100 / F.col("_n"), 2).alias("percent"))


def multilabel_distribution(df: DataFrame, labels: str) -> DataFrame:
    """A27."""
    return df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def dataset_statistics(df: DataFrame, split: str, video: str, frame: str, kind: str, ord_: str) -> DataFrame:
    """By split, and for all (split null): rows, videos, frames, rows a frame, and the most frequent kind (ties: seen first)."""
    main = df.rollup(split).agg(F.count("*").alias("n"), F.count_distinct(video).alias("videos"), F.count_distinct(F.struct(video, frame)).alias("frames"))
    modes = df.cube(split, kind).agg(F.count("*").alias("c"), F.min(ord_).alias("first"), F.grouping(kind).alias("g")).where("g = 0")
    mode = modes.groupBy(split).agg(F.max_by(kind, F.struct("c", -F.col("first"))).alias("mode"))
    a, b = main.alias("a"), mode.alias("b")
    return a.join(b, F.col(f"a.{split}").eqNullSafe(F.col(f"b.{split}"))).select(f"a.{split}", "n", "videos", "frames", (F.col("n") / F.col("frames")).alias("rows_per_frame"), "mode")


RANGES, STEP = 1024, 32


def value_ranges(counts: DataFrame, by: list[str]) -> DataFrame:
    """counts (*by, _v, _c), distinct values and their numbers, with n, the sum of _c in the group, and _r, a range of values: about a
    RANGES-th of the group's *distinct values* each, cut at the quantiles of a mergeable sketch, however the values are spread."""
    cuts = [k / RANGES for k in range(1, RANGES)]
    ends = counts.groupBy(*by).agg(F.percentile_approx("_v", F.array(*map(F.lit, cuts)), F.lit(16 * RANGES)).alias("_cuts"), F.sum("_c").alias("n"))
    # a sketch depends on the order in which its parts arrive, so it's made once: all that use the ranges must see the same cuts
    ends = cut(ends)
    ends = ends.withColumn("_coarse", F.transform(F.sequence(F.lit(1), F.lit(RANGES // STEP - 1)), lambda k: F.element_at("_cuts", k * STEP)))
    a, b = counts.alias("a"), ends.alias("b")
    same = F.lit(True)
    for k in by:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    below = lambda c: F.size(F.filter(c, lambda e: e < F.col("_v")))
    rows = a.join(b, same).withColumn("_k", below("_coarse"))
    place = F.col("_k") * STEP + below(F.slice("_cuts", F.col("_k") * STEP + 1, F.lit(STEP - 1)))
    return rows.select(*[F.col(f"a.{k}").alias(k) for k in by], "_v", "_c", "n", place.alias("_r"))


def percentiles(df: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation: (*by, n, and one column each), nulls left out.

    Values are counted, dealt to value_ranges() and ranked within these, so no buffer or task holds the values of a group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    keys = [F.col(f"a.{k}").alias(k) for k in by]
    rows = value_ranges(counts, by)
    sizes = rows.groupBy(*by, "_r").agg(F.sum("_c").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("_c").over(Window.partitionBy(*by, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    c, d = rows.withColumn("_in", within).alias("a"), sizes.withColumn("_before", before).alias("b")
    same = F.lit(True)
    for k in by + ["_r"]:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    ranked = c.join(d, same).select(*keys, "_v", "n", (F.col("_in") + F.col("_before")).alias("_upto"))
    at = {k: (F.col("n") - 1) * F.lit(float(q)) for k, q in shares.items()}
    found = ranked.groupBy(*by, "n").agg(*[F.min(F.when(F.col("_upto") > edge(at[k]), F.col("_v"))).alias(f"_{name}_{k}") for k in shares for name, edge in (("lo", F.floor), ("hi", F.ceil))])
    mid = lambda k: F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * (at[k] - F.floor(at[k]))
    return found.select(*by, "n", *[mid(k).alias(k) for k in shares])


def blur_distribution(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    q = percentiles(df, value, by, {f"p{p}": p / 100 for p in (25, 50, 75, 90)}).drop("n").withColumn("suggested", F.col("p25"))
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    a, b = sums.alias("a"), q.alias("b")
    same = F.lit(True)
    for k in by:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same, "left").select("a.*", *[f"b.{c}" for c in q.columns if c not in by])


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal bins from the least to the largest value, which falls in the last; empty bins left out."""
    ends = df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    place = F.least(F.floor((F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins) + 1, F.lit(bins))
    return df.join(F.broadcast(ends)).select(F.coalesce(place, F.lit(1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def extraction_totals(df: DataFrame) -> DataFrame:
    """Of rows (sampled, kept, blurry); the blur rate in percent, 0 without frames."""
    s = df.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("sampled", "kept", "blurry")])
    return s.withColumn("blur_rate", F.coalesce(F.round(F.try_divide(F.col("blurry") * 100.0, F.col("sampled")), 2), F.lit(0.0)))


SPECIALS = ["<pad>", "<unk>", "<start>", "<end>"]


def vocabulary(texts: DataFrame, text: str, ord_: str, least: int = 1) -> DataFrame:
    """(word, n, id): ids from 4 by falling count, ties in order of appearance."""
    words = texts.select(F.col(ord_).alias("_o"), F.posexplode(F.split(text, r"\s+")).alias("_p", "word")).where("word != ''")
    counts = words.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("_o", "_p")).alias("first")).where(F.col("n") >= least)
    # words of one count are ranked together, and moved by the number of words with larger counts
    sizes = counts.groupBy("n").agg(F.count("*").alias("_k"))
    before = sizes.select(F.col("n").alias("_n"), F.coalesce(F.sum("_k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy("n").orderBy("first")))
    return ranked.join(before, F.col("n") == F.col("_n")).select("word", "n", (F.col("_r") + F.col("_before") + len(SPECIALS) - 1).cast("long").alias("id"))


def pooled(vectors: DataFrame, by: str, vector: str, how: str = "mean", ord_: str | None = None) -> DataFrame:
    """Vectors of a group by place: mean, max, or the first or last vector by ord."""
    if how in ("first", "last"):
        pick = F.min_by if how == "first" else F.max_by
        return vectors.groupBy(by).agg(pick(vector, ord_).alias("vector"))
    each = vectors.select(by, F.posexplode(F.col(vector).cast("array<double>")).alias("place", "v"))
    return each.groupBy(by, "place").agg((F.avg if how == "mean" else F.max)("v").alias("v"))


def timelines(points: DataFrame, by: list[str], time: str, least: int = 3, keep: int = 5, ord_: str = "ord") -> DataFrame:
    """Times of each label's timeline of at least `least` rows, in order; `keep` of them by hash."""
    n = points.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    drawn = F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(F.col(ord_).cast("string")), ord_))
    kept = points.withColumn("_k", drawn).where(F.col("_k") <= keep)
    rows = kept.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(ord_).alias("o")))).alias("_rows"))
    return rows.join(n, by).select(*by, "n", F.transform("_rows", lambda r: r.t).alias("times"))


# Validation: rules are rows (check, severity, failed), so that more can be joined on with union.


def rules(df: DataFrame, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """One pass counts the rows that each check finds; totals aren't capped."""
    found = df.agg(F.count("*").alias("_rows"), *[F.count_if(c).alias(name) for name, _, c in checks])
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.col(name).alias("failed")) for name, severity, _ in checks])
    return found.select(F.col("_rows").alias("n_rows"), F.explode(rows).alias("r")).select("r.check", "r.severity", "r.failed", "n_rows")


def examples(df: DataFrame, failed: Column, column: str, most: int = 10) -> DataFrame:
    return df.where(failed).select(column).limit(most)


def counts_in_bounds(df: DataFrame, by: str, low: int, high: int) -> DataFrame:
    """A15."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("ok", F.col("n").between(low, high))


def split_ratio_check(df: DataFrame, wanted: dict[str, float], within: float = 0.02, split: str = "split") -> DataFrame:
    """A17."""
    counts = df.groupBy(split).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_n"))
    share = F.col("n") / F.col("_n")
    target = F.coalesce(*[F.when(F.col(split) == k, F.lit(v)) for k, v in wanted.items()])
    return counts.join(F.broadcast(total)).select(split, "n", share.alias("share"), (F.abs(share - target) <= within).alias("ok"))


def class_coverage(df: DataFrame, kinds: dict[str, int], kind: str = "kind", label: str = "label") -> DataFrame:
    """Distinct labels of each kind against the number wanted."""
    pairs = F.array(*[F.struct(F.lit(k).alias(kind), F.lit(n).cast("int").alias("wanted")) for k, n in kinds.items()])
    wanted = df.sparkSession.range(1).select(F.inline(pairs))
    found = df.groupBy(kind).agg(F.count_distinct(label).alias("found"))
    return wanted.join(found, kind, "left").select(kind, "wanted", F.coalesce("found", F.lit(0)).alias("found"), (F.coalesce("found", F.lit(0)) == F.col("wanted")).alias("ok"))


def missing_types(df: DataFrame, types: list[str], split: str = "split", kind: str = "kind") -> DataFrame:
    """A19."""
    seen = df.groupBy(split).agg(F.collect_set(kind).alias("_seen"))
    return seen.select(split, F.array_sort(F.array_except(F.array(*map(F.lit, types)), "_seen")).alias("missing"))


def orphans(rows: DataFrame, files: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Rows whose frame is neither the stem, name nor path of a file."""
    name = F.element_at(F.split("path", "/"), -1)
    alias = files.select(F.explode(F.array(F.col("path"), name, F.regexp_replace(name, r"\.[^.]*$", ""))).alias(frame)).distinct()
    return rows.join(alias, frame, "left_anti")


def review_progress(decisions: DataFrame) -> DataFrame:
    """A21."""
    of = lambda d: F.count_if(F.col("decision") == d)
    counts = decisions.agg(F.count("*").alias("reviewed"), of("accepted").alias("accepted"), of("modified").alias("modified"), of("rejected").alias("rejected"))
    rate = F.coalesce(F.try_divide((F.col("accepted") + F.col("modified")) * 100.0, F.col("reviewed")), F.lit(0.0))
    return counts.withColumn("rate", rate).withColumn("good", F.col("rate") >= 80)
