"""Classification and pointing metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.points import distance, first_point, has_point, zone
from tessera.operators.stats import computed_once, percentiles


def confusion_matrix(df: DataFrame, labels: list[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """A8d: (truth, predicted, n, share) for all pairs of labels; share is of the row, with 1e-10 in the denominator."""
    names = F.array(*map(F.lit, labels))
    grid = df.sparkSession.range(1).select(F.explode(names).alias("truth")).select("truth", F.explode(names).alias("predicted"))
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    full = grid.join(counts, ["truth", "predicted"], "left").fillna(0, ["n"])
    rows = full.groupBy("truth").agg(F.sum("n").alias("row"))
    return full.join(rows, "truth").select("truth", "predicted", "n", (F.col("n") / (F.col("row") + F.lit(1e-10))).alias("share"))


def per_class(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(label, tp, fp, fn, support, precision, recall, f1) for labels seen on either side, from one aggregation."""
    counts = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("c"))
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(zero)
    sides = F.array(F.struct(F.col("t").alias("label"), hit.alias("tp"), zero.alias("fp"), (F.col("c") - hit).alias("fn")), F.struct(F.col("p").alias("label"), zero.alias("tp"), (F.col("c") - hit).alias("fp"), zero.alias("fn")))
    sums = counts.select(F.explode(sides).alias("s")).select("s.*").groupBy("label").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("label", "tp", "fp", "fn", (tp + fn).alias("support"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def class_report(df: DataFrame, labels: list[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """per_class over the fixed list; labels without rows have zeros."""
    names = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("label"))
    found = per_class(df, truth, predicted)
    return names.join(found, "label", "left").fillna(0).select(*found.columns)


def macro_report(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Accuracy, and macro and weighted F1 over the labels observed on either side, unknown included."""
    found = per_class(df, truth, predicted)
    return found.agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def pointing_metrics(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Shares are of the rows whose truth has a point; zone agreement is of those whose prediction has one too."""
    both = computed_once(df, first_point(F.col(truth)).alias("g"), first_point(F.col(predicted)).alias("p"), has_point(F.col(predicted)).alias("tag")).where("g is not null")
    rows = both.withColumns({"d": distance(F.col("g.x"), F.col("g.y"), F.col("p.x"), F.col("p.y")), "same": zone(F.col("g.x"), F.col("g.y"), "quadrant") == zone(F.col("p.x"), F.col("p.y"), "quadrant")})
    share = lambda c: F.coalesce(F.count_if(c) / F.count("*"), F.lit(0.0))
    none = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.agg(
        F.count("*").alias("n"),
        share(F.col("tag")).alias("format_rate"),
        share(F.col("d") <= 10).alias("accuracy_10"),
        share(F.col("d") <= 15).alias("accuracy_15"),
        none(F.count_if(F.col("same") & F.col("d").isNotNull()) / F.nullif(F.count_if("tag"), F.lit(0))).alias("quadrant_accuracy"),
        none(F.avg("d")).alias("mean_distance"),
        none(F.stddev_pop("d")).alias("std_distance"),
    ).join(percentiles(rows, "d", [], {"median_distance": 0.5}).drop("n"), how="left").withColumn("median_distance", none(F.col("median_distance")))


def multilabel_metrics(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Mean precision and recall of rows with arrays of labels, F1 of the means, and the share of equal sets."""
    hits = F.size(F.array_intersect(predicted, truth))
    same = (F.size(F.array_except(predicted, truth)) == 0) & (F.size(F.array_except(truth, predicted)) == 0)
    p, r = hits / (F.size(F.array_distinct(predicted)) + F.lit(1e-8)), hits / (F.size(F.array_distinct(truth)) + F.lit(1e-8))
    means = df.agg(F.count("*").alias("n"), F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(same.cast("double")).alias("exact"))
    a, b = F.col("precision"), F.col("recall")
    return means.withColumn("f1", 2 * a * b / (a + b + F.lit(1e-8)))


TINY = 1e-8  # what F1 adds to its divisor


def task_metrics(df: DataFrame, task: str = "task", truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """By task (task, n, accuracy, precision, recall, f1) of rows with one true and one predicted class: precision is the mean over the classes
    predicted, recall the mean over those that occur, 0 without any; F1 is of these two. Rows without a true class go."""
    rows = df.where(F.col(truth).isNotNull()).select(F.col(task).alias("task"), F.col(truth).alias("t"), F.col(predicted).alias("p"))
    totals = rows.groupBy("task").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("t") == F.col("p"), F.lit(False)).cast("double")).alias("accuracy"))
    hit = F.coalesce(F.col("t") == F.col("p"), F.lit(False))
    sides = rows.select("task", F.inline(F.array(F.struct(F.col("t").alias("c"), F.lit(True).alias("is_truth"), hit.alias("hit")), F.struct(F.col("p").alias("c"), F.lit(False).alias("is_truth"), hit.alias("hit")))))
    by_class = sides.where("c is not null").groupBy("task", "c").agg(F.count_if("is_truth").alias("real"), F.count_if(~F.col("is_truth")).alias("said"), F.count_if(F.col("is_truth") & F.col("hit")).alias("hits"))
    means = by_class.groupBy("task").agg(F.coalesce(F.avg(F.try_divide("hits", "said")), F.lit(0.0)).alias("precision"), F.coalesce(F.avg(F.try_divide("hits", "real")), F.lit(0.0)).alias("recall"))
    a, b = totals.alias("a"), means.alias("b")
    out = a.join(b, F.col("a.task").eqNullSafe(F.col("b.task"))).select("a.task", "n", "accuracy", "precision", "recall")
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(TINY)))


def multilabel_task_metrics(df: DataFrame, task: str = "task", truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """The same columns for rows with arrays of labels: means over rows of precision and recall, and the share of equal sets as accuracy."""
    hits = F.size(F.array_intersect(predicted, truth))
    same = (F.size(F.array_except(predicted, truth)) == 0) & (F.size(F.array_except(truth, predicted)) == 0)
    share = lambda c: hits / (F.size(F.array_distinct(c)) + F.lit(TINY))
    rows = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    out = rows.groupBy(F.col(task).alias("task")).agg(F.count("*").alias("n"), F.avg(same.cast("double")).alias("accuracy"), F.avg(share(predicted)).alias("precision"), F.avg(share(truth)).alias("recall"))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(TINY)))


def by_group_and_total(df: DataFrame, group: str, correct: str = "correct") -> DataFrame:
    """Accuracy by group and over all (group null), by rollup in one pass."""
    return df.rollup(group).agg(F.count("*").alias("n"), F.count_if(correct).alias("n_correct"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
