"""Annotations against ground truth: fuzzy names, zones, points by label, and the agreement report."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.points import distance, labelled_points, zone
from tessera.operators.agreement import category_overlap, cohens_kappa, fleiss_kappa, krippendorff_alpha, spatial_agreement
from tessera.operators.filters import enough_overlap, visible_instrument
from tessera.operators.matching import first_per_key
from tessera.operators.metrics import per_class
from tessera.operators.stats import computed_once, percentiles

PAIR_KEYS, RATER_KEYS = 5, 3


def truth_by_frame(truth: DataFrame, annotations: DataFrame, first: int | None = None, fps: int = 2) -> DataFrame:
    """Truth (video_id, frame, ord, ..) with found, the annotations (label, category, x, y) of its frame in order.

    An annotation belongs to frame int(ts * fps). Frames without annotations go; first: only the first frames by ord."""
    of_frame = annotations.withColumn("frame", (F.col("ts") * fps).cast("int")).groupBy("video_id", "frame").agg(F.array_sort(F.collect_list(F.struct("ord", "label", "category", "x", "y"))).alias("found"))
    if first is not None:
        truth = truth.orderBy("ord").limit(first)
    return truth.join(of_frame, ["video_id", "frame"])


def same_instrument(truth: Column, detected: Column, synonyms: dict[str, list[str]], parts: dict[str, list[str]] | None = None) -> Column:
    """A detected label that contains the true name or lies in it; or whose synonyms have one that contains the true name; or
    that has one of the parts listed for the true name."""
    name = F.translate(F.lower(truth), "_", " ")
    label = F.lower(detected)
    hit = label.contains(name) | name.contains(label)
    for general, specific in synonyms.items():
        meant = F.lit(False)
        for s in specific:
            meant = meant | F.lit(s).contains(F.translate(name, " ", "_"))
        hit = hit | ((label == general) & meant)
    for true_name, words in (parts or {}).items():
        some = F.lit(False)
        for w in words:
            some = some | label.contains(w)
        hit = hit | ((name == true_name) & some)
    return hit


def instrument_report(frames: DataFrame, synonyms: dict[str, list[str]], parts: dict[str, list[str]] | None = None) -> DataFrame:
    """J15 of truth_by_frame() rows with instrument1 and position1: (matches, mismatches, accuracy, zone_accuracy), one row.

    Frames without a visible instrument (F4) don't count; a zone is compared for each instrument annotation of a frame with a
    true zone, in the "validator" numbering."""
    rows = frames.where(visible_instrument(F.col("instrument1")))
    tools = F.filter("found", lambda a: a.category == "instruments")
    hit = F.exists(tools, lambda a: same_instrument(F.col("instrument1"), a.label, synonyms, parts))
    zones = F.when(F.coalesce(F.col("position1").cast("string"), F.lit("")) != "", F.filter(tools, lambda a: zone(a.x, a.y, "validator") == F.col("position1")))
    sums = rows.select(hit.alias("hit"), F.when(zones.isNotNull(), F.size(tools)).otherwise(0).alias("asked"), F.coalesce(F.size(zones), F.lit(0)).alias("right"))
    counts = sums.agg(F.count_if("hit").alias("matches"), F.count_if(~F.col("hit")).alias("mismatches"), F.coalesce(F.sum("asked"), F.lit(0)).alias("_asked"), F.coalesce(F.sum("right"), F.lit(0)).alias("_right"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return counts.select("matches", "mismatches", share(F.col("matches"), F.col("matches") + F.col("mismatches")).alias("accuracy"), share(F.col("_right"), F.col("_asked")).alias("zone_accuracy"))


MATCH = "array<struct<label:string,d:double>>"


def point_matches(text: Column, truth: Column) -> Column:
    """A10: for each tag in text the label and distance of the first truth point (x, y, label) whose label contains the tag's or lies in it."""
    low = lambda c: F.lower(F.trim(c))
    either = lambda p, g: low(p.label).contains(F.lower(g.label)) | F.lower(g.label).contains(low(p.label))

    def first(p: Column) -> Column:
        g = F.get(F.filter(truth, lambda g: either(p, g)), F.lit(0))
        return F.when(g.isNotNull(), F.struct(F.lower(g.label).alias("label"), distance(p.x, p.y, g.x, g.y).alias("d")))

    return F.array_compact(F.transform(labelled_points(text), first)).cast(MATCH)


def pointing_scores(df: DataFrame, reach: float = 0.1, text: str = "predicted", truth: str = "points") -> DataFrame:
    """A10: one row: counts, precision (of predicted points), recall (of true ones; one may be matched often, so it can exceed 1),
    F1, and mean and median distance of the matches."""
    rows = computed_once(df, F.size(labelled_points(F.col(text))).alias("p"), F.coalesce(F.size(truth), F.lit(0)).alias("g"), point_matches(F.col(text), F.col(truth)).alias("m"))
    totals = rows.agg(F.count("*").alias("n"), F.sum("p").alias("predicted"), F.sum("g").alias("actual"), F.sum(F.size(F.filter("m", lambda x: x.d < reach))).alias("correct"))
    d = rows.select(F.explode("m").alias("m")).select(F.col("m.d").alias("d"))
    centre = percentiles(d, "d", [], {"median_distance": 0.5})
    means = d.agg(F.avg("d").alias("mean_distance"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = totals.withColumns({"precision": share(F.col("correct"), F.col("predicted")), "recall": share(F.col("correct"), F.col("actual"))})
    a, b = F.col("precision"), F.col("recall")
    return out.withColumn("f1", share(2 * a * b, a + b)).join(means).join(centre.drop("n"), how="left")


def pointing_by_class(df: DataFrame, reach: float = 0.1, text: str = "predicted", truth: str = "points") -> DataFrame:
    """A10: (label, n, accuracy) of the matched true labels."""
    m = df.select(F.explode(point_matches(F.col(text), F.col(truth))).alias("m")).select("m.*")
    return m.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("d") < reach).cast("double")).alias("accuracy"))


def agreement_report(points: DataFrame, sources: list[str], keys: list[str], digits: int = 3) -> DataFrame:
    """A row for each pair of sources, (metric group "pairwise", what "a_vs_b"), and one for all of them; columns that
    a group doesn't have, and metrics of too few common keys, are null. Values are rounded; NaN is null.

    points: (source, *keys, ord, label, category, x, y). The first row of each source and key counts."""
    parts, value = [], lambda c: F.round(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), digits)
    spatial = ("mean_distance", "std_distance", "within_10", "within_15", "zone_agreement", "label_match")
    # one aggregation for all pairs: by key the first row of each source
    first = lambda s: F.min_by(F.when(F.col("source") == s, F.struct("label", "x", "y")), F.when(F.col("source") == s, F.col("ord")))
    wide = points.where(F.col("source").isin(*sources)).groupBy(*keys).agg(*[first(s).alias(f"_{k}") for k, s in enumerate(sources)])
    for (i, a), (j, b) in combinations(enumerate(sources), 2):
        there = wide.where(F.col(f"_{i}").isNotNull() & F.col(f"_{j}").isNotNull())
        both = there.select(*keys, *[F.col(f"_{k}.{c}").alias(f"{c}_{side}") for side, k in (("a", i), ("b", j)) for c in ("label", "x", "y")])
        row = cohens_kappa(both).join(spatial_agreement(both).drop("n"))
        gate = lambda c: enough_overlap(F.col("n"), value(c), PAIR_KEYS).alias(c)
        parts.append(row.select(F.lit(f"{a}_vs_{b}").alias("what"), F.col("n").alias("overlap"), (F.col("n") < PAIR_KEYS).alias("insufficient"), gate("kappa"), *map(gate, spatial)))
    firsts = first_per_key(points.where(F.col("source").isin(*sources)), ["source", *keys])
    full = firsts.groupBy(*keys).agg(F.count("*").alias("_m")).where(F.col("_m") == len(sources)).drop("_m")
    rated = firsts.join(full, keys)
    all_ = fleiss_kappa(rated, keys).join(krippendorff_alpha(rated, keys).drop("n"))
    gate = lambda c: enough_overlap(F.col("units"), value(c), RATER_KEYS).alias(c)
    parts.append(all_.select(F.lit("all").alias("what"), F.col("units").alias("overlap"), (F.col("units") < RATER_KEYS).alias("insufficient"), gate("kappa"), gate("alpha")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def category_report(points: DataFrame, sources: list[str], keys: list[str]) -> DataFrame:
    """category_overlap() of each pair of sources."""
    rows = [category_overlap(points, keys, a, b).withColumn("what", F.lit(f"{a}_vs_{b}")) for a, b in combinations(sources, 2)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def weighted_by_type(df: DataFrame, kind: str, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """By kind, and for all (null): accuracy, and precision, recall and F1 weighted by support."""
    both = df.select(F.explode(F.array(F.struct(F.col(kind).alias("k"), F.lit(False).alias("all")), F.struct(F.lit(None).cast("string").alias("k"), F.lit(True).alias("all")))).alias("g"), F.col(truth).alias("t"), F.col(predicted).alias("p"))
    counts = both.groupBy("g", "t", "p").agg(F.count("*").alias("c"))
    zero, hit = F.lit(0).cast("long"), F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(F.lit(0).cast("long"))
    sides = F.array(F.struct(F.col("t").alias("label"), hit.alias("tp"), zero.alias("fp"), (F.col("c") - hit).alias("fn")), F.struct(F.col("p").alias("label"), zero.alias("tp"), (F.col("c") - hit).alias("fp"), zero.alias("fn")))
    s = counts.select("g", F.explode(sides).alias("s")).select("g", "s.*").groupBy("g", "label").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    weight = tp + fn
    mean = lambda c: F.sum(c * weight) / F.sum(weight)
    out = s.groupBy("g").agg(F.sum(weight).alias("n"), (F.sum("tp") / F.sum(weight)).alias("accuracy"), mean(ratio(tp, tp + fp)).alias("precision"), mean(ratio(tp, tp + fn)).alias("recall"), mean(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"))
    return out.select(F.col("g.k").alias(kind), "n", "accuracy", "precision", "recall", "f1")


def zipped(predictions: DataFrame, truths: DataFrame, ord_: str = "ord") -> DataFrame:
    """Rows of one ord side by side; what has no partner goes."""
    return predictions.join(truths, ord_)


def below(df: DataFrame, edges: DataFrame, parent: str, child: str, name: str) -> DataFrame:
    """Df with the sorted children of its parent as name, an empty array without any."""
    lists = edges.groupBy(F.col(parent).alias("_p")).agg(F.array_sort(F.collect_set(child)).alias(name))
    return df.join(lists, F.col(parent) == F.col("_p"), "left").drop("_p").withColumn(name, F.coalesce(name, F.array().cast(dict(edges.dtypes)[child].join(["array<", ">"]))))


def mean_scores(df: DataFrame, *scores: str) -> DataFrame:
    """The mean of each score, 0 without rows."""
    return df.agg(F.count("*").alias("n"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in scores])


def cleaning_totals(valid: DataFrame, invalid: DataFrame) -> DataFrame:
    """(total, valid, invalid). The true number of invalid rows."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(valid, "valid").join(n(invalid, "invalid")).select((F.col("valid") + F.col("invalid")).alias("total"), "valid", "invalid")


def merged(*results: DataFrame) -> DataFrame:
    """Rule results (check, severity, failed, n_rows) of several passes; of one check the sum."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.groupBy("check", "severity").agg(F.sum("failed").alias("failed"), F.sum("n_rows").alias("n_rows"))


def class_scores(df: DataFrame, labels: list[str]) -> DataFrame:
    """per_class() of rows whose truth is one of labels (F8)."""
    return per_class(df.where(F.col("truth").isin(*labels)))
