"""Agreement between annotators (A1-A8). Counts stay integers up to the last division; undefined values are null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.points import distance, zone


def cohens_kappa(pairs: DataFrame, a: str = "label_a", b: str = "label_b") -> DataFrame:
    """A1: (n, agreeing, kappa) of two label columns."""
    counts = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    sides = counts.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("c").alias("x"), F.lit(0).cast("long").alias("y")), F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("x"), F.col("c").alias("y")))).alias("s")).select("s.*")
    chance = sides.groupBy("label").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).agg(F.sum(F.col("x") * F.col("y")).alias("e"))
    total = counts.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("agreeing"))
    n2, e, o = F.col("n") * F.col("n"), F.col("e"), F.col("agreeing") * F.col("n")
    kappa = F.when(e == n2, F.when(o == n2, 1.0).otherwise(0.0)).otherwise((o - e) / (n2 - e))
    return total.crossJoin(chance).select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("agreeing", F.lit(0)).cast("long").alias("agreeing"), kappa.alias("kappa"))


def _unit_counts(ratings: DataFrame, unit: list[str], label: str) -> DataFrame:
    return ratings.where(F.col(label).isNotNull()).groupBy(*unit, F.col(label).alias("label")).agg(F.count("*").alias("c"))


def fleiss_kappa(ratings: DataFrame, unit: list[str], label: str = "label") -> DataFrame:
    """A2: (units, kappa) where every unit has the same number of ratings."""
    counts = _unit_counts(ratings, unit, label)
    units = counts.groupBy(*unit).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q")).agg(F.count("*").alias("units"), F.max("m").alias("m"), F.sum("q").alias("q"))
    shares = counts.groupBy("label").agg(F.sum("c").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("s2"))
    n, m = F.col("units").cast("double"), F.col("m").cast("double")
    observed, chance = (F.col("q") - n * m) / (n * m * (m - 1)), F.col("s2") / (n * m * n * m)
    kappa = F.when(m > 1, F.when(chance == 1, F.when(observed == 1, 1.0).otherwise(0.0)).otherwise((observed - chance) / (1 - chance)))
    return units.crossJoin(shares).select("units", kappa.alias("kappa"))


def krippendorff_alpha(ratings: DataFrame, unit: list[str], label: str = "label", level: str = "nominal") -> DataFrame:
    """A3: (n, alpha) over units of two ratings or more. Observed disagreement is the mean over all pairs, unweighted.

    level "interval" takes label as a number; other levels are nominal."""
    counts = _unit_counts(ratings, unit, label)
    if level == "interval":
        v = F.col("label").cast("double")
        of_unit = counts.groupBy(*unit).agg(F.sum("c").alias("m"), F.sum(F.col("c") * v).alias("s"), F.sum(F.col("c") * v * v).alias("q")).where("m > 1")
        sums = of_unit.agg(F.sum("m").alias("n"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs"), F.sum(F.col("m") * F.col("q") - F.col("s") * F.col("s")).alias("d"), F.sum("s").alias("s"), F.sum("q").alias("q"))
        observed, chance = F.col("d") / F.col("pairs"), 2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1))
        alpha = F.when(chance == 0, F.when(observed == 0, 1.0).otherwise(0.0)).otherwise(1 - observed / chance)
        return sums.select(F.coalesce("n", F.lit(0)).alias("n"), alpha.alias("alpha"))
    kept = counts.join(counts.groupBy(*unit).agg(F.sum("c").alias("m")).where("m > 1"), unit)
    pairs = kept.groupBy(*unit).agg(F.first("m").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).agg(F.sum("m").alias("n"), F.sum(F.col("m") * (F.col("m") - 1)).alias("pairs"), F.sum("same").alias("same"))
    shares = kept.groupBy("label").agg(F.sum("c").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.count("*").alias("labels"))
    n = F.col("n")
    observed, chance = (F.col("pairs") - F.col("same")) / F.col("pairs"), (n * n - F.col("s2")) / (n * (n - 1))
    alpha = F.when(F.col("labels") == 1, 1.0).when(chance == 0, F.when(observed == 0, 1.0).otherwise(0.0)).otherwise(1 - observed / chance)
    return pairs.crossJoin(shares).select(F.coalesce(n, F.lit(0)).cast("long").alias("n"), alpha.alias("alpha"))


def spatial_agreement(pairs: DataFrame, scheme: str = "generator") -> DataFrame:
    """A4-A6 of pairs (x_a, y_a, x_b, y_b, label_a, label_b)."""
    x = {k: F.col(k) for k in ("x_a", "y_a", "x_b", "y_b")}
    d = distance(x["x_a"], x["y_a"], x["x_b"], x["y_b"])
    same = zone(x["x_a"], x["y_a"], scheme) == zone(x["x_b"], x["y_b"], scheme)
    share = lambda c: F.avg(c.cast("double"))
    return pairs.withColumn("d", d).agg(F.count("*").alias("n"), F.avg("d").alias("mean_distance"), F.stddev_pop("d").alias("std_distance"), share(F.col("d") <= 10).alias("within_10"), share(F.col("d") <= 15).alias("within_15"), share(same).alias("zone_agreement"), share(F.col("label_a") == F.col("label_b")).alias("label_match"))


def category_overlap(points: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """By category the points of each source, all of them, and the keys that both have."""
    of = lambda s: F.sum(F.when(F.col("source") == s, 1).otherwise(0))
    by_key = points.where(F.col("source").isin(a, b)).groupBy("category", *keys).agg(of(a).alias("p"), of(b).alias("q"))
    return by_key.groupBy("category").agg(F.sum("p").alias("points_a"), F.sum("q").alias("points_b"), F.sum(F.when((F.col("p") > 0) & (F.col("q") > 0), 1).otherwise(0)).alias("overlap"))
