"""Joins by time and space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], ord_: str = "ord") -> DataFrame:
    """The row of each key with the smallest ord; one aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(ord_)).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in rest])


def last_per_key(df: DataFrame, keys: list[str], ord_: str = "ord") -> DataFrame:
    """Later rows replace earlier ones."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ord_)).alias("_r")).select(*keys, "_r.*")


def pairwise_overlap(points: DataFrame, a: str, b: str, keys: list[str], columns: list[str]) -> DataFrame:
    """First rows of two sources side by side, on common keys; columns get the suffixes _a and _b. One pass
    over the rows: a conditional aggregation by key in place of a self-join."""
    of = lambda s: F.min_by(F.when(F.col("source") == s, F.struct(*columns)), F.when(F.col("source") == s, F.col("ord")))
    both = points.where(F.col("source").isin(a, b)).groupBy(*keys).agg(of(a).alias("_a"), of(b).alias("_b")).where("_a is not null and _b is not null")
    return both.select(*keys, *[F.col(f"_{s}")[c].alias(f"{c}_{s}") for s in "ab" for c in columns])


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, payload: list[str], tie: str) -> DataFrame:
    """Left with the payload of the last right row of the same key at or before its time, null before the first.

    Both sides go through one sort by key and time; right rows stand first among equals, ties go to the largest tie."""
    carried = F.struct(*payload)
    l_ = left.select(*by, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), F.struct(*left.columns).alias("_left"))
    r = right.select(*by, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"), carried.alias("_right"))
    order = Window.partitionBy(*by).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = l_.unionByName(r, allowMissingColumns=True).withColumn("_last", F.last("_right", ignorenulls=True).over(order))
    return both.where("_side = 1").select("_left.*", *[F.col("_last")[c].alias(c) for c in payload])


def intervals(timeline: DataFrame, by: list[str], start: str, tie: str) -> DataFrame:
    """Rows with the column end, the next row's start (null for the last)."""
    return timeline.withColumn("end", F.lead(start).over(Window.partitionBy(*by).orderBy(start, tie)))


def interval_join(left: DataFrame, timeline: DataFrame, by: list[str], time: str, start: str, payload: list[str], tie: str) -> DataFrame:
    """J5 by the as-of join, which gives the same on sorted timelines without a range join."""
    return asof(left, timeline.withColumnRenamed(start, time), by, time, payload, tie)


def tolerance_lookup(wanted: DataFrame, frames: DataFrame, by: list[str], reach: int = 2) -> DataFrame:
    """For each (by, frame) wanted the exact frame, else the first found scanning from -reach to +reach; null if none.

    Wanted frames are spread to the 2 reach + 1 frames that would do, so the join is an equi-join."""
    spread = wanted.withColumn("_d", F.explode(F.array(*[F.lit(d) for d in range(-reach, reach + 1)]))).withColumn("found", F.col("frame") + F.col("_d"))
    there = frames.select(*by, F.col("frame").alias("found")).distinct()
    hits = spread.join(there, [*by, "found"], "left_semi")
    best = hits.groupBy(*by, "frame").agg(F.min_by("found", F.when(F.col("_d") == 0, -reach - 1).otherwise(F.col("_d"))).alias("found"))
    return wanted.join(best, [*by, "frame"], "left")


def _d(p: Column, q: Column) -> Column:
    return F.sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)


POINT = "struct<x:double,y:double,label:string,confidence:double>"
PAIR = "array<struct<l:int,r:int,score:double>>"


def greedy_pairs(left: Column, right: Column, reach: float = 5.0) -> Column:
    """Left points in order take the nearest unused right point within reach; ties go to the first.

    score = 1 - d / reach, and 0.2 more (1 at most) for equal labels. A fold over the left array."""

    def step(pairs: Column, i: Column) -> Column:
        p = F.get(left, i)
        free = F.filter(F.sequence(F.lit(0), F.size(right) - 1), lambda j: ~F.exists(pairs, lambda m: m.r == j) & (_d(p, F.get(right, j)) < reach))
        best = F.array_min(F.transform(free, lambda j: F.struct(_d(p, F.get(right, j)).alias("d"), j.alias("j"))))
        q = F.get(right, best.j)
        score = F.least(F.lit(1.0), 1 - best.d / reach + F.when(F.lower(p.label) == F.lower(q.label), 0.2).otherwise(0.0))
        new = F.array(F.struct(i.alias("l"), best.j.alias("r"), score.alias("score"))).cast(PAIR)
        return F.when(best.isNotNull(), F.concat(pairs, new)).otherwise(pairs)

    places = F.when((F.size(left) > 0) & (F.size(right) > 0), F.sequence(F.lit(0), F.size(left) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.array().cast(PAIR), step)


def consensus(left: Column, right: Column, tiebreak: Column, reach: float = 5.0, agreed: float = 0.8, sure: float = 0.9) -> dict[str, Column]:
    """J8-J10: "pairs", "needs_tiebreak", "points" and "method" of a frame with two annotators and an optional third."""
    pairs = greedy_pairs(left, right, reach)
    empty = F.array().cast(f"array<{POINT}>")
    mid = lambda m: ((F.get(left, m.l).x + F.get(right, m.r).x) / 2, (F.get(left, m.l).y + F.get(right, m.r).y) / 2)
    differ = lambda m: F.lower(F.get(left, m.l).label) != F.lower(F.get(right, m.r).label)

    def third(m: Column) -> Column:
        x, y = mid(m)
        return F.get(F.filter(tiebreak, lambda t: F.sqrt((t.x - x) ** 2 + (t.y - y) ** 2) < reach), F.lit(0))

    def emitted(m: Column) -> Column:
        x, y = mid(m)
        both = F.struct(x.alias("x"), y.alias("y"), F.get(left, m.l).label.alias("label"), m.score.alias("confidence"))
        return F.when(m.score >= agreed, both).when(tiebreak.isNotNull() & differ(m), third(m))

    kept = F.filter(F.transform(pairs, emitted), lambda p: p.isNotNull())
    add = lambda acc, p: F.when((p.confidence > sure) & ~F.exists(acc, lambda q: _d(p, q) < reach), F.concat(acc, F.array(p).cast(f"array<{POINT}>"))).otherwise(acc)
    points = F.aggregate(F.concat(left, right).cast(f"array<{POINT}>"), F.coalesce(kept.cast(f"array<{POINT}>"), empty), add)
    used = F.exists(pairs, lambda m: (m.score < agreed) & differ(m) & third(m).isNotNull()) & tiebreak.isNotNull()
    return {"pairs": pairs, "needs_tiebreak": F.exists(pairs, lambda m: m.score < agreed), "points": points, "method": F.when(used, "tiebreaker").otherwise("unanimous")}


def sequential_dedup(points: Column, reach: float, least: float, axis: tuple[str, ...] = ("x", "y")) -> Column:
    """Points by falling confidence; those under least go, and those within reach of the last one kept."""
    order = F.array_sort(F.filter(points, lambda p: p.confidence >= least), lambda a, b: F.when(a.confidence > b.confidence, -1).when(a.confidence < b.confidence, 1).when(a.ord < b.ord, -1).when(a.ord > b.ord, 1).otherwise(0))
    away = lambda p, q: F.sqrt(sum(((p[k] - q[k]) ** 2 for k in axis), F.lit(0.0)))
    return F.aggregate(F.slice(order, 2, F.greatest(F.size(order), F.lit(1))), F.slice(order, 1, 1), lambda acc, p: F.when(away(p, F.element_at(acc, -1)) < reach, acc).otherwise(F.concat(acc, F.array(p))))


def contained_match(points: Column, truth: Column, reach: float) -> Column:
    """Number of predicted points whose first truth of a matching label lies within reach."""
    a_b = lambda p, g: (F.length(g.label) > 0) & (F.length(p.label) > 0) & (F.lower(p.label).contains(F.lower(g.label)) | F.lower(g.label).contains(F.lower(p.label)))
    first = lambda p: F.get(F.filter(truth, lambda g: a_b(p, g)), F.lit(0))
    return F.size(F.filter(points, lambda p: F.coalesce(_d(p, first(p)) < reach, F.lit(False))))


def by_ordinal(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the right row with the same ord take the place of the left's, nulls included."""
    r = right.select("ord", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    put = {c: F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c) if c in left.columns else F.lit(None)) for c in columns}
    return left.join(r, "ord", "left").withColumns(put).drop("_there", *[f"_{c}" for c in columns])


def unseen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """J16."""
    return df.join(seen.select(*keys), keys, "left_anti")


def leaks(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that occur in several splits."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)
