"""Exact-size sampling, balancing and splitting (R1-R12, W2, W7-W12). Draws are ranks of md5(id, seed), so they don't
depend on partitions and repeat on every run. Global ranks go through counts by hash range, not one sorted task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 2  # hex digits of the hash that deal rows to 256 ranges


def draw(key: Column, seed: str = "42") -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def choice(options: Column, key: Column, seed: str) -> Column:
    """One of an array of options by a hash of key, null of an empty one."""
    at = F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("long") % F.greatest(F.size(options), F.lit(1))
    return F.get(options, at.cast("int"))


def _on(a: str, b: str, keys: list[str]) -> Column:
    """Equality of keys, null keys being equal."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def hash_rank(df: DataFrame, key: str, groups: list[str], seed: str = "42", name: str = "rank") -> DataFrame:
    """df with the rank (from 1) of each row by hash within its group.

    Rows are ranked within ranges of the hash and moved by the counts of the ranges before: a group of any size is
    spread over 256 tasks."""
    rows = df.withColumn("_h", draw(F.col(key), seed)).withColumn("_r", F.substring("_h", 1, PREFIX))
    sizes = rows.groupBy(*groups, "_r").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(*groups, "_r").orderBy("_h", key))
    keys = [*groups, "_r"]
    left, right = rows.alias("a"), sizes.withColumn("_before", before).drop("_n").alias("b")
    joined = left.join(right, _on("a", "b", keys)).select("a.*", "b._before")
    return joined.withColumn(name, own + F.col("_before")).drop("_h", "_r", "_before")


def sample_by_rate(df: DataFrame, key: str, stratum: str, rates: dict[str, float], seed: str = "42") -> DataFrame:
    """Of each stratum max(1, int(n * rate)) rows, none of an empty one. A stratum without a rate gives one row; null is
    a stratum like any other."""
    rate = F.coalesce(*[F.when(F.col(stratum) == k, F.lit(r)) for k, r in rates.items()], F.lit(0.0))
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size")).withColumn("_take", F.greatest(F.lit(1), F.floor(F.col("_size") * rate)))
    ranked = hash_rank(df, key, [stratum], seed).alias("a").join(sizes.alias("b"), _on("a", "b", [stratum]))
    return ranked.where("rank <= _take").select("a.*").drop("rank")


def ratio_counts(available: dict[str, int], ratios: dict[str, float]) -> dict[str, int]:
    """R2: how many rows of each task make the largest total with these ratios."""
    most = min(available.get(k, 0) / r for k, r in ratios.items() if r > 0)
    return {k: int(int(most) * r) for k, r in ratios.items()}


def balance_by_ratio(df: DataFrame, key: str, task: str, ratios: dict[str, float], seed: str = "42") -> DataFrame:
    """R2; the driver sees one count a task."""
    available = {r[0]: r[1] for r in df.where(F.col(task).isin(*ratios)).groupBy(task).count().collect()}
    take = ratio_counts(available, ratios)
    most = F.coalesce(*[F.when(F.col(task) == k, F.lit(n)) for k, n in take.items()])
    return hash_rank(df.where(F.col(task).isin(*ratios)), key, [task], seed).where(F.col("rank") <= most).drop("rank")


def balance_to_least(df: DataFrame, key: str, kind: str, seed: str = "42") -> DataFrame:
    """As many rows of each kind as the smallest has."""
    least = df.groupBy(kind).agg(F.count("*").alias("n")).agg(F.min("n").alias("_least"))
    return hash_rank(df, key, [kind], seed).join(F.broadcast(least)).where("rank <= _least").drop("rank", "_least")


def split_of_rank(rank: Column, n: Column, shares: tuple[float, float, float]) -> Column:
    """train, validation or test: int(n * share) each, the rest to test."""
    a = F.floor(n * F.lit(shares[0]))
    b = F.floor(n * F.lit(shares[1]))
    return F.when(rank <= a, "train").when(rank <= a + b, "validation").otherwise("test")


def group_split(df: DataFrame, group: str, shares: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: str = "42") -> DataFrame:
    """Df with a split that no group shares with another. Rows without a group are a group."""
    if abs(sum(shares) - 1) > 1e-6:
        raise ValueError("shares must add up to 1")
    groups = df.select(group).distinct()
    n = groups.agg(F.count("*").alias("_n"))
    split = hash_rank(groups, group, [], seed).join(F.broadcast(n)).select(group, split_of_rank(F.col("rank"), F.col("_n"), shares).alias("split"))
    return df.alias("a").join(split.alias("b"), _on("a", "b", [group])).select("a.*", "b.split")


def row_split(df: DataFrame, key: str, shares: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: str = "42") -> DataFrame:
    """R5, R6, W7."""
    n = df.agg(F.count("*").alias("_n"))
    return hash_rank(df, key, [], seed).join(F.broadcast(n)).withColumn("split", split_of_rank(F.col("rank"), F.col("_n"), shares)).drop("rank", "_n")


def coin(key: Column, seed: str) -> Column:
    """Half of the keys."""
    return F.conv(F.substring(draw(key, seed), 1, 1), 16, 10).cast("int") % 2 == 0


def every_nth(df: DataFrame, by: list[str], time: str, n: int = 10, ord_: str = "ord") -> DataFrame:
    """Rows of every nth distinct time of each group, the first row of each."""
    first = df.groupBy(*by, time).agg(F.min_by(F.struct(*[c for c in df.columns if c not in (*by, time)]), ord_).alias("_row"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(time))
    kept = first.withColumn("_k", place).where((F.col("_k") - 1) % n == 0)
    return kept.select(*by, time, "_row.*")


def first_n(df: DataFrame, by: list[str], n: int, ord_: str = "ord") -> DataFrame:
    """W10, with the rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(ord_))).where(F.col("rank") <= n)


def qa_slots(kinds: list[str], slots: int = 8) -> dict[str, int]:
    """Slots // kinds each, what is left to the first kinds."""
    each, more = divmod(slots, len(kinds)) if kinds else (0, 0)
    return {k: each + (i < more) for i, k in enumerate(kinds)}


def integrity_sample(df: DataFrame, key: str, n: int = 100, seed: str = "42") -> DataFrame:
    """N rows by hash."""
    return df.orderBy(draw(F.col(key), seed), key).limit(n)


def fixed_split(df: DataFrame, group: str, validation: list) -> DataFrame:
    """The listed groups to validation, all others to train."""
    return df.withColumn("split", F.when(F.col(group).isin(*validation), "validation").otherwise("train"))


def uniform_places(n: int, k: int) -> list[int]:
    """int(linspace(0, n - 1, k))."""
    return [i * (n - 1) // (k - 1) for i in range(k)] if k > 1 else [0] * k
