"""Operators made for large groups: exact quantiles, spatial matching, cells of vectors, scores of texts, each against its plain form."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import text as T
from tessera.functions.vectors import similarity
from tessera.operators import cells, grid, matching, search, stats

SF = "/root/testdata/sf0.01"


def test_ranges_of_heavy_tails(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(0, 4, 30_000), [1e12], np.full(500, 2.5), rng.normal(size=200)]).tolist()
    df = spark.createDataFrame([(float(v), "a" if k % 3 else None) for k, v in enumerate(values)], "v double, g string")
    counts = df.groupBy("g", F.col("v").alias("_v")).agg(F.count("*").alias("_c"))
    sizes = [r["n"] for r in stats.value_ranges(counts, ["g"]).groupBy("g", "_r").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1500 and max(sizes) <= 2 * sum(sizes) / len(sizes) + 2
    shares = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    found = {r.g: r for r in stats.percentiles(df, "v", ["g"], shares).collect()}
    for g in ("a", None):
        own = [v for k, v in enumerate(values) if ("a" if k % 3 else None) == g]
        assert found[g].n == len(own)
        for name, q in shares.items():
            assert found[g][name] == pytest.approx(float(np.quantile(own, q)), rel=1e-12)


def test_ranges_are_cut_once(spark):
    """Sketches merged in another order give other cuts, so the ranks within ranges and those before them must not have a sketch each."""
    df = spark.range(200).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = stats.percentiles(df, "v", ["g"], {"p50": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan


# Spatial matching


def greedy(left, right, reach):
    used, out = set(), []
    for i, (x, y, label) in enumerate(left):
        near = [(math.dist((x, y), q[:2]), j) for j, q in enumerate(right) if j not in used and math.dist((x, y), q[:2]) < reach]
        if near:
            d, j = min(near)
            used.add(j)
            out.append((i, j, min(1.0, 1 - d / reach + (0.2 if label.lower() == right[j][2].lower() else 0))))
    return out


def test_greedy_rows_are_those_of_the_fold(spark):
    rng = random.Random(4)
    point = lambda: (rng.randint(-20, 20) / 2, rng.randint(-20, 20) / 2, rng.choice(["A", "a", "b"]))  # noqa: E731  many ties
    frames = {(u, v): ([point() for _ in range(rng.randint(0, 25))], [point() for _ in range(rng.randint(0, 25))]) for u in (1, 2, None) for v in ("x", None)}
    rows = [[(*key, i, *p) for key, f in frames.items() for i, p in enumerate(f[side])] for side in (0, 1)]
    left, right = (spark.createDataFrame(r, "u long, v string, ord int, x double, y double, label string") for r in rows)
    found = {}
    for r in grid.greedy_rows(left, right, ["u", "v"], 2.5).collect():
        found.setdefault((r.u, r.v), []).append((r.l, r.r, r.score))
    assert {k: sorted(v) for k, v in found.items()} == {k: [(i, j, pytest.approx(s)) for i, j, s in g] for k, f in frames.items() if (g := greedy(*f, 2.5))}
    arrays = spark.createDataFrame([([(*p, 0.9) for p in a], [(*p, 0.9) for p in b]) for a, b in frames.values()], "l array<struct<x:double,y:double,label:string,confidence:double>>, r array<struct<x:double,y:double,label:string,confidence:double>>")
    folded = sorted((m.l, m.r, round(m.score, 9)) for r in arrays.select(matching.greedy_pairs(F.col("l"), F.col("r"), 2.5).alias("p")).collect() for m in r.p)
    assert folded == sorted((i, j, round(s, 9)) for v in found.values() for i, j, s in v)
    assert grid.greedy_rows(left.limit(0), right, ["u", "v"]).count() == 0


def test_a_large_frame(spark):
    rng = np.random.default_rng(2)
    n = 10_000
    side = lambda: [(1, i, float(x), float(y), "a") for i, (x, y) in enumerate(rng.uniform(0, 1000, (n, 2)))]
    a, b = side(), side()
    left, right = (spark.createDataFrame(r, "f int, ord int, x double, y double, label string") for r in (a, b))
    began = time.perf_counter()
    found = {(r.l, r.r) for r in grid.greedy_rows(left, right, ["f"], 5.0).collect()}
    assert time.perf_counter() - began < 90
    taken, wanted = set(), set()
    at = np.array([q[2:4] for q in b])
    for _, i, x, y, _ in a:
        d = np.hypot(at[:, 0] - x, at[:, 1] - y)
        for j in np.argsort(d, kind="stable").tolist():
            if d[j] >= 5.0:
                break
            if j not in taken:
                taken.add(j)
                wanted.add((i, j))
                break
    assert found == wanted


def test_sequential_dedup_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", None, "b"]), rng.randint(0, 9) / 10, i, rng.uniform(0, 3), rng.uniform(0, 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, confidence double, ord int, x double, y double").repartition(7)
    wanted = set()
    for g in ("a", "b", None):
        last = None
        for _, c, i, x, y in sorted((r for r in rows if r[0] == g and r[1] >= 0.3), key=lambda r: (-r[1], r[2])):
            if last is None or math.dist(last, (x, y)) >= 0.8:
                last = (x, y)
                wanted.add((g, i))
    assert {(r.g, r.ord) for r in grid.sequential_dedup_rows(df, ["g"], 0.8, 0.3).collect()} == wanted


# Top-k search


def plain_top_k(index, queries, k, metric):
    """All pairs, scored by column expressions."""
    pairs = index.select("vec_id", F.col("embedding").alias("v")).crossJoin(queries.select("query_id", F.col("embedding").alias("q")))
    scored = pairs.select("query_id", "vec_id", similarity(F.col("q"), F.col("v"), metric).alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dot"])
def test_top_k_of_odd_vectors(spark, monkeypatch, metric):
    """Copies, near copies, vectors of nothing, null, other lengths, components that are null, tiny, huge or not finite; many blocks and tiles."""
    monkeypatch.setattr(search, "BLOCK_BYTES", 8 * 6 * 100)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 6)).astype(np.float32).astype(float)
    x[100:180] = x[7]
    x[180:200] = x[7] + rng.choice([0, 1e-16, 1e-15], size=(20, 6))
    x[200:210] = 0
    x[210:215] *= 1e-170
    x[215:220] *= 1e170
    x[220, 2], x[221, 3], x[222, 0] = math.nan, math.inf, -math.inf
    vectors = [*x.tolist(), None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [2.0, 2.5], [], *(-x[:5]).tolist()]
    index = spark.createDataFrame([(1000 - i if i % 2 else i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    queries = index.where("vec_id % 10 = 0 or vec_id between 204 and 225 or vec_id < 12 or vec_id > 690 and vec_id < 710 or vec_id between 770 and 800").withColumnRenamed("vec_id", "query_id")
    found, wanted = (sorted((r.query_id, r["rank"], r.vec_id, repr(r.similarity)) for r in df.collect()) for df in (search.top_k_join(index, queries, 5, metric), plain_top_k(index, queries, 5, metric)))
    assert len(found) == 5 * queries.count() and found == wanted


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dot"])
def test_top_k_of_many_pairs(spark, metric):
    """48 million pairs, which column expressions score at a few million a second."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(24_000, 32)).astype(np.float32)
    index = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": [*x]})).repartition(4)
    queries = index.where("vec_id % 12 = 0").withColumnRenamed("vec_id", "query_id")
    began = time.perf_counter()
    found = search.top_k_join(index, queries, 3, metric).toPandas().sort_values(["query_id", "rank"])
    assert time.perf_counter() - began < 25
    y = x.astype(float)
    scores = {"dot": y[::12] @ y.T, "cosine": (y / np.sqrt((y * y).sum(1))[:, None])[::12] @ (y / np.sqrt((y * y).sum(1))[:, None]).T, "euclidean": 2 * y[::12] @ y.T - (y * y).sum(1)}[metric]
    best = np.argpartition(-scores, 3, axis=1)[:, :3]
    assert [set(g) for g in found["vec_id"].to_numpy().reshape(-1, 3).tolist()] == [set(g) for g in best.tolist()]


# Cells of vectors


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dot"])
def test_cells(spark, tmp_path, metric):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 5
    x = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 8)) * 0.3
    x[5] = 0
    x[7] = x[8] = x[9]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.round(3).tolist())] + [(9999, None)], "vec_id long, embedding array<double>")
    index = cells.CellIndex.build(rows, str(tmp_path / "index"), metric, cells=40)
    queries = rows.where("vec_id % 60 = 5 or vec_id = 7").select(F.col("vec_id").alias("query_id"), "embedding")
    good = rows.where("embedding is not null")
    for use in (index, cells.CellIndex.load(spark, str(tmp_path / "index"))):
        assert use.metric == metric
        found = sorted((r.query_id, r.rank, r.vec_id, r.similarity) for r in use.search(queries, 6).collect())
        wanted = sorted((r.query_id, r.rank, r.vec_id, r.similarity) for r in search.top_k_join(good, queries, 6, metric).collect())
        assert [x[:3] for x in found] == [x[:3] for x in wanted] and [x[3] for x in found] == pytest.approx([x[3] for x in wanted], abs=1e-9)
        share = use.scanned.first()
        assert share.all_rows == 1500 * queries.count() and 0 < share.met < 0.9 * share.all_rows
    more = index.search(queries.limit(2), 2000, first=1)
    assert more.count() == 2 * 1500


def test_cells_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([], "vec_id long, embedding array<double>")
    index = cells.CellIndex.build(rows, str(tmp_path / "none"))
    assert index.search(spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")).count() == 0
    with pytest.raises(FileNotFoundError):
        cells.CellIndex.load(spark, str(tmp_path / "missing"))


# Scores of texts


def brute_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_length():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (rng.choices("abcde", k=rng.randint(0, 40)) for _ in range(2))
        assert T.common_length(a, b) == brute_length(a, b)
    long = [str(rng.randint(0, 500)) for _ in range(20_000)]
    began = time.perf_counter()
    T.common_length(long[:10_000], long[10_000:])
    assert time.perf_counter() - began < 3


def test_rouge_by_turn(spark):
    found = {(r.conv_id, r.turn): r.rouge_l for r in catalog.queries()["rouge_by_turn"](spark, SF).collect()}
    turns = {(r.conv_id, r.turn): re.findall("[a-z0-9]+", (r.text or "").lower()) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    wanted = {(c, t): 2 * brute_length(a, b) / (len(a) + len(b)) if a and (b := turns[c, t + 1]) else 0.0 for (c, t), a in turns.items() if (c, t + 1) in turns}
    assert found == {k: pytest.approx(v, abs=1e-6) for k, v in wanted.items()}


def test_bleu_by_aggregation(spark):
    rng = random.Random(3)
    texts = [(k, *(" ".join(rng.choices(["a", "b", "c", "The", "the"], k=rng.randint(0, 12))) for _ in range(2))) for k in range(60)] + [(60, None, "a b"), (61, "a  b", None)]
    df = spark.createDataFrame(texts, "k long, x string, y string")
    hits = T.ngram_hits(df, "k", "x", "y")
    found = {r.k: (r.bleu_1, r.bleu_2, r.bleu_4) for r in T.sentence_bleu(hits, "k", (1, 2, 4)).collect()}
    plain = df.select("k", *[T.bleu(F.coalesce("x", F.lit("")), F.coalesce("y", F.lit("")), n).alias(f"b{n}") for n in (1, 2, 4)]).collect()
    assert found == {r.k: pytest.approx((r.b1, r.b2, r.b4), abs=1e-12) for r in plain}
    long = spark.createDataFrame([(1, " ".join(f"w{i % 700}" for i in range(10_000)), " ".join(f"w{i % 650}" for i in range(9_000)))], "k long, x string, y string")
    assert 0 < T.corpus_bleu(T.ngram_hits(long, "k", "x", "y")).first().bleu_4 < 1


def test_ngrams_are_counted_in_place(spark, monkeypatch):
    """Counts by Counter, rows cut into pieces of any size, and no exchange or buffer of n-grams."""
    monkeypatch.setattr(T, "GRAM_WORDS", 40)
    rng = random.Random(6)
    texts = [(k, *(" ".join(rng.choices("abcd", k=rng.choice([0, 1, 3, 4, 9, 70]))) for _ in range(2))) for k in range(200)]
    hits = T.ngram_hits(spark.createDataFrame(texts, "k long, x string, y string"), "k", "x", "y", 3)
    grams = lambda t, n: Counter(zip(*(t.split()[j:] for j in range(n))))
    wanted = {k: (*((grams(x, n) & grams(y, n)).total() for n in (1, 2, 3)), *(grams(x, n).total() for n in (1, 2, 3)), len(y.split())) for k, x, y in texts}
    assert {r[0]: tuple(r[1:]) for r in hits.collect()} == wanted
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


# Merged annotators


def test_merged_annotators(spark):
    found = {r.ord: r for r in catalog.queries()["merged_annotators"](spark, SF).collect()}
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("double").alias("x"), (F.col("value") % 100).alias("y")).collect()
    assert len(found) == len(events)
    for e in events:
        points = [(-e.y / 100, "copier", 0, e.x)] + ([] if e.event_type == "error" else [(-0.6, "picky", 0, e.x + 1), (-0.4, "picky", 1, e.x + 10)])
        kept = []
        for c, name, _, x in sorted(p for p in points if -p[0] >= 0.3):
            if not kept or abs(kept[-1][2] - x) >= 3.0:
                kept.append((-c, name, x))
        r = found[e.event_id]
        assert (r.annotators, r.errors, r.n) == ((1, 1) if e.event_type == "error" else (2, 0)) + (len(kept),)
        assert (r.annotator, r.x, r.confidence) == ((kept[0][1], pytest.approx(kept[0][2], abs=1e-6), pytest.approx(kept[0][0], abs=1e-6)) if kept else (None, None, None))
