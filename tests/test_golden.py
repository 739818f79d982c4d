"""Golden cases of FIXTURES.md and boundary cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import points as P
from tessera.functions import rewards as R
from tessera.functions import text as T
from tessera.operators import agreement, generate, matching, metrics, sampling, search, stats
from tessera.sources import readers, writers
from tessera.streaming import ingest

POINT = "array<struct<x:double,y:double,label:string,confidence:double>>"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("x", "y", "a", "b", "q"), [(40, 40, 5, 3, "TL"), (35, 35, 1, 3, "TL"), (50, 50, 5, 3, "BR"), (60, 60, 5, 3, "BR"), (66, 66, 4, 3, "BR"), (67, 50, 4, 5, "BR"), (49.9, 70, 3, 4, "BL")])
def test_zones(spark, x, y, a, b, q):
    at = F.lit(float(x)), F.lit(float(y))
    assert [value(spark, P.zone(*at, s)) for s in ("generator", "validator", "quadrant")] == [a, b, q]


def test_cohen(spark):
    of = lambda rows: agreement.cohens_kappa(spark.createDataFrame(rows, "label_a string, label_b string")).first()
    assert of([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")]).kappa == 0.5
    assert of([("a", "a"), ("a", "a")]).kappa == 1.0
    assert of([]).kappa is None


def test_spatial(spark):
    r = agreement.spatial_agreement(spark.createDataFrame([(0.0, 0.0, 6.0, 8.0, "a", "a"), (0.0, 0.0, 9.0, 12.0, "a", "b")], "x_a double, y_a double, x_b double, y_b double, label_a string, label_b string")).first()
    assert (r.mean_distance, r.std_distance, r.within_10, r.within_15, r.label_match) == (12.5, 2.5, 0.5, 1.0, 0.5)


def test_multi_rater(spark):
    rows = [(u, x) for u, unit in enumerate(["aae", "abc", "bcd", "dfg"]) for x in unit]
    df = spark.createDataFrame(rows, "u int, label string")
    assert agreement.krippendorff_alpha(df, ["u"]).first().alpha == pytest.approx(-0.0083333, abs=1e-6)
    assert agreement.fleiss_kappa(df, ["u"]).first().kappa == pytest.approx(-0.1)


def test_ratio_balance():
    ratios = {"phase": 0.25, "step": 0.25, "instrument": 0.35, "anatomy": 0.15}
    many = {k: 10**6 for k in ratios}
    assert list(sampling.ratio_counts(many | {"anatomy": 716}, ratios).values())[:3] == [1193, 1193, 1670]
    assert list(sampling.ratio_counts(many | {"anatomy": 62}, ratios).values())[:3] == [103, 103, 144]


def test_asof(spark):
    left = spark.createDataFrame([(1, t) for t in (-1, 0, 9, 10, 24, 25, 99)], "v int, t int")
    right = spark.createDataFrame([(1, 0, "A", 1), (1, 10, "B", 2), (1, 25, "C", 3)], "v int, t int, step string, tie int")
    found = {r.t: r.step for r in matching.asof(left, right, ["v"], "t", ["step"], "tie").collect()}
    assert found == {-1: None, 0: "A", 9: "A", 10: "B", 24: "B", 25: "C", 99: "C"}


@pytest.mark.parametrize(("frames", "wanted"), [([9, 11, 12], 9), ([8, 11], 8), ([10, 8], 10), ([13], None)])
def test_tolerance(spark, frames, wanted):
    df = matching.tolerance_lookup(spark.createDataFrame([(1, 10)], "v int, frame int"), spark.createDataFrame([(1, f) for f in frames], "v int, frame int"), ["v"])
    assert df.first().found == wanted


def test_consensus(spark):
    left = [(45.0, 62.0, "forceps", 0.95), (10.0, 10.0, "curette", 0.95), (80.0, 80.0, "tumor", 0.6)]
    right = [(46.0, 62.0, "forceps", 0.9), (12.0, 10.0, "drill", 0.8), (30.0, 30.0, "dura", 0.95)]
    rows = [(left, right, None), (left, right, [(11.5, 10.2, "drill", 0.9)]), ([(0.0, 0.0, "a", 0.1)], [(3.0, 4.0, "a", 0.1)], None)]
    df = spark.createDataFrame(rows, f"l {POINT}, r {POINT}, t {POINT}")
    plain, broken, far = df.select(*[c.alias(k) for k, c in matching.consensus(F.col("l"), F.col("r"), F.col("t")).items()]).collect()
    assert [round(p.score, 6) for p in plain.pairs] == [1.0, 0.6] and plain.needs_tiebreak
    assert [(p.x, p.label) for p in plain.points] == [(45.5, "forceps"), (10.0, "curette"), (30.0, "dura")] and plain.method == "unanimous"
    assert [p.label for p in broken.points] == ["forceps", "drill", "dura"] and broken.method == "tiebreaker"
    assert not far.pairs


def test_pointing(spark):
    tag = lambda x, y: f"<point x='{x}' y='{y}'>a</point>"
    r = metrics.pointing_metrics(spark.createDataFrame([(tag(50, 50), tag(60, 50)), (tag(20, 20), tag(31, 31)), (tag(80, 20), "none"), ("none", tag(1, 1))], "truth string, predicted string")).first()
    assert (r.n, r.quadrant_accuracy) == (3, 1.0)
    assert [r.format_rate, r.accuracy_10, r.accuracy_15, r.mean_distance, r.median_distance, r.std_distance] == pytest.approx([2 / 3, 1 / 3, 1 / 3, 12.7781746, 12.7781746, 2.7781746])


def test_classes(spark):
    df = spark.createDataFrame([("nasal", "nasal"), ("nasal", "unknown"), ("sellar", "sellar")], "truth string, predicted string")
    r = metrics.macro_report(df).first()
    assert [r.accuracy, r.macro_f1, r.weighted_f1] == pytest.approx([2 / 3, 0.5555556, 0.7777778])
    assert {x.label: x.support for x in metrics.class_report(df, ["nasal", "sellar", "other"]).collect()} == {"nasal": 2, "sellar": 1, "other": 0}


def test_sequential_dedup(spark):
    rows = [(0.9, 0.5, 0.5), (0.8, 0.55, 0.5), (0.7, 0.65, 0.5), (0.6, 0.5, 0.5), (0.2, 0.1, 0.1)]
    df = spark.createDataFrame([([(*r, k) for k, r in enumerate(rows)],)], "p array<struct<confidence:double,x:double,y:double,ord:int>>")
    assert [q.confidence for q in df.select(matching.sequential_dedup(F.col("p"), 0.1, 0.3).alias("q")).first().q] == [0.9, 0.7, 0.6]


def test_reward(spark):
    df = spark.createDataFrame([("<point x='0.5' y='0.5'>curette</point>", [(0.55, 0.5, "curette")], "sellar_phase", None, ["curette"])], "t string, p array<struct<x:double,y:double,label:string>>, phase string, step string, i array<string>")
    r = df.select(*[c.alias(k) for k, c in R.rewards(F.col("t"), F.col("p"), F.col("phase"), F.col("step"), F.col("i")).items()]).first()
    assert list(r) == pytest.approx([1, 0, 0.5, 1, 0.5, 0.65])


def test_every_nth(spark):
    df = spark.createDataFrame([(1, t, t) for t in range(25)] + [(2, 5, 1), (2, 5, 0), (2, 7, 2)], "v int, t int, ord int")
    assert sorted((r.v, r.t, r.ord) for r in sampling.every_nth(df, ["v"], "t").collect()) == [(1, 0, 0), (1, 10, 10), (1, 20, 20), (2, 5, 0)]


def test_group_split(spark):
    df = spark.createDataFrame([(v, k) for v in range(25) for k in range(3)], "v int, k int")
    split = {r.v: r.split for r in sampling.group_split(df, "v").collect()}
    assert [list(split.values()).count(s) for s in ("train", "validation", "test")] == [20, 2, 3]
    assert matching.leaks(sampling.group_split(df, "v"), "v").count() == 0


@pytest.mark.parametrize(("sizes", "wanted"), [((25, 10, 3), (2, 3, 3)), ((4, 0, 0), (1, 0, 0))])
def test_review_sample(spark, sizes, wanted):
    bands = ("high", "medium", "low")
    df = spark.createDataFrame([(f"{b}{i}", b) for b, n in zip(bands, sizes) for i in range(n)], "k string, b string")
    found = [r.b for r in sampling.sample_by_rate(df, "k", "b", {"high": 0.1, "medium": 0.3, "low": 1.0}).collect()]
    assert tuple(found.count(b) for b in bands) == wanted


def test_slots():
    assert list(sampling.qa_slots(list("abcdefghi")).values()) == [1] * 8 + [0]
    assert list(sampling.qa_slots(list("abc")).values()) == [3, 3, 2]
    assert sampling.uniform_places(10, 4) == [0, 3, 6, 9]


@pytest.mark.parametrize(("text", "kind"), [("What step is the tool in?", "instrument"), ("How many vessels?", "count"), ("Where is it?", "location"), ("Hello", "other")])
def test_question_type(spark, text, kind):
    assert value(spark, T.question_type(F.lit(text))) == kind


def test_json_in_text(spark):
    text = F.lit('Sure: {"annotations":[{"label":"a","x":1.5}]} done')
    assert value(spark, P.json_in_text(text, "braces")).annotations[0].x == 1.5
    assert value(spark, P.json_in_text(text, "fence")) is None


def test_text_functions(spark):
    assert value(spark, T.english_list(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b and c"
    assert [value(spark, T.number_word(F.lit(n))) for n in (0, 5, 6)] == ["None", "Five", "6"]
    assert value(spark, P.clock_span(F.lit(59.9), F.lit(3661.0))) == "00:00:59 - 01:01:01"
    assert value(spark, T.bleu(F.lit("the cat sat"), F.lit("the cat sat"))) == pytest.approx(1.0)
    assert not value(spark, T.contains_either(F.lit(""), F.lit("a")))


def test_files_and_streams(spark, tmp_path):
    one = '[{"video_id":"v","label":" Forceps","two_fps_timestamps":[1.0,2.0],"points":[[{"x":3.0}],[]],"category":"instruments"}]'
    (tmp_path / "a.json").write_text(one)
    found = generate.flat_points(readers.annotations(spark, str(tmp_path / "none.json"), str(tmp_path / "a.json"))).collect()
    assert [(r.label, r.ts, r.x, r.y, r.confidence) for r in found] == [("forceps", 1.0, 3.0, 50.0, 0.5)]
    assert readers.annotations(spark, str(tmp_path / "none.json")).count() == 0
    shapes = tmp_path / "shapes"
    shapes.mkdir()
    for name, text in (("a", '{"frames":{"f1":{"phase":"x"}}}'), ("b", '{"annotations":[{"frame_id":"f2"}]}'), ("c", '[{"id":"f3"}]'), ("d", '{"f4":{"phase":"y"}}'), ("e", "{broken")):
        (shapes / f"{name}.json").write_text(text)
    rows = readers.frame_annotations(spark, str(shapes)).collect()
    assert {r.frame_id for r in rows if not r.corrupt} == {"f1", "f2", "f3", "f4"} and sum(r.corrupt for r in rows) == 1
    df = spark.range(30).select("id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("x"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.annotate(ingest.stream(spark, str(tmp_path / "in"), "id long, x long"), lambda c: c * 2, "x")
    ingest.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    batch = ingest.annotate(spark.read.parquet(str(tmp_path / "in")), lambda c: c * 2, "x")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))
    assert "| 0.000 | - |" in writers.markdown(spark.createDataFrame([(0.0, None)], "a double, b double"), "t")


def test_similarity_index(spark, tmp_path):
    index = search.SimilarityIndex(spark)
    index.add(0, "a", [1.0, 0.0], {"k": "1"})
    index.add(1, "a", [0.0, 1.0], {"k": "2"})
    assert [r.metadata["k"] for r in index.search([0.0, 2.0], 2).collect()] == ["2", "1"]
    index.save(str(tmp_path / "i"))
    assert search.SimilarityIndex.load(spark, str(tmp_path / "i")).size() == 2


def test_rules(spark):
    df = spark.createDataFrame([("a", None), ("b?", "x")], "question string, answer string")
    found = {r.check: r.failed for r in stats.rules(df, [("mark", "warning", ~F.col("question").endswith("?")), ("answer", "error", F.col("answer").isNull())]).collect()}
    assert found == {"mark": 1, "answer": 1}
