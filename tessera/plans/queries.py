"""Queries that apply the operators to the driver's tables, each beside the SQL it is held against.

Events stand in for annotations: the type is the annotator, (user, day) the frame, the event id the input order, a band of
the value the label, and (props.k, value modulo 100) the point.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import points as P
from tessera.functions import rewards as RW
from tessera.functions import text as T
from tessera.operators import agreement, annotate, cells, generate, grid, matching, metrics, samples, sampling, search, stats
from tessera.operators.cut import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

POINTS_SQL = """points AS (
  SELECT event_type AS source, user_id, CAST(ts AS DATE) AS day, event_id AS ord,
    CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'mid' ELSE 'high' END AS label,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x, value % 100 AS y, value
  FROM events)"""
PAIRS_SQL = (
    POINTS_SQL
    + """, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, user_id, day ORDER BY ord) AS rn FROM points) WHERE rn = 1),
pairs AS (SELECT user_id, day, a.label AS label_a, b.label AS label_b, a.x AS x_a, a.y AS y_a, b.x AS x_b, b.y AS y_b
  FROM firsts a JOIN firsts b USING (user_id, day) WHERE a.source = 'click' AND b.source = 'view')"""
)


def query(sql: str | None = None):  # noqa: ANN201
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    label = F.when(v < 20, "low").when(v < 60, "mid").otherwise("high")
    k = F.get_json_object("props", "$.k").cast("double")
    return load(spark, d, "events").select(F.col("event_type").alias("source"), "user_id", F.to_date("ts").alias("day"), F.col("event_id").alias("ord"), label.alias("label"), k.alias("x"), (v % 100).alias("y"), "value")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return matching.pairwise_overlap(points(spark, d), "click", "view", ["user_id", "day"], ["label", "x", "y"])


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# agreement


@query(f"""WITH {PAIRS_SQL}, t AS (SELECT count(*) AS n, count_if(label_a = label_b) AS agreeing FROM pairs),
e AS (SELECT sum(p * q) AS e FROM (SELECT label_a AS l, count(*) AS p FROM pairs GROUP BY 1) JOIN (SELECT label_b AS l, count(*) AS q FROM pairs GROUP BY 1) USING (l))
SELECT n, CAST(agreeing AS BIGINT) AS agreeing, round(CAST(agreeing * n - e AS DOUBLE) / CAST(n * n - e AS DOUBLE), 6) AS kappa FROM t, e""")
def irr_cohens_kappa(spark, d):
    return rounded(agreement.cohens_kappa(pairs(spark, d)))


@query(f"""WITH {POINTS_SQL}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, user_id, day ORDER BY ord) AS rn FROM points WHERE source IN ('click', 'view', 'purchase')) WHERE rn = 1),
u AS (SELECT user_id, day FROM r GROUP BY ALL HAVING count(*) = 3), c AS (SELECT user_id, day, label, count(*) AS c FROM r JOIN u USING (user_id, day) GROUP BY ALL),
a AS (SELECT count(DISTINCT (user_id, day)) AS n, sum(c * c) AS q FROM c), s AS (SELECT sum(s * s) AS s2 FROM (SELECT sum(c) AS s FROM c GROUP BY label))
SELECT n AS units, round(((q - n * 3.0) / (n * 6.0) - s2 / (n * 3.0 * n * 3.0)) / (1 - s2 / (n * 3.0 * n * 3.0)), 6)::DOUBLE AS kappa FROM (SELECT n, q::DOUBLE AS q, s2::DOUBLE AS s2 FROM a, s)""")
def irr_fleiss(spark, d):
    rows = matching.first_per_key(points(spark, d).where(F.col("source").isin("click", "view", "purchase")), ["source", "user_id", "day"])
    full = rows.groupBy("user_id", "day").agg(F.count("*").alias("m")).where("m = 3").drop("m")
    return rounded(agreement.fleiss_kappa(rows.join(full, ["user_id", "day"]), ["user_id", "day"]))


@query(f"""WITH {POINTS_SQL}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, user_id, day ORDER BY ord) AS rn FROM points) WHERE rn = 1),
c AS (SELECT user_id, day, label, count(*) AS c FROM r GROUP BY ALL), u AS (SELECT user_id, day, sum(c) AS m, sum(c * (c - 1)) AS same FROM c GROUP BY ALL HAVING sum(c) > 1),
p AS (SELECT sum(m) AS n, sum(m * (m - 1)) AS pairs, sum(same) AS same FROM u), s AS (SELECT sum(s * s) AS s2 FROM (SELECT sum(c) AS s FROM c JOIN u USING (user_id, day) GROUP BY label))
SELECT CAST(n AS BIGINT) AS n, round(1 - ((pairs - same)::DOUBLE / pairs::DOUBLE) / ((n * n - s2)::DOUBLE / (n * (n - 1))::DOUBLE), 6) AS alpha FROM p, s""")
def irr_krippendorff(spark, d):
    rows = matching.first_per_key(points(spark, d), ["source", "user_id", "day"])
    return rounded(agreement.krippendorff_alpha(rows, ["user_id", "day"]))


@query(f"""WITH {POINTS_SQL}, r AS (SELECT *, floor(value)::BIGINT AS v FROM (SELECT *, row_number() OVER (PARTITION BY source, user_id, day ORDER BY ord) AS rn FROM points) WHERE rn = 1),
u AS (SELECT count(*) AS m, sum(v) AS s, sum(v * v) AS q FROM r GROUP BY user_id, day HAVING count(*) > 1)
SELECT CAST(sum(m) AS BIGINT) AS n, round(1 - (sum(m * q - s * s)::DOUBLE / (sum(m * (m - 1)) / 2)::DOUBLE) / (2 * (sum(m) * sum(q) - sum(s) * sum(s))::DOUBLE / (sum(m) * (sum(m) - 1))::DOUBLE), 6) AS alpha FROM u""")
def irr_krippendorff_interval(spark, d):
    rows = matching.first_per_key(points(spark, d), ["source", "user_id", "day"]).withColumn("v", F.floor("value"))
    return rounded(agreement.krippendorff_alpha(rows, ["user_id", "day"], "v", "interval"))


def _zone(x: str, y: str, lo: int, hi: int, names: tuple) -> str:
    c, tl, tr, bl, br = names
    return f"CASE WHEN {x} BETWEEN {lo} AND {hi} AND {y} BETWEEN {lo} AND {hi} THEN {c} WHEN {x} < 50 AND {y} < 50 THEN {tl} WHEN {y} < 50 THEN {tr} WHEN {x} < 50 THEN {bl} ELSE {br} END"


def _spatial(names: tuple, lo: int, hi: int) -> str:
    return f"""WITH {PAIRS_SQL}, s AS (SELECT *, sqrt((x_a - x_b) * (x_a - x_b) + (y_a - y_b) * (y_a - y_b)) AS d, {_zone("x_a", "y_a", lo, hi, names)} = {_zone("x_b", "y_b", lo, hi, names)} AS same FROM pairs)
SELECT count(*) AS n, round(avg(d), 6) AS mean_distance, round(stddev_pop(d), 6) AS std_distance, round(avg((d <= 10)::INT), 6) AS within_10, round(avg((d <= 15)::INT), 6) AS within_15,
round(avg(same::INT), 6) AS zone_agreement, round(avg((label_a = label_b)::INT), 6) AS label_match FROM s"""


@query(_spatial((5, 1, 2, 3, 4), 40, 60))
def irr_spatial(spark, d):
    return rounded(agreement.spatial_agreement(pairs(spark, d), "generator"))


@query(_spatial((3, 1, 2, 4, 5), 33, 66))
def irr_zone_b(spark, d):
    return rounded(agreement.spatial_agreement(pairs(spark, d), "validator"))


@query(f"""WITH {PAIRS_SQL} SELECT {_zone("x_a", "y_a", 1000, -1000, (0, "'TL'", "'TR'", "'BL'", "'BR'")).replace("THEN 0 ", "THEN '' ")} AS quadrant, count(*) AS n FROM pairs GROUP BY 1""")
def quadrants(spark, d):
    return pairs(spark, d).groupBy(P.zone(F.col("x_a"), F.col("y_a"), "quadrant").alias("quadrant")).agg(F.count("*").alias("n"))


@query(f"""WITH {POINTS_SQL}, k AS (SELECT label AS category, user_id, day, count_if(source = 'click') AS p, count_if(source = 'view') AS q FROM points WHERE source IN ('click', 'view') GROUP BY ALL)
SELECT category, CAST(sum(p) AS BIGINT) AS points_a, CAST(sum(q) AS BIGINT) AS points_b, CAST(count_if(p > 0 AND q > 0) AS BIGINT) AS overlap FROM k GROUP BY category""")
def irr_category_overlap(spark, d):
    return agreement.category_overlap(points(spark, d).withColumnRenamed("label", "category"), ["user_id", "day"], "click", "view")


# joins by time and space


@query("""SELECT e.event_id, e.user_id, p.event_id AS last_purchase, p.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_step(spark, d):
    e = load(spark, d, "events")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"), F.col("value").alias("last_value"), F.col("event_id").alias("tie"))
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return matching.asof(left, right, ["user_id"], "ts", ["last_purchase", "last_value"], "tie").drop("ts")


@query("""WITH i AS (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders)
SELECT o_orderpriority, count(*) AS n, count(nxt) AS closed, CAST(sum(date_diff('day', o_orderdate, nxt)) AS BIGINT) AS days FROM i GROUP BY 1""")
def interval_step(spark, d):
    rows = matching.intervals(load(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count("end").alias("closed"), F.sum(F.date_diff("end", "o_orderdate").cast("long")).alias("days"))


FRAMES_SQL = "f AS (SELECT user_id, floor(epoch(ts) / 3600)::BIGINT AS frame, event_type FROM events)"


@query(f"""WITH {FRAMES_SQL}, w AS (SELECT DISTINCT user_id, frame FROM f WHERE event_type = 'error'), c AS (SELECT DISTINCT user_id, frame FROM f WHERE event_type = 'click'),
m AS (SELECT w.user_id, w.frame, arg_min(c.frame, CASE WHEN c.frame = w.frame THEN -3 ELSE c.frame - w.frame END) AS found FROM w JOIN c ON w.user_id = c.user_id AND abs(c.frame - w.frame) <= 2 GROUP BY ALL)
SELECT w.user_id, w.frame, m.found FROM w LEFT JOIN m USING (user_id, frame)""")
def tolerance_lookup(spark, d):
    f = load(spark, d, "events").select("user_id", F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("frame"), "event_type")
    of = lambda kind: f.where(F.col("event_type") == kind).select("user_id", "frame").distinct()
    return matching.tolerance_lookup(of("error"), of("click"), ["user_id"])


def _frames(spark, d):
    p = points(spark, d)
    of = lambda s: F.coalesce(F.array_sort(F.collect_list(F.when(F.col("source") == s, F.struct("ord", "x", "y", "label", F.lit(0.95).alias("confidence"))))), F.array())
    plain = lambda c: F.transform(c, lambda q: F.struct(q.x.alias("x"), q.y.alias("y"), q.label.alias("label"), q.confidence.alias("confidence")))
    return p.groupBy("user_id", "day").agg(of("click").alias("l"), of("view").alias("r"), of("purchase").alias("t")).select("user_id", "day", *[plain(c).alias(c) for c in "lrt"])


@query()
def greedy_match(spark, d):
    p = points(spark, d)
    of = lambda s: grid.placed(p.where(F.col("source") == s), ["user_id", "day"])
    found = grid.greedy_rows(of("click"), of("view"), ["user_id", "day"], 20.0)
    place = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("l")) - 1
    return found.select("user_id", "day", place.alias("place"), "l", "r", F.round("score", 6).alias("score"))


@query()
def consensus(spark, d):
    c = matching.consensus(F.col("l"), F.col("r"), F.col("t"), reach=20.0)
    return _frames(spark, d).select("user_id", "day", F.size(c["pairs"]).alias("n_pairs"), c["needs_tiebreak"].alias("needs_tiebreak"), F.size(c["points"]).alias("n_points"), c["method"].alias("method"))


@query()
def nms_dedup(spark, d):
    p = points(spark, d).withColumn("confidence", F.col("value") / 100)
    return grid.sequential_dedup_rows(p.select("user_id", "label", "confidence", "ord", "x", "y"), ["user_id", "label"], 10.0, 0.1).select("user_id", "label", "ord")


@query()
def merged_annotators(spark, d):
    """Z3: two annotators of each event, one of which fails on errors, their points merged by user and day."""
    frames = points(spark, d).select("ord", "source", "user_id", "label", "x", "y")
    rows = annotate.annotated(frames, annotate.Copier, "copier", ["x", "y", "label"]).unionByName(annotate.annotated(frames, annotate.Picky, "picky", ["source", "x", "y", "label"]))
    found = annotate.merged(rows, ["ord"], reach=3.0)
    first = F.get("points", F.lit(0))
    return found.select("ord", "annotators", "errors", F.size("points").alias("n"), first.annotator.alias("annotator"), F.round(first.x, 6).alias("x"), F.round(first.confidence, 6).alias("confidence"))


# classification and pointing

RULES_SQL = "r AS (SELECT CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS truth, CASE WHEN n_chars > 1500 THEN 'good' WHEN n_chars > 300 THEN 'bad' ELSE 'unknown' END AS predicted, lang FROM labels JOIN documents USING (doc_id))"
CLASS_SQL = f"""WITH {RULES_SQL}, l AS (SELECT truth AS label FROM r UNION SELECT predicted FROM r),
c AS (SELECT label, count_if(truth = label AND predicted = label) AS tp, count_if(truth <> label AND predicted = label) AS fp, count_if(truth = label AND predicted <> label) AS fn FROM l, r GROUP BY label),
m AS (SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp + fn AS BIGINT) AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END::DOUBLE AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END::DOUBLE AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END::DOUBLE AS f1 FROM c)"""


def judged(spark, d):
    n = F.col("n_chars")
    rows = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return rows.select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"), F.when(n > 1500, "good").when(n > 300, "bad").otherwise("unknown").alias("predicted"), "lang", "quality", "toxic", "n_chars")


@query(f"""WITH {RULES_SQL}, l(x) AS (VALUES ('bad'), ('good'), ('unknown')), g AS (SELECT a.x AS truth, b.x AS predicted FROM l a, l b), c AS (SELECT truth, predicted, count(*) AS n FROM r GROUP BY ALL)
SELECT truth, predicted, coalesce(n, 0) AS n, round(coalesce(n, 0) / (CAST(sum(coalesce(n, 0)) OVER (PARTITION BY truth) AS DOUBLE) + 1e-10), 6) AS share FROM g LEFT JOIN c USING (truth, predicted)""")
def confusion_matrix(spark, d):
    return rounded(metrics.confusion_matrix(judged(spark, d), ["bad", "good", "unknown"]))


@query(CLASS_SQL + " SELECT label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def prf_per_class(spark, d):
    return rounded(metrics.per_class(judged(spark, d)))


@query(CLASS_SQL + " SELECT CAST(sum(support) AS BIGINT) AS n, round(CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / CAST(sum(support) AS DOUBLE), 6) AS weighted_f1 FROM m")
def macro_f1_observed(spark, d):
    return rounded(metrics.macro_report(judged(spark, d)))


@query(f"WITH {RULES_SQL} SELECT lang, count(*) AS n, CAST(count_if(truth = predicted) AS BIGINT) AS n_correct, round(avg((truth = predicted)::INT), 6) AS accuracy FROM r GROUP BY ROLLUP (lang)")
def metrics_rollup(spark, d):
    return rounded(metrics.by_group_and_total(judged(spark, d).withColumn("correct", F.col("truth") == F.col("predicted")), "lang"))


@query("""WITH r AS (SELECT quality = 1 AS a, toxic = 1 AS b, n_chars > 1500 AS p, n_chars > 3000 AS q FROM labels JOIN documents USING (doc_id)),
m AS (SELECT (a AND p)::INT + (b AND q)::INT AS hits, a::INT + b::INT AS t, p::INT + q::INT AS f, a = p AND b = q AS same FROM r),
s AS (SELECT count(*) AS n, avg(hits / (f + 1e-8::DOUBLE)) AS precision, avg(hits / (t + 1e-8::DOUBLE)) AS recall, avg(same::INT) AS exact FROM m)
SELECT n, round(precision, 6) AS precision, round(recall, 6) AS recall, round(exact, 6) AS exact, round(2 * precision * recall / (precision + recall + 1e-8::DOUBLE), 6) AS f1 FROM s""")
def multilabel_metrics(spark, d):
    arr = lambda a, b: F.array_compact(F.array(F.when(a, "q"), F.when(b, "t")))
    rows = judged(spark, d).select(arr(F.col("quality") == 1, F.col("toxic") == 1).alias("truth"), arr(F.col("n_chars") > 1500, F.col("n_chars") > 3000).alias("predicted"))
    return rounded(metrics.multilabel_metrics(rows))


TAGS_SQL = f"""{POINTS_SQL}, t AS (SELECT ord, source, x::INT AS x, floor(y)::INT AS y, CASE WHEN ord % 10 = 0 THEN 'no point' ELSE '<point x=''' || x::INT || ''' y=''' || (floor(y)::INT * 9 // 10) || '''>' || label || '</point>' END AS text FROM points)"""


def tags(spark, d):
    x, y = F.col("x").cast("int"), F.floor("y").cast("int")
    text = F.when(F.col("ord") % 10 == 0, "no point").otherwise(P.point_tag(x, F.expr("floor(y) * 9 div 10"), F.col("label"), None))
    return points(spark, d).select("ord", "source", P.point_tag(x, y, F.col("label"), None).alias("truth"), text.alias("predicted"), x.alias("x"), y.alias("y"), "label")


@query(f"""WITH {TAGS_SQL}, p AS (SELECT ord, text, x AS gx, y AS gy, TRY_CAST(nullif(regexp_extract(text, '<point x=''([\\d.]+)''', 1), '') AS DOUBLE) AS px, TRY_CAST(nullif(regexp_extract(text, ' y=''([\\d.]+)''', 1), '') AS DOUBLE) AS py FROM t),
s AS (SELECT *, sqrt((gx - px) * (gx - px) + (gy - py) * (gy - py)) AS d, (gx < 50) = (px < 50) AND (gy < 50) = (py < 50) AS same FROM p)
SELECT count(*) AS n, round(count(d) / count(*), 6) AS format_rate, round(count_if(d <= 10) / count(*), 6)::DOUBLE AS accuracy_10, round(count_if(d <= 15) / count(*), 6)::DOUBLE AS accuracy_15, round(count_if(same) / count(d), 6)::DOUBLE AS quadrant_accuracy,
round(avg(d), 6) AS mean_distance, round(median(d), 6) AS median_distance, round(stddev_pop(d), 6) AS std_distance FROM s""")
def pointing_metrics(spark, d):
    return rounded(metrics.pointing_metrics(tags(spark, d)))


@query(f"WITH {TAGS_SQL} SELECT source, count(*) AS n, CAST(count_if(text LIKE '<point%') AS BIGINT) AS tagged, CAST(sum(CASE WHEN text LIKE '<point%' THEN x END) AS DOUBLE) AS sum_x FROM t GROUP BY source")
def extract_points(spark, d):
    rows = tags(spark, d).withColumn("p", P.labelled_points(F.col("predicted")))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.size("p") > 0).alias("tagged"), F.sum(F.get("p", F.lit(0)).x).alias("sum_x"))


def _rewards_sql(script: bool) -> str:
    empty = 0.0 if script else 0.5
    form = "CASE WHEN n BETWEEN 10 AND 200 THEN (tagged::INT + 1) / 2 ELSE tagged::INT END" if script else "(tagged::INT + CASE WHEN n BETWEEN 10 AND 200 THEN 1 WHEN n < 5 OR n > 500 THEN 0 ELSE 0.5 END) / 2"
    return f"""WITH {TAGS_SQL}, r AS (SELECT t.ord, t.text || ' seen by a ' || t.source AS s, t.text LIKE '<point%' AS tagged, abs(t.y - t.y * 9 // 10) < 0.1 AS near FROM t JOIN points p USING (ord)),
w AS (SELECT *, len(list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '')) AS n FROM r),
c AS (SELECT ord, (tagged AND near)::INT::DOUBLE AS pointing, CASE ord % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE {empty} END::DOUBLE AS phase, CASE ord % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE {empty} END::DOUBLE AS step,
CASE ord % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 1.0 / 3 END::DOUBLE AS instrument, ({form})::DOUBLE AS format FROM w)
SELECT ord, pointing, phase, step, round(instrument, 6)::DOUBLE AS instrument, format, round(0.3 * pointing + 0.2 * phase + 0.2 * step + 0.2 * instrument + 0.1 * format, 6)::DOUBLE AS total FROM c"""


def _rewarded(spark, d, variant):
    """Phases that are named, missing or empty, steps likewise, and lists of instruments of which all, some or none are named."""
    rows = tags(spark, d).select("ord", F.concat(F.col("predicted"), F.lit(" seen by a "), "source").alias("text"), F.array(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "label")).alias("points"), "source")
    o, source, none = F.col("ord"), F.col("source"), F.array().cast("array<string>")
    phase = F.when(o % 3 == 0, source).when(o % 3 == 1, "no such phase").otherwise("")
    step = F.when(o % 4 == 0, "SEEN_by").when(o % 4 == 1, "gone")
    names = F.when(o % 5 == 0, none).when(o % 5 == 1, F.array(source)).when(o % 5 == 2, F.array(source, F.lit("absent"))).otherwise(F.array(F.lit("absent"), F.lit("seen_by"), F.lit("gone")))
    parts = RW.rewards(F.col("text"), F.col("points"), phase, step, names, variant)
    return rounded(rows.select("ord", *[c.alias(k) for k, c in parts.items()]))


@query(_rewards_sql(False))
def rewards(spark, d):
    return _rewarded(spark, d, "class")


@query(_rewards_sql(True))
def rewards_script(spark, d):
    return _rewarded(spark, d, "script")


TASKS_SQL = """r AS (SELECT 'length' AS task, CASE WHEN n_chars > 1500 THEN 'long' WHEN n_chars > 300 THEN 'mid' ELSE 'short' END AS truth, CASE WHEN doc_id % 7 < 5 THEN 'long' WHEN doc_id % 7 = 5 THEN NULL ELSE 'none' END AS predicted FROM documents
UNION ALL SELECT 'lang', lang, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END FROM documents)"""


@query(f"""WITH {TASKS_SQL}, k AS (SELECT * FROM r WHERE truth IS NOT NULL), t AS (SELECT task, count(*) AS n, avg(coalesce(truth = predicted, false)::INT) AS accuracy FROM k GROUP BY task),
s AS (SELECT task, truth AS c, 1 AS real, 0 AS said, coalesce(truth = predicted, false)::INT AS hit FROM k UNION ALL SELECT task, predicted, 0, 1, 0 FROM k WHERE predicted IS NOT NULL),
c AS (SELECT task, c, sum(real) AS real, sum(said) AS said, sum(hit) AS hits FROM s GROUP BY ALL),
m AS (SELECT task, avg(hits / said) FILTER (said > 0) AS precision, avg(hits / real) FILTER (real > 0) AS recall FROM c GROUP BY task)
SELECT task, n, round(accuracy, 6)::DOUBLE AS accuracy, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(2 * precision * recall / (precision + recall + 1e-8), 6)::DOUBLE AS f1 FROM t JOIN m USING (task)""")
def task_metrics(spark, d):
    docs, n, k = load(spark, d, "documents"), F.col("n_chars"), F.col("doc_id") % 7
    first = docs.select(F.lit("length").alias("task"), F.when(n > 1500, "long").when(n > 300, "mid").otherwise("short").alias("truth"), F.when(k < 5, "long").when(k == 6, "none").alias("predicted"))
    second = docs.select(F.lit("lang").alias("task"), F.col("lang").alias("truth"), F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("lang")).alias("predicted"))
    return rounded(metrics.task_metrics(first.union(second)))


@query("""WITH r AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE lang END AS task, list_distinct(string_split(source || ',' || lang, ',')) AS truth, list_distinct([lang, 'web', 'x' || (doc_id % 3)]) AS predicted FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
h AS (SELECT *, len(list_intersect(truth, predicted)) AS hits, len(truth) AS t, len(predicted) AS p FROM r), m AS (SELECT task, count(*) AS n, avg((hits = t AND hits = p)::INT) AS accuracy, avg(hits / (p + 1e-8)) AS precision, avg(hits / (t + 1e-8)) AS recall FROM h GROUP BY task)
SELECT task, n, round(accuracy, 6)::DOUBLE AS accuracy, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(2 * precision * recall / (precision + recall + 1e-8), 6)::DOUBLE AS f1 FROM m""")
def multilabel_task_metrics(spark, d):
    docs = load(spark, d, "documents").where("source is not null and lang is not null")
    task = F.when(F.col("doc_id") % 2 == 0, "even").otherwise(F.col("lang"))
    predicted = F.array("lang", F.lit("web"), F.concat(F.lit("x"), F.col("doc_id") % 3))
    return rounded(metrics.multilabel_task_metrics(docs.select(task.alias("task"), F.array("source", "lang").alias("truth"), predicted.alias("predicted"))))


@query("""WITH c AS (SELECT conv_id, turn, role, text, CASE conv_id % 3 WHEN 0 THEN 'Instrument_pointing' WHEN 1 THEN 'anatomy' ELSE 'phase' END AS kind FROM conversations),
g AS (SELECT conv_id, any_value(kind) AS kind, count_if(role = 'assistant')::BIGINT AS n FROM c GROUP BY conv_id)
SELECT conv_id::VARCHAR AS frame_id, '' AS video_id, CASE WHEN kind LIKE 'Instr%' THEN 'instrument' ELSE 'anatomy' END AS task_type, n AS n_points, (n * (conv_id % 90))::DOUBLE AS sum_x FROM g WHERE kind <> 'phase' AND conv_id % 4 <> 0""")
def spatial_samples(spark, d):
    """Each assistant's turn is given a tagged point."""
    c = load(spark, d, "conversations")
    tag = F.when(F.col("role") == "assistant", F.concat(F.lit("<point x='"), F.col("conv_id") % 90, F.lit("' y='5'>drill</point>"))).otherwise(F.lit("?"))
    chats = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", tag.alias("content")))).alias("messages"))
    kind = F.when(F.col("conv_id") % 3 == 0, "Instrument_pointing").when(F.col("conv_id") % 3 == 1, "anatomy").otherwise("phase")
    rows = chats.select(F.when(F.col("conv_id") % 4 != 0, "a.png").alias("image"), "messages", F.lit(None).cast("string").alias("video_id"), F.col("conv_id").cast("string").alias("frame_id"), kind.alias("annotation_type"))
    found = samples.spatial_samples(rows)
    return found.select("frame_id", "video_id", "task_type", F.size("points").cast("long").alias("n_points"), F.aggregate("points", F.lit(0.0), lambda s, p: s + p.x).alias("sum_x"))


# statistics


@query("""SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.25), 6) AS suggested FROM events GROUP BY 1""")
def blur_percentiles(spark, d):
    return rounded(stats.blur_distribution(load(spark, d, "events"), "value", ["event_type"]))


@query("""WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events) SELECT CAST(least(floor((value - a) / (b - a) * 50) + 1, 50) AS INT) AS bin, count(*) AS n FROM events, e GROUP BY 1""")
def histogram50(spark, d):
    return stats.histogram(load(spark, d, "events"), "value")


@query("""WITH m AS (SELECT role, turn, count(*) AS c, min(conv_id * 1000 + turn) AS f FROM conversations GROUP BY ALL), a AS (SELECT turn, count(*) AS c, min(conv_id * 1000 + turn) AS f FROM conversations GROUP BY ALL),
k AS (SELECT role, arg_max(turn, (c, -f)) AS mode FROM m GROUP BY role UNION ALL SELECT NULL, arg_max(turn, (c, -f)) FROM a),
s AS (SELECT role, count(*) AS n, count(DISTINCT conv_id) AS videos, count(DISTINCT (conv_id, turn)) AS frames FROM conversations GROUP BY ROLLUP (role))
SELECT s.role, n, videos, frames, round(n / frames, 6) AS rows_per_frame, mode FROM s JOIN k ON s.role IS NOT DISTINCT FROM k.role""")
def dataset_stats(spark, d):
    rows = load(spark, d, "conversations").withColumn("ord", F.col("conv_id") * 1000 + F.col("turn")).withColumn("kind", F.col("turn"))
    return rounded(stats.dataset_statistics(rows, "role", "conv_id", "turn", "kind", "ord"))


@query("""SELECT label, n, row_number() OVER (ORDER BY n DESC, f)::INT AS rank FROM (SELECT user_id AS label, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1 ORDER BY n DESC, f LIMIT 20)""")
def topk_labels(spark, d):
    return stats.top_labels(load(spark, d, "events").select(F.col("user_id").alias("label"), F.col("event_id").alias("ord")))


@query("SELECT lang, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM documents), 2)::DOUBLE AS percent FROM documents GROUP BY 1")
def label_distribution(spark, d):
    return stats.distribution(load(spark, d, "documents"), "lang")


@query("""SELECT * FROM (SELECT 'no_text' AS "check", 'error' AS severity, CAST(count_if(text IS NULL OR text = '') AS BIGINT) AS failed, count(*) AS n_rows FROM documents
UNION ALL SELECT 'short', 'warning', CAST(count_if(n_chars < 300) AS BIGINT), count(*) FROM documents UNION ALL SELECT 'bad_lang', 'error', CAST(count_if(lang NOT IN ('en', 'fr')) AS BIGINT), count(*) FROM documents)""")
def validate_rules(spark, d):
    return stats.rules(load(spark, d, "documents"), [("no_text", "error", F.coalesce(F.col("text"), F.lit("")) == ""), ("short", "warning", F.col("n_chars") < 300), ("bad_lang", "error", ~F.col("lang").isin("en", "fr"))])


@query("SELECT conv_id, list_sort(list(DISTINCT role)) AS splits FROM conversations GROUP BY 1 HAVING count(DISTINCT role) > 1")
def split_leakage(spark, d):
    return matching.leaks(load(spark, d, "conversations").withColumnRenamed("role", "split"), "conv_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark, d):
    files = load(spark, d, "labels").select(F.concat(F.lit("a/"), "doc_id", F.lit(".png")).alias("path"))
    return stats.orphans(load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("frame_id")), files).select(F.col("frame_id").cast("long").alias("doc_id"))


@query("""WITH c AS (SELECT event_type AS kind, count(DISTINCT user_id) AS found FROM events GROUP BY 1), w(kind, wanted) AS (VALUES ('click', 150), ('view', 149), ('nothing', 1))
SELECT kind, wanted::INT AS wanted, coalesce(found, 0) AS found, coalesce(found, 0) = wanted AS ok FROM w LEFT JOIN c USING (kind)""")
def class_coverage(spark, d):
    rows = load(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("label"))
    return stats.class_coverage(rows, {"click": 150, "view": 149, "nothing": 1})


@query("SELECT user_id, count(*) AS n, count(*) BETWEEN 50 AND 80 AS ok FROM events GROUP BY 1")
def counts_in_bounds(spark, d):
    return stats.counts_in_bounds(load(spark, d, "events"), "user_id", 50, 80)


@query("""SELECT role AS split, count(*) AS n, round(count(*) / (SELECT count(*) FROM conversations), 6) AS share, abs(count(*) / (SELECT count(*) FROM conversations) - CASE role WHEN 'user' THEN 0.5 WHEN 'assistant' THEN 0.4 ELSE 0.1 END::DOUBLE) <= 0.02::DOUBLE AS ok FROM conversations GROUP BY 1""")
def split_ratios(spark, d):
    return rounded(stats.split_ratio_check(load(spark, d, "conversations").withColumnRenamed("role", "split"), {"user": 0.5, "assistant": 0.4, "system": 0.1}))


# sampling: ranks of md5(id || seed)


def _rank(table: str, key: str, by: str = "") -> str:
    return f"row_number() OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY md5({key}::VARCHAR || '42'), {key}) AS rk"


@query(f"""WITH g AS (SELECT conv_id, {_rank("", "conv_id")} FROM (SELECT DISTINCT conv_id FROM conversations)), s AS (SELECT conv_id, CASE WHEN rk <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rk <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM g, (SELECT count(*) AS n FROM g))
SELECT conv_id, turn, split FROM conversations JOIN s USING (conv_id)""")
def group_split(spark, d):
    return sampling.group_split(load(spark, d, "conversations").select("conv_id", "turn"), "conv_id")


@query(f"""WITH g AS (SELECT doc_id, {_rank("", "doc_id")} FROM documents) SELECT doc_id, CASE WHEN rk <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'validation' END AS split FROM g, (SELECT count(*) AS n FROM g)""")
def row_split(spark, d):
    return sampling.row_split(load(spark, d, "documents").select("doc_id"), "doc_id", (0.9, 0.1, 0.0)).withColumn("split", F.when(F.col("split") == "train", "train").otherwise("validation"))


@query(f"""WITH a AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), r(lang, w) AS (VALUES ('en', 0.25::DOUBLE), ('fr', 0.35::DOUBLE), ('de', 0.25::DOUBLE), ('es', 0.15::DOUBLE)), m AS (SELECT CAST(floor(min(n / w)) AS BIGINT) AS t FROM r JOIN a USING (lang)),
k AS (SELECT doc_id, lang, {_rank("", "doc_id", "lang")} FROM documents) SELECT doc_id, lang FROM k JOIN r USING (lang), m WHERE rk <= floor(t * w)""")
def ratio_balance(spark, d):
    return sampling.balance_by_ratio(load(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", {"en": 0.25, "fr": 0.35, "de": 0.25, "es": 0.15})


BAND_SQL = "CASE WHEN n_chars >= 3000 THEN 'high' WHEN n_chars >= 1000 THEN 'medium' ELSE 'low' END"


@query(f"""WITH b AS (SELECT doc_id, {BAND_SQL} AS band FROM documents), k AS (SELECT doc_id, band, {_rank("", "doc_id", "band")}, count(*) OVER (PARTITION BY band) AS n FROM b)
SELECT doc_id, band FROM k WHERE rk <= greatest(1, floor(n * CASE band WHEN 'high' THEN 0.1 WHEN 'medium' THEN 0.3 ELSE 1.0 END::DOUBLE))""")
def stratified_sample(spark, d):
    n = F.col("n_chars")
    rows = load(spark, d, "documents").select("doc_id", F.when(n >= 3000, "high").when(n >= 1000, "medium").otherwise("low").alias("band"))
    return sampling.sample_by_rate(rows, "doc_id", "band", {"high": 0.1, "medium": 0.3, "low": 1.0}).select("doc_id", "band")


@query(f"""WITH k AS (SELECT doc_id, lang, {_rank("", "doc_id", "lang")} FROM documents) SELECT doc_id, lang FROM k WHERE rk <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))""")
def min_balance(spark, d):
    return sampling.balance_to_least(load(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang")


@query("""WITH t AS (SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS ord FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rk FROM t) SELECT user_id, day, ord FROM k WHERE (rk - 1) % 10 = 0""")
def every_nth_distinct(spark, d):
    return sampling.every_nth(points(spark, d).select("user_id", "day", "ord", "label"), ["user_id"], "day").select("user_id", "day", "ord")


@query("SELECT user_id, ord, rank FROM (SELECT user_id, event_id AS ord, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS rank FROM events) WHERE rank <= 3")
def first_n_per_group(spark, d):
    return sampling.first_n(points(spark, d).select("user_id", "ord"), ["user_id"], 3)


# vectors


def _knn(score: str) -> str:
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS f FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, {score} AS similarity FROM q, v), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM k WHERE rank <= 5"""


def _nearest(spark, d, metric):
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(search.top_k_join(e, queries, 5, metric))


@query(_knn("list_dot_product(e, f) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f)))"))
def knn_cosine(spark, d):
    return _nearest(spark, d, "cosine")


@query(_knn("list_dot_product(e, f)"))
def knn_dot(spark, d):
    return _nearest(spark, d, "dot")


@query(_knn("-list_distance(e, f)"))
def knn_euclid(spark, d):
    return _nearest(spark, d, "euclidean")


@query(_knn("-list_distance(e, f)"))
def knn_cells(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    index = cells.CellIndex.build(e, shared_path(spark, "cells"))
    return rounded(index.search(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")))


@query("SELECT label, (i - 1)::INT AS place, round(avg(embedding[i]::DOUBLE), 6) AS v FROM embeddings, range(1, 65) t(i) GROUP BY label, i")
def vector_pool_mean(spark, d):
    return rounded(stats.pooled(load(spark, d, "embeddings"), "label", "embedding"))


# text

TURNS_SQL = """t AS (SELECT a.conv_id, a.turn, coalesce(a.text, '') AS said, coalesce(b.text, '') AS wanted FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
w AS (SELECT conv_id, turn, true AS own, list_filter(string_split_regex(lower(said), '\\s+'), lambda x: x <> '') AS ws FROM t UNION ALL SELECT conv_id, turn, false, list_filter(string_split_regex(lower(wanted), '\\s+'), lambda x: x <> '') FROM t),
g AS (SELECT conv_id, turn, own, k, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT conv_id, turn, own, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 5) r(k))),
c AS (SELECT conv_id, turn, k, gram, count_if(own) AS a, count_if(NOT own) AS b FROM g GROUP BY ALL),
s AS (SELECT conv_id, turn, k, sum(least(a, b)) AS hits, sum(a) AS size, sum(b) AS b FROM c GROUP BY ALL),
h AS (SELECT conv_id, turn, coalesce(max(hits) FILTER (k = 1), 0)::BIGINT AS h1, coalesce(max(hits) FILTER (k = 2), 0)::BIGINT AS h2, coalesce(max(hits) FILTER (k = 3), 0)::BIGINT AS h3, coalesce(max(hits) FILTER (k = 4), 0)::BIGINT AS h4,
coalesce(max(size) FILTER (k = 1), 0)::BIGINT AS s1, coalesce(max(size) FILTER (k = 2), 0)::BIGINT AS s2, coalesce(max(size) FILTER (k = 3), 0)::BIGINT AS s3, coalesce(max(size) FILTER (k = 4), 0)::BIGINT AS s4, coalesce(max(b) FILTER (k = 1), 0)::BIGINT AS r FROM t LEFT JOIN s USING (conv_id, turn) GROUP BY conv_id, turn)"""
_LOG = lambda k: f"ln(greatest(h{k}::DOUBLE, 0.1) / greatest(s{k}, 1))"
_SHORT = "CASE WHEN s1 > r THEN 0.0 ELSE 1 - r::DOUBLE / greatest(s1, 1) END"
BLEU_SQL = f"""round(CASE WHEN h1 > 0 THEN exp({_LOG(1)} + {_SHORT}) ELSE 0.0 END, 6)::DOUBLE AS bleu_1,
round(CASE WHEN h1 > 0 THEN exp(({_LOG(1)} + {_LOG(2)} + {_LOG(3)} + {_LOG(4)}) / 4 + {_SHORT}) ELSE 0.0 END, 6)::DOUBLE AS bleu_4"""


def turns(spark, d):
    """Each turn's text beside the next one's."""
    c = load(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("wanted"))
    return c.select("conv_id", "turn", F.col("text").alias("said")).join(after, ["conv_id", "turn"]).withColumn("key", F.struct("conv_id", "turn"))


@query(f"WITH {TURNS_SQL} SELECT conv_id, turn, {BLEU_SQL} FROM h")
def bleu_by_turn(spark, d):
    return rounded(T.sentence_bleu(T.ngram_hits(turns(spark, d), "key", "said", "wanted"), "key").select("key.*", "bleu_1", "bleu_4"))


@query(f"""WITH {TURNS_SQL}, x AS (SELECT count(*) AS pairs, {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('h1', 'h2', 'h3', 'h4', 's1', 's2', 's3', 's4', 'r'))} FROM h) SELECT pairs, {BLEU_SQL} FROM x""")
def bleu_of_corpus(spark, d):
    return rounded(T.corpus_bleu(T.ngram_hits(turns(spark, d), "key", "said", "wanted")))


@query()
def rouge_by_turn(spark, d):
    return rounded(T.rouge_l(turns(spark, d).drop("key"), "said", "wanted").drop("said", "wanted"))


@query("""WITH w AS (SELECT item_id, unnest(string_split_regex(text, '\\s+')) AS word, generate_subscripts(string_split_regex(text, '\\s+'), 1) AS p FROM benchmark), c AS (SELECT word, count(*) AS n, min((item_id, p)) AS f FROM w WHERE word <> '' GROUP BY word HAVING count(*) >= 2)
SELECT word, n, row_number() OVER (ORDER BY n DESC, f) + 3 AS id FROM c""")
def vocabulary(spark, d):
    return stats.vocabulary(load(spark, d, "benchmark"), "text", "item_id", 2)


@query("SELECT item_id, trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))) AS cleaned FROM benchmark")
def clean_text(spark, d):
    return load(spark, d, "benchmark").select("item_id", T.clean(F.col("text")).alias("cleaned"))


QUESTION_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(words)}') THEN '{kind}'" for kind, words in T.QUESTION_TYPES.items()) + " ELSE 'other' END"


@query(f"SELECT question_type, count(*) AS n FROM (SELECT {QUESTION_SQL} AS question_type FROM (SELECT CASE event_id % 7 WHEN 0 THEN 'What step is the tool in?' WHEN 1 THEN 'How many vessels?' WHEN 2 THEN 'Where is it?' WHEN 3 THEN 'Hello' WHEN 4 THEN 'What is happening?' WHEN 5 THEN 'Is there an organ?' ELSE event_type END AS text FROM events)) GROUP BY 1")
def question_type(spark, d):
    k = F.col("event_id") % 7
    text = F.when(k == 0, "What step is the tool in?").when(k == 1, "How many vessels?").when(k == 2, "Where is it?").when(k == 3, "Hello").when(k == 4, "What is happening?").when(k == 5, "Is there an organ?").otherwise(F.col("event_type"))
    return load(spark, d, "events").groupBy(T.question_type(text).alias("question_type")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN lower(text) LIKE '%tion%' THEN 'tion' WHEN lower(text) LIKE '%ment%' THEN 'ment' WHEN lower(text) LIKE '%keit%' THEN 'keit' ELSE 'unknown' END AS label FROM documents")
def label_from_text(spark, d):
    return load(spark, d, "documents").select("doc_id", T.label_in_text(F.col("text"), ["tion", "ment", "keit"]).alias("label"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS fenced, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS braced FROM events""")
def json_extract(spark, d):
    fence = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nbye"))
    brace = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here it is "), "props", F.lit(" done"))).otherwise("nothing here")
    return load(spark, d, "events").select("event_id", P.json_in_text(fence, "fence", "k int").k.alias("fenced"), P.json_in_text(brace, "braces", "k int").k.alias("braced"))


# generators


@query("""WITH t AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text AS prompt, CASE WHEN nr = 'assistant' THEN nt END AS answer FROM t WHERE role = 'user'""")
def turn_pairs(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = load(spark, d, "conversations").withColumns({"nr": F.lead("role").over(w), "nt": F.lead("text").over(w)})
    return t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"), F.when(F.col("nr") == "assistant", F.col("nt")).alias("answer"))


@query("""WITH t AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text AS user_text, nt AS assistant_text FROM t WHERE role = 'user' AND nr = 'assistant'""")
def messages_sft(spark, d):
    both = turn_pairs(spark, d).where("answer is not null")
    m = generate.decode_messages(generate.encode_messages(generate.messages(F.col("prompt"), F.col("answer"))))
    return both.select("conv_id", "turn", m[0].content.alias("user_text"), m[1].content.alias("assistant_text"))


def _choice(options: str, key: str, seed: str) -> str:
    """sampling.choice() in SQL, place from 1."""
    return f"(('0x' || substr(md5({key}::VARCHAR || '{seed}'), 1, 8))::BIGINT % greatest(len({options}), 1) + 1)::INT"


def _swapped(label: str, wrong: str) -> str:
    once = lambda text: f"regexp_replace({text}, '(^|[^\\p{{L}}\\p{{N}}_]){label}($|[^\\p{{L}}\\p{{N}}_])', '\\1' || {wrong} || '\\2', 'gi')"
    return once(once("nt"))  # twice: a match takes the character that the next one needs


def _others(label: str) -> str:
    options = [x for x in ("the", "der", "les") if x != label]
    return f"{options}[{_choice(str(options), 'text', 'wrong')}]"


@query(
    """WITH t AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT text AS prompt, nt AS chosen, CASE """
    + " ".join(f"WHEN regexp_matches(nt, '(^|[^\\p{{L}}\\p{{N}}_]){x}($|[^\\p{{L}}\\p{{N}}_])', 'i') THEN {_swapped(x, _others(x))}" for x in ("the", "der", "les"))
    + " ELSE 'I can''t tell.' END AS rejected FROM t WHERE role = 'user' AND nr = 'assistant'"
)
def preference_rows(spark, d):
    pairs_ = turn_pairs(spark, d).where("answer is not null").withColumn("image", F.concat_ws("/", "conv_id", "turn"))
    return generate.dpo_rows(pairs_, ["the", "der", "les"], "I can't tell.").select("prompt", "chosen", "rejected")


LEVELS, SOURCES = ["low", "mid", "high"], ["click", "view", "purchase", "error", "search"]


def _asked(kind: str, answer: str, about: str = "''") -> str:
    options = str(generate.QUESTIONS[kind])
    return f"{{'question': replace({options}[{_choice(options, 'frame_id', kind)}], '{{x}}', {about}), 'answer': {answer}, 'question_type': '{kind}'}}"


def _coin(seed: str) -> str:
    return f"('0x' || substr(md5(frame_id || '{seed}'), 1, 1))::INT % 2 = 0"


def _asked_yes_no(kind: str, here: str) -> str:
    others = f"list_filter({LEVELS}, lambda x: x <> {here})"
    other = f"({others})[{_choice(others, 'frame_id', f'{kind} other')}]"
    return f"CASE WHEN {_coin(kind)} THEN {_asked(kind, chr(39) + 'Yes' + chr(39), here)} ELSE {_asked(kind, chr(39) + 'No' + chr(39), other)} END"


FRAME_QUESTIONS_SQL = f"""WITH {POINTS_SQL}, f AS (SELECT user_id || '_' || day AS frame_id, min(label) AS phase, max(label) AS step, CASE WHEN count(*) > 2 THEN 'busy' END AS note,
  list_sort(list(DISTINCT {{'name': source, 'presence': CASE WHEN y < 20 THEN 'Not visible' ELSE 'Visible' END, 'position': CASE label WHEN 'low' THEN '' ELSE label END}})) AS instruments FROM points GROUP BY user_id, day),
g AS (SELECT *, list_filter(instruments, lambda i: lower(i.presence) <> 'not visible') AS seen FROM f),
h AS (SELECT *, list_transform(seen, lambda i: i.name) AS names, list_filter(seen, lambda i: i.position <> '') AS placed, list_sort(list_distinct(list_transform(seen, lambda i: i.name))) AS present FROM g),
k AS (SELECT *, list_filter({sorted(SOURCES)}, lambda x: NOT list_contains(present, x)) AS absent FROM h),
m AS (SELECT *, placed[{_choice("placed", "frame_id", "position")}] AS one, present[{_choice("present", "frame_id", "present")}] AS there, absent[{_choice("absent", "frame_id", "absent")}] AS missing FROM k),
n AS (SELECT *, ({_coin("instrument_yesno")} AND there IS NOT NULL) OR missing IS NULL AS yes FROM m),
o AS (SELECT *, upper(substr(CASE WHEN yes THEN there ELSE missing END, 1, 1)) || substr(CASE WHEN yes THEN there ELSE missing END, 2) AS asked FROM n),
q AS (SELECT frame_id, list_filter([{_asked("phase", "phase")}, {_asked("step", "step")},
  {_asked("instrument_what", "CASE len(names) WHEN 0 THEN 'No instruments visible' WHEN 1 THEN names[1] ELSE array_to_string(names[1:-2], ', ') || ' and ' || names[-1] END")},
  {_asked("instrument_count", "CASE WHEN len(names) <= 5 THEN ['None', 'One', 'Two', 'Three', 'Four', 'Five'][len(names)::INT + 1] ELSE len(names)::VARCHAR END")},
  CASE WHEN one IS NOT NULL THEN {_asked("instrument_position", "one.position", "one.name")} END,
  {_asked("instrument_yesno", "CASE WHEN yes THEN 'Yes' ELSE 'No' END", "asked")},
  {_asked_yes_no("phase_yesno", "phase")}, {_asked_yes_no("step_yesno", "step")}, CASE WHEN note IS NOT NULL THEN {_asked("operation_note", "note")} END], lambda x: x IS NOT NULL) AS qs FROM o),
r AS (SELECT frame_id, unnest(qs) AS qa, (generate_subscripts(qs, 1) - 1)::INT AS place FROM q),
s AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY md5(frame_id || '_' || place || '42')) AS rk FROM r)
SELECT frame_id, place, qa.question AS question, qa.answer AS answer, qa.question_type AS question_type FROM s WHERE rk <= 8"""


@query(FRAME_QUESTIONS_SQL)
def frame_questions(spark, d):
    inst = F.struct(F.col("source").alias("name"), F.when(F.col("y") < 20, "Not visible").otherwise("Visible").alias("presence"), F.when(F.col("label") == "low", "").otherwise(F.col("label")).alias("position"))
    frames = points(spark, d).groupBy("user_id", "day").agg(F.array_sort(F.collect_set(inst)).alias("instruments"), F.min("label").alias("phase"), F.max("label").alias("step"), F.when(F.count("*") > 2, "busy").alias("operation_note"))
    frames = frames.withColumn("frame_id", F.concat_ws("_", "user_id", "day"))
    return generate.cap_per_frame(generate.frame_questions(frames, LEVELS, LEVELS, SOURCES))


@query(f"""WITH {POINTS_SQL}, l AS (SELECT user_id, label, count(*) AS n FROM points GROUP BY ALL HAVING count(*) >= 3), r AS (SELECT p.user_id, p.label, day, ord, row_number() OVER (PARTITION BY p.user_id, p.label ORDER BY md5(ord::VARCHAR)) AS rk FROM points p)
SELECT user_id, label, n, string_agg(day::VARCHAR, ',' ORDER BY day, ord) AS days FROM r JOIN l USING (user_id, label) WHERE rk <= 5 GROUP BY ALL""")
def temporal_tracks(spark, d):
    t = stats.timelines(points(spark, d), ["user_id", "label"], "day")
    return t.select("user_id", "label", "n", F.array_join(F.transform("times", lambda x: x.cast("string")), ",").alias("days"))
