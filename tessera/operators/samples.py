"""Chat samples from ground truth, points and segments (J6, G5-G11, G13, G15, W11). Random choices are hashes of the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.points import clock_span, labelled_points, point_tag, zone_point
from tessera.functions.text import display_name, fill, pick
from tessera.operators.filters import NO_PRIMARY, second_instrument, visible_instrument
from tessera.operators.generate import messages, route_task
from tessera.operators.matching import last_per_key
from tessera.operators.sampling import draw, every_nth
from tessera.operators.stats import computed_once

#: Templates of questions; {x} is what is asked for.
POINT_QUESTIONS = ["Point to the {x}.", "Where is the {x}?", "Show the {x} in this image."]
DESCRIBE_QUESTIONS = ["Which instruments are in this image, and where?", "Name the instruments and their places."]
# fixed values: the wording of answers that later readers of the samples parse
PRIMARY, SECONDARY, PRIMARY_PLAIN, SECONDARY_PLAIN, STEP = "**Primary instrument:** ", "**Secondary:** ", "Primary instrument: ", "Secondary: ", "Current step: "
TRACK_QUESTION, TRACK_HEAD, TRACK_TAIL = "Track the {x} across multiple frames in this surgical video.", "Tracking **", "** movement:"
IMAGE, VIDEO = "<image>\n", "<video>\n"


def _asked(templates: list[str], key: Column, seed: str, about: Column | None = None) -> Column:
    question = pick(templates, key, seed)
    return question if about is None else fill(question, {"x": about})


def _tag(point: Column, name: Column) -> Column:
    return point_tag(point.x, point.y, name, None)


def truth_samples(truth: DataFrame, centres: dict[int, tuple[float, float]], names: dict[str, str] = {}, every: int = 10, fps: int = 2) -> DataFrame:  # noqa: B006
    """Of truth (video, int_time, str_instrument1, str_instrument2, pos_instrument1, pos_instrument2, ord) the first row of every
    nth time of a video gives a pointing sample, where there is a zone, and a sample of two instruments, where a second has one."""
    rows = every_nth(truth, ["video"], "int_time", every).where(visible_instrument(F.col("str_instrument1")))
    key = F.concat_ws("_", "video", "int_time")
    place = lambda c, seed: zone_point(F.col(c).cast("int"), centres, key, seed)
    first, second = display_name(F.col("str_instrument1"), names), display_name(F.col("str_instrument2"), names)
    has = F.coalesce(F.col("pos_instrument1").cast("string"), F.lit("")) != ""
    p, q, r = place("pos_instrument1", "point"), place("pos_instrument1", "first"), place("pos_instrument2", "second")
    one = F.struct(F.lit("instrument_pointing").alias("kind"), messages(F.concat(F.lit(IMAGE), _asked(POINT_QUESTIONS, key, "point", first)), _tag(p, first)).alias("messages"), F.array(first).alias("labels"))
    answer = F.concat(F.lit(PRIMARY), _tag(q, first), F.lit("\n" + SECONDARY), _tag(r, second))
    two = F.struct(F.lit("dual_instrument").alias("kind"), messages(F.concat(F.lit(IMAGE), _asked(DESCRIBE_QUESTIONS, key, "both")), answer).alias("messages"), F.array(first, second).alias("labels"))
    samples = F.array_compact(F.array(F.when(has, one), F.when(second_instrument(F.col("str_instrument2"), F.col("pos_instrument2")), two)))
    out = rows.select("video", "int_time", F.explode(samples).alias("s"))
    return out.select(F.format_string("video_%02d", F.col("video").cast("int")).alias("video_id"), F.col("int_time").alias("frame_index"), (F.col("int_time") / fps).alias("timestamp"), "s.*", F.lit("ground_truth").alias("source"))


def description_samples(rows: DataFrame, centres: dict[int, tuple[float, float]], names: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """Of truth rows with a step, one sample with what is visible and the step; none where there is nothing to say.

    The second instrument passes without a zone here, whose centre is (50, 50) then."""
    key = F.concat_ws("_", "video", "int_time")
    place = lambda c, seed: zone_point(F.col(c).cast("int"), centres, key, seed)
    first, second = display_name(F.col("str_instrument1"), names), display_name(F.col("str_instrument2"), names)
    named = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    parts = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("str_instrument1"), F.lit("")).isin(*NO_PRIMARY), F.concat(F.lit(PRIMARY_PLAIN), _tag(place("pos_instrument1", "first"), first))),
        F.when(named("str_instrument2") & second_instrument(F.col("str_instrument2"), strict=False), F.concat(F.lit(SECONDARY_PLAIN), _tag(place("pos_instrument2", "second"), second))),
        F.when(named("str_step"), F.concat(F.lit(STEP), F.translate("str_step", "_", " "))),
    ))
    found = computed_once(rows, F.col("video"), F.col("int_time"), F.col("str_step").alias("step"), _asked(DESCRIBE_QUESTIONS, key, "describe").alias("_q"), parts.alias("_parts"))
    chat = messages(F.concat(F.lit(IMAGE), F.col("_q")), F.array_join("_parts", "\n"))
    return found.where(F.size("_parts") > 0).select("video", "int_time", "step", chat.alias("messages"))


def tracking_samples(points: DataFrame, by: str = "video_id", time: str = "ts", least: int = 3, keep: int = 5) -> DataFrame:
    """For each label of a video with `least` points or more a sample that follows it through `keep` of them, drawn by hash,
    in order of time. Draws are made by a bounded rank, so no task gathers a long timeline."""
    n = points.groupBy(by, "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    drawn = F.row_number().over(Window.partitionBy(by, "label").orderBy(draw(F.col("ord"), ""), "ord"))
    kept = points.withColumn("_k", drawn).where(F.col("_k") <= keep)
    lists = kept.groupBy(by, "label").agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), "ord", "x", "y", "category"))).alias("p"))
    line = lambda p: F.concat(F.format_string("- t=%.1fs: ", p.t.cast("double")), point_tag(p.x, p.y, F.col("label")))
    answer = F.concat_ws("\n", F.concat(F.lit(TRACK_HEAD), "label", F.lit(TRACK_TAIL)), F.transform("p", line))
    question = F.concat(F.lit(VIDEO), fill(F.lit(TRACK_QUESTION), {"x": F.col("label")}))
    return lists.join(n, [by, "label"]).select(by, "label", messages(question, answer).alias("messages"), F.transform("p", lambda p: p.t).alias("timestamps"), F.get("p", F.lit(0)).category.alias("category"), F.size("p").alias("num_frames"))


def leading(points: Column, most: dict[str, int]) -> Column:
    """The first points of each category, category by category (2 instruments and 3 anatomy, say)."""
    of = lambda c: F.filter(points, lambda p: p.category == c)  # noqa: E731  a lambda of two parameters would get the place
    return F.concat(*[F.slice(of(c), 1, n) for c, n in most.items()])


def scene_samples(points: DataFrame, most: dict[str, int], headings: dict[str, str], question: str) -> DataFrame:
    """For each time of a video with two points or more a sample that lists the leading ones under headings; none without any."""
    rows = points.groupBy("video_id", "ts").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y", "label", "category"))).alias("p")).where(F.size("p") >= 2)
    part = lambda c: F.slice(F.filter("p", lambda q: q.category == c), 1, most[c])
    lines = F.array_compact(F.array(*[F.when(F.size(part(c)) > 0, F.concat(F.lit(headings[c]), F.array_join(F.transform(part(c), lambda q: point_tag(q.x, q.y, q.label)), ", "))) for c in most]))
    return rows.where(F.size(lines) > 0).select("video_id", "ts", messages(F.lit(question), F.array_join(lines, "\n")).alias("messages"))


def image_samples(images: DataFrame, truth: DataFrame, annotations: DataFrame, centres: dict[int, tuple[float, float]], names: dict[str, str] = {}, keys: tuple[str, str] = ("video_id", "frame")) -> DataFrame:  # noqa: B006
    """For each image (video_id, frame, image, ord; the last of a frame counts) its samples from ground truth (instrument1,
    instrument2, zone1, zone2; the last row of a frame) and one for each annotation (ord, label, category, x, y).

    Two left joins on the frame, and three projections."""
    k = list(keys)
    index = last_per_key(images, k).select(*k, "image")
    key, none = F.concat_ws("_", *k), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    known = index.join(last_per_key(truth, k), k, "left")
    place = lambda c, seed: zone_point(F.col(c).cast("int"), centres, key, seed)
    first, second = display_name(F.col("instrument1"), names), display_name(F.col("instrument2"), names)
    p, q, r = place("zone1", "point"), place("zone1", "first"), place("zone2", "second")
    out = lambda df, kind, chat, source: df.select(*k, "image", kind.alias("annotation_type"), F.lit(source).alias("source"), chat.alias("messages"))
    one = out(known.where((none("instrument1") != "") & (none("zone1") != "")), F.lit("instrument_pointing"), messages(_asked(POINT_QUESTIONS, key, "point", first), _tag(p, first)), "ground_truth")
    both = F.concat(F.lit("Primary: "), _tag(q, first), F.lit("\nSecondary: "), _tag(r, second))
    two = out(known.where(second_instrument(F.col("instrument2"), F.col("zone2"))), F.lit("dual_instrument"), messages(_asked(DESCRIBE_QUESTIONS, key, "both"), both), "ground_truth")
    marked = index.join(annotations, k)
    own = F.concat_ws("_", *k, "ord")
    three = out(marked, F.concat("category", F.lit("_pointing")), messages(_asked(POINT_QUESTIONS, own, "point", F.col("label")), point_tag(F.col("x"), F.col("y"), F.col("label"))), "model")
    return one.unionByName(two).unionByName(three)


def understanding_samples(frames: DataFrame, instruments: list[str]) -> DataFrame:
    """Of frames (frame_id, instruments array<string>, phase, step) a pointing sample for each known instrument (F16), whose point
    (0.5, 0.5) stands for one to be annotated, and samples of the phase and the step."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    row = lambda kind, q, a: F.struct(F.lit(kind).alias("kind"), q.alias("question"), a.alias("answer"))
    known = F.filter("instruments", lambda i: i.isin(*instruments))
    where = lambda i: F.concat(F.lit("The "), i, F.lit(" is at: "), point_tag(F.lit(0.5), F.lit(0.5), i))
    pointing = F.transform(known, lambda i: row("pointing", fill(pick(POINT_QUESTIONS, F.concat(F.col("frame_id"), i)), {"x": i}), where(i)))
    rest = F.array_compact(F.array(
        F.when(has("phase"), row("phase", F.lit("Which phase does this image show?"), F.concat(F.lit("The phase is "), "phase", F.lit(".")))),
        F.when(has("step"), row("step", F.lit("Which step does this image show?"), F.concat(F.lit("The step is "), "step", F.lit(".")))),
    ))
    return frames.select("frame_id", F.posexplode(F.concat(pointing, rest)).alias("place", "s")).select("frame_id", "place", "s.*")


def segment_samples(segments: DataFrame) -> DataFrame:
    """Of segments (label, start_time, end_time in seconds) a question for the begin and one for the duration, in minutes."""
    begin = F.split_part(clock_span(F.col("start_time"), F.col("end_time")), F.lit(" - "), F.lit(1))
    minutes = F.format_string("%.1f", (F.col("end_time") - F.col("start_time")) / 60)
    row = lambda kind, q, a: F.struct(F.lit(kind).alias("kind"), q.alias("question"), a.alias("answer"))
    both = F.array(
        row("temporal_grounding", F.concat(F.lit("When does "), "label", F.lit(" begin?")), F.concat("label", F.lit(" begins at "), begin, F.lit("."))),
        row("temporal_duration", F.concat(F.lit("How long does "), "label", F.lit(" last?")), F.concat("label", F.lit(" lasts "), minutes, F.lit(" minutes."))),
    )
    return segments.select("label", F.explode(both).alias("s")).select("label", "s.*")


def task_samples(df: DataFrame, kind: str) -> DataFrame:
    """Rows with an image and messages, and their task; kinds without a task go."""
    return df.where("image is not null and size(messages) > 0").withColumn("task_type", route_task(F.lower(kind))).where("task_type is not null")


def spatial_samples(df: DataFrame) -> DataFrame:
    """(image, messages, video_id, frame_id, task_type, points) of rows (image, messages, video_id, frame_id, annotation_type): those with an
    image and messages whose annotation type names instruments or anatomy. messages is text, arrays as JSON; points are the labelled points in the
    assistant's messages, in order, none where messages were text already."""
    kind = df.schema["messages"].dataType.simpleString()
    there, text = (F.col("messages") != "", F.col("messages")) if kind == "string" else (F.size("messages") > 0, F.to_json("messages"))
    said = F.lit("") if kind == "string" else F.array_join(F.transform(F.filter("messages", lambda m: m.role == "assistant"), lambda m: m.content), "\n")
    rows = df.where(F.col("image").isNotNull() & (F.col("image") != "") & there)
    rows = rows.select("image", text.alias("messages"), F.coalesce("video_id", F.lit("")).alias("video_id"), F.coalesce("frame_id", F.lit("")).alias("frame_id"), route_task(F.lower("annotation_type")).alias("task_type"), labelled_points(said).alias("points"))
    return rows.where("task_type in ('instrument', 'anatomy')")
