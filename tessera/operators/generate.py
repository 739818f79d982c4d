"""Row generators: questions and answers, chat, preference and reward rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.points import all_tags, first_by_timestamp, point_tag
from tessera.functions.text import english_list, fill, number_word, pick
from tessera.operators.sampling import choice, coin, draw, qa_slots


def flat_points(annotations: DataFrame, confidence: float = 0.5, digits: int | None = 1) -> DataFrame:
    """One row for each timestamp with points: its first point, label in lower case, defaults where x, y or confidence lack.

    digits: time keys are rounded half to even to so many decimals; None leaves them."""
    rows = annotations.select("*", F.posexplode(first_by_timestamp("two_fps_timestamps", "points")).alias("_i", "_p"))
    ts = F.col("_p.ts") if digits is None else F.bround(F.col("_p.ts"), digits)
    put = lambda c, v: F.coalesce(c, F.lit(v))
    return rows.select("video_id", "category", ts.alias("ts"), F.lower(F.trim("label")).alias("label"), put(F.col("_p.point.x"), 50.0).alias("x"), put(F.col("_p.point.y"), 50.0).alias("y"), put(F.col("confidence"), confidence).alias("confidence"), F.struct("ord", "_i").alias("ord"))


def point_records(points: DataFrame) -> DataFrame:
    """Flat points to nested records, one each; unsure under a confidence of 0.7."""
    x, y = F.coalesce("x", F.lit(50.0)), F.coalesce("y", F.lit(50.0))
    return points.select("video_id", F.coalesce("label", F.lit("unknown")).alias("label"), F.lit(1).alias("count"), F.array("ts").alias("two_fps_timestamps"), F.array(F.array(F.struct(x.alias("x"), y.alias("y")))).alias("points"), "category", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), (F.coalesce("confidence", F.lit(0.5)) < 0.7).alias("annotator_unsure"))


def normal_instruments(kind: str, column: str) -> Column:
    """Names, structs or a map of instruments as an array of (name, presence, position)."""
    each = lambda name, presence, position: F.struct(name.alias("name"), presence.alias("presence"), position.alias("position"))
    default = lambda c, v: F.coalesce(c, F.lit(v))
    if kind == "names":
        return F.transform(column, lambda n: each(n, F.lit("Visible"), F.lit("Unknown")))
    if kind == "structs":
        return F.transform(column, lambda s: each(s["name"], default(s.presence, "Visible"), default(s.position, "Unknown")))
    if kind == "map":
        return F.transform(F.map_entries(column), lambda e: each(e.key, default(e["value"].presence, "Visible"), default(e["value"].position, "Unknown")))
    raise ValueError(kind)


#: Templates by kind of question; {x} is what the question is about.
QUESTIONS = {
    "phase": ["Which surgical phase is this?", "What phase is the operation in?"],
    "step": ["Which surgical step is this?", "What step is under way?"],
    "instrument_what": ["Which instruments are visible?", "What instruments can be seen?"],
    "instrument_count": ["How many instruments are visible?", "What is the number of instruments?"],
    "instrument_position": ["Where is the {x}?", "In which position is the {x}?"],
    "instrument_yesno": ["Is the {x} visible?", "Can the {x} be seen?"],
    "phase_yesno": ["Is this the phase {x}?", "Is {x} the phase of this frame?"],
    "step_yesno": ["Is this the step {x}?", "Is {x} under way?"],
    "operation_note": ["What is noted about the operation?", "What does the note say?"],
}


def _qa(kind: str, answer: Column, templates: dict[str, list[str]], about: Column | None = None) -> Column:
    question = pick(templates[kind], F.col("frame_id"), kind)
    question = question if about is None else fill(question, {"x": about})
    return F.struct(question.alias("question"), answer.cast("string").alias("answer"), F.lit(kind).alias("question_type"))


def _yes_no(kind: str, here: Column, options: list[str], templates: dict[str, list[str]]) -> Column:
    """By a coin what is here, or another option; what is here if there is no other."""
    other = choice(F.array_remove(F.array(*map(F.lit, options)), here), F.col("frame_id"), f"{kind} other")
    yes = coin(F.col("frame_id"), kind) | other.isNull()
    return F.when(F.coalesce(here, F.lit("")) != "", F.when(yes, _qa(kind, F.lit("Yes"), templates, here)).otherwise(_qa(kind, F.lit("No"), templates, other)))


def frame_questions(frames: DataFrame, phases: list[str], steps: list[str], instruments: list[str], templates: dict[str, list[str]] = QUESTIONS, slots: int | None = None) -> DataFrame:
    """Questions of frames (frame_id, phase, step, instruments, operation_note), one row each.

    Instruments that aren't "Not visible" count as seen (F6). A position is asked of one seen instrument that has one. Yes/no
    questions ask for what is there or, by a coin of each kind on the frame, for something that isn't. Templates and choices are
    drawn by hashes of the frame. With slots, kinds get their allotment in a fixed order; without, each kind has one (G2)."""
    frame, has = F.col("frame_id"), lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    seen = F.filter("instruments", lambda i: F.lower(F.coalesce(i.presence, F.lit(""))) != "not visible")
    names = F.transform(seen, lambda i: i["name"])
    placed = choice(F.filter(seen, lambda i: F.coalesce(i.position, F.lit("")) != ""), frame, "position")
    present = F.array_sort(F.array_distinct(F.transform(names, F.lower)))
    absent = F.array_except(F.array(*[F.lit(x) for x in sorted({x.lower() for x in instruments})]), present)
    there, missing = choice(present, frame, "present"), choice(absent, frame, "absent")
    yes = coin(frame, "instrument_yesno") & there.isNotNull() | missing.isNull()
    asked = F.initcap(F.when(yes, there).otherwise(missing))
    qa = lambda kind, answer, about=None: _qa(kind, answer, templates, about)
    kinds = {
        "phase": F.when(has("phase"), qa("phase", F.col("phase"))),
        "step": F.when(has("step"), qa("step", F.col("step"))),
        "instrument_what": F.when(F.size("instruments") > 0, qa("instrument_what", F.when(F.size(names) == 0, "No instruments visible").otherwise(english_list(names)))),
        "instrument_count": qa("instrument_count", number_word(F.size(names))),
        "instrument_position": F.when(placed.isNotNull(), qa("instrument_position", placed.position, placed["name"])),
        "instrument_yesno": F.when(asked.isNotNull(), qa("instrument_yesno", F.when(yes, "Yes").otherwise("No"), asked)),
        "phase_yesno": _yes_no("phase_yesno", F.col("phase"), phases, templates),
        "step_yesno": _yes_no("step_yesno", F.col("step"), steps, templates),
        "operation_note": F.when(has("operation_note"), qa("operation_note", F.col("operation_note"))),
    }
    if slots is not None:
        allotted = qa_slots(list(kinds), slots)
        kinds = {k: c for k, c in kinds.items() if allotted[k]}
    rows = F.array_compact(F.array(*kinds.values()))
    return frames.select("frame_id", F.posexplode(rows).alias("place", "qa")).select("frame_id", "place", "qa.*")


def cap_per_frame(questions: DataFrame, most: int = 8) -> DataFrame:
    """At most `most` questions of each frame, by hash."""
    from pyspark.sql import Window

    order = Window.partitionBy("frame_id").orderBy(draw(F.concat_ws("_", "frame_id", "place")))
    return questions.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def messages(user: Column, assistant: Column) -> Column:
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(one("user", user), one("assistant", assistant))


def encode_messages(column: Column) -> Column:
    return F.to_json(column)


def decode_messages(column: Column) -> Column:
    """P17."""
    return F.from_json(column, "array<struct<role:string,content:string>>")


def point_samples(points: DataFrame, question: str) -> DataFrame:
    """A chat for each point."""
    return points.select("video_id", "ts", messages(F.lit(question), point_tag(F.col("x"), F.col("y"), F.col("label"))).alias("messages"))


def multi_point_samples(points: DataFrame, question: str) -> DataFrame:
    """A chat with all tags of a time with two points or more, in input order."""
    rows = points.groupBy("video_id", "ts").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y", "label"))).alias("_p")).where(F.size("_p") >= 2)
    return rows.select("video_id", "ts", messages(F.lit(question), all_tags(F.col("_p"), 1)).alias("messages"))


def sft_rows(df: DataFrame) -> DataFrame:
    """(prompt, answer, image) to chats."""
    return df.select("image", messages(F.col("prompt"), F.col("answer")).alias("messages"))


def dpo_rows(df: DataFrame, labels: list[str], constant: str) -> DataFrame:
    """The rejected answer names another of labels in place of the first of them that the answer has, as a word
    and whatever its case; without one it is constant."""
    text, rejected = F.col("answer"), F.lit(constant)
    for label in reversed(labels):
        others = F.array(*[F.lit(x) for x in labels if x.lower() != label.lower()])
        word = r"(?iu)(?<![\p{L}\p{N}_])" + re.escape(label) + r"(?![\p{L}\p{N}_])"
        wrong = choice(others, F.col("prompt"), "wrong")
        rejected = F.when(text.rlike(word) & wrong.isNotNull(), F.regexp_replace(text, F.lit(word), wrong)).otherwise(rejected)
    return df.select("prompt", text.alias("chosen"), rejected.alias("rejected"), F.array("image").alias("images"))


def grpo_rows(df: DataFrame) -> DataFrame:
    truth = F.struct(*[c for c in ("phase", "step", "points", "instruments") if c in df.columns])
    return df.select("prompt", F.array("image").alias("images"), truth.alias("ground_truth"))


def route_task(qa_type: Column) -> Column:
    """the task of a question type; null rows are dropped by the caller."""
    return F.when(qa_type.isin("phase", "step"), qa_type).when(qa_type.contains("instrument"), "instrument").when(qa_type.contains("anatomy"), "anatomy")


def checked_annotations(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows; invalid ones list what they lack."""
    issues = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", f"missing {c}") for c in required]))
    rows = df.withColumn("issues", issues)
    return rows.where(F.size("issues") == 0).drop("issues"), rows.where(F.size("issues") > 0)
