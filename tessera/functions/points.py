"""Points, zones and point tags (P4-P16, P22). All are JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the format of point tags
POINT = r"<point x='([\d.]+)' y='([\d.]+)'>"
LABELLED = POINT + r"([^<]+)</point>"


def first_by_timestamp(timestamps: str, points: str) -> Column:
    """Array of (i, ts, point) for each timestamp whose list of points isn't empty; the list's first point."""
    at = F.transform(timestamps, lambda t, i: F.struct(i.alias("i"), t.alias("ts"), F.get(F.get(F.col(points), i), F.lit(0)).alias("point")))
    return F.filter(at, lambda p: p.point.isNotNull())


def zone(x: Column, y: Column, scheme: str) -> Column:
    """P5-P7: "generator" (5 = centre 40..60), "validator" (3 = centre 33..66) or "quadrant" (TL, TR, BL, BR)."""
    left, top = x < 50, y < 50
    corner = lambda a, b, c, d: F.when(left & top, a).when(~left & top, b).when(left & ~top, c).otherwise(d)
    if scheme == "generator":
        return F.when(x.between(40, 60) & y.between(40, 60), 5).otherwise(corner(1, 2, 3, 4))
    if scheme == "validator":
        return F.when(x.between(33, 66) & y.between(33, 66), 3).otherwise(corner(1, 2, 4, 5))
    if scheme == "quadrant":
        return corner("TL", "TR", "BL", "BR")
    raise ValueError(scheme)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Null if a coordinate is missing."""
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def zone_point(zone_no: Column, centres: dict[int, tuple[float, float]], key: Column, seed: str = "") -> Column:
    """A zone's centre, moved by up to 10 either way and held within 5..95, one decimal; (50, 50) without a zone.

    The move, a number of tenths, is drawn from a hash of key, so it is the same on every run."""
    number = lambda axis: F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"{seed}{axis}"))), 1, 8), 16, 10).cast("long")
    draw = lambda axis: (number(axis) % 201 - 100) / 10
    moved = lambda c, axis: F.bround(F.least(F.lit(95.0), F.greatest(F.lit(5.0), F.lit(c) + draw(axis))), 1)
    out = None
    for z, (x, y) in centres.items():
        point = F.struct(moved(x, "x").alias("x"), moved(y, "y").alias("y"))
        out = F.when(zone_no == z, point) if out is None else out.when(zone_no == z, point)
    return out.otherwise(F.struct(F.lit(50.0).alias("x"), F.lit(50.0).alias("y")))


def first_point(text: Column) -> Column:
    """(x, y) of the first point tag, null without one or if a number can't be read."""
    x, y = (F.nullif(F.regexp_extract(text, POINT, k), F.lit("")).try_cast("double") for k in (1, 2))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def has_point(text: Column) -> Column:
    return F.coalesce(text.rlike(POINT), F.lit(False))


def labelled_points(text: Column) -> Column:
    """Array of (x, y, label)."""
    parts = [F.regexp_extract_all(text, F.lit(LABELLED), F.lit(k)) for k in (1, 2, 3)]
    return F.zip_with(F.arrays_zip(parts[0].alias("x"), parts[1].alias("y")), parts[2], lambda p, t: F.struct(p.x.try_cast("double").alias("x"), p.y.try_cast("double").alias("y"), t.alias("label")))


def point_tag(x: Column, y: Column, label: Column, decimals: int | None = 1) -> Column:
    """P12; decimals None writes numbers as they are."""
    text = (lambda c: c.cast("string")) if decimals is None else (lambda c: F.format_string(f"%.{decimals}f", c))
    return F.concat(F.lit("<point x='"), text(x), F.lit("' y='"), text(y), F.lit("'>"), label, F.lit("</point>"))


def all_tags(points: Column, decimals: int | None = 3) -> Column:
    """Tags of an array of (x, y, label), joined by spaces."""
    return F.array_join(F.transform(points, lambda p: point_tag(p.x, p.y, p.label, decimals)), " ")


def frame_of(seconds: Column, fps: int = 2) -> Column:
    """P14, truncated towards zero."""
    return (seconds * fps).cast("int")


def frame_name(frame: Column) -> Column:
    return F.format_string("%05d.png", frame)


def clock_span(start: Column, end: Column) -> Column:
    """HH:MM:SS - HH:MM:SS."""
    part = lambda s: F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, F.floor(s) % 60)
    return F.concat(part(start), F.lit(" - "), part(end))


def box_centre(box: Column) -> Column:
    """Of (x1, y1, x2, y2)."""
    return F.struct(((box.x1 + box.x2) / 2).alias("x"), ((box.y1 + box.y2) / 2).alias("y"))


def to_pixel(x: Column, size: Column) -> Column:
    return (x * size).cast("int")


def point_box(x: Column, y: Column, half: float = 0.05) -> Column:
    """A box around a point, held within 0..1."""
    low, high = (lambda c: F.greatest(F.lit(0.0), c - half)), (lambda c: F.least(F.lit(1.0), c + half))
    return F.struct(low(x).alias("x1"), low(y).alias("y1"), high(x).alias("x2"), high(y).alias("y2"))


def pointed_in_text(text: Column, half: float = 0.05, confidence: float = 0.5) -> Column:
    """The points of the JSON between the first { and the last }, as (label, confidence, box); unreadable text has none."""
    found = json_in_text(text, "braces").annotations
    one = lambda a: F.struct(a.label.alias("label"), F.coalesce(a.confidence, F.lit(confidence)).alias("confidence"), point_box(a.x, a.y, half).alias("box"))
    return F.coalesce(F.transform(F.filter(found, lambda a: a.x.isNotNull() & a.y.isNotNull()), one), F.array().cast("array<struct<label:string,confidence:double,box:struct<x1:double,y1:double,x2:double,y2:double>>>"))


ANNOTATIONS = "struct<annotations:array<struct<label:string,x:double,y:double,confidence:double,category:string>>>"


def json_in_text(text: Column, variant: str, schema: str = ANNOTATIONS) -> Column:
    """JSON in model text, null if it can't be read. "braces": first { to last }; "fence": between the first and
    second fence, json fences first, else the whole text."""
    if variant == "braces":
        body = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    elif variant == "fence":
        of = lambda mark: F.split_part(F.split_part(text, F.lit(mark), F.lit(2)), F.lit("```"), F.lit(1))
        body = F.trim(F.when(text.contains("```json"), of("```json")).when(text.contains("```"), of("```")).otherwise(text))
        body = F.when(body.rlike(r"(?s)^\s*[\[{].*[\]}]\s*$"), body)
    else:
        raise ValueError(variant)
    return F.from_json(body, schema)
