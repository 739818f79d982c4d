"""Reward components (P41): pointing, phase, step, instrument, format and their weighted total."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.points import labelled_points

WEIGHTS = {"pointing": 0.3, "phase": 0.2, "step": 0.2, "instrument": 0.2, "format": 0.1}


def pointing(text: Column, truth: Column, within: float = 0.1, empty: float = 0.0) -> Column:
    """Share of predicted points with a labelled truth point (x, y, label) within reach; empty: without any point on either side."""
    found = labelled_points(text)
    near = lambda p, g: (F.length(g.label) > 0) & F.lower(p.label).contains(F.lower(g.label)) & (F.sqrt((p.x - g.x) ** 2 + (p.y - g.y) ** 2) < within)
    hits = F.size(F.filter(found, lambda p: F.exists(truth, lambda g: near(p, g))))
    truths = F.coalesce(F.size(truth), F.lit(0))
    return F.when((F.size(found) == 0) & (truths == 0), empty).when(F.size(found) == 0, 0.0).when(truths == 0, 0.5).otherwise(hits / F.greatest(F.size(found), truths))


def mentions(text: Column, label: Column, empty: float = 0.5) -> Column:
    plain = F.translate(F.lower(label), "_", " ")
    return F.when(F.coalesce(plain, F.lit("")) == "", empty).when(F.lower(text).contains(plain), 1.0).otherwise(0.0)


def instruments(text: Column, names: Column) -> Column:
    n = F.coalesce(F.size(names), F.lit(0))
    hits = F.size(F.filter(names, lambda x: F.lower(text).contains(F.translate(F.lower(x), "_", " "))))
    return F.when(n == 0, 0.5).otherwise(hits / n)


def form(text: Column, truth: Column, variant: str = "class") -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    if variant == "script":
        score = F.when(F.coalesce(F.size(truth), F.lit(0)) == 0, 0.5).when(text.contains("<point"), 1.0).otherwise(0.0)
        return F.when(words.between(10, 200), (score + 1) / 2).otherwise(score)
    length = F.when(words.between(10, 200), 1.0).when((words < 5) | (words > 500), 0.0).otherwise(0.5)
    tags = F.when(text.contains("<point") & text.contains("</point>"), 1.0).otherwise(0.0)
    return F.when(F.coalesce(F.size(truth), F.lit(0)) > 0, (tags + length) / 2).otherwise(length)


def rewards(text: Column, points: Column, phase: Column, step: Column, names: Column, variant: str = "class") -> dict[str, Column]:
    """All components and "total". variant "script" takes 0 for an empty phase or step, and 0.5 without any points."""
    empty, none = {"class": (0.5, 0.0), "script": (0.0, 0.5)}[variant]
    parts = {"pointing": pointing(text, points, empty=none), "phase": mentions(text, phase, empty), "step": mentions(text, step, empty), "instrument": instruments(text, names), "format": form(text, points, variant)}
    return parts | {"total": sum((F.lit(w) * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0))}
