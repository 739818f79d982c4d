"""Sinks (K1-K4, K6-K8, K13, K14) and small text reports (K9)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS, MOST_EXPORTED = 1000, 100_000


def put_file(spark, path: str, content: bytes) -> None:  # noqa: ANN001
    """One small file from the driver, in any store that Spark writes to."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def _exported(df: DataFrame) -> list:
    rows = df.limit(MOST_EXPORTED + 1).collect()
    if len(rows) > MOST_EXPORTED:
        raise ValueError(f"an export holds {MOST_EXPORTED} rows at most; write larger tables as lines or Parquet")
    return rows


def json_array(df: DataFrame, path: str) -> None:
    """K1: one file with an array; for small tables. json_lines() is for the others."""
    text = ",\n".join(r[0] for r in _exported(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))))
    put_file(df.sparkSession, path, f"[\n{text}\n]\n".encode())


def card(spark, folder: str, title: str, facts: dict[str, object]) -> None:  # noqa: ANN001
    """K2, K3: a README beside a dataset."""
    put_file(spark, f"{folder}/README.md", "\n".join([f"# {title}", "", *(f"- {k}: {v}" for k, v in facts.items()), ""]).encode())


def training_lines(df: DataFrame, path: str, key: str, title: str) -> None:
    """K2: JSON lines of train and validation (90/10 by hash), and a README with their sizes."""
    from tessera.operators.sampling import row_split

    rows = row_split(df, key, (0.9, 0.1, 0.0)).withColumn("split", F.when(F.col("split") == "train", "train").otherwise("validation"))
    json_lines(rows, path, "split")
    counts = {r.split: r["n"] for r in df.sparkSession.read.json(path).groupBy("split").agg(F.count("*").alias("n")).collect()}
    card(df.sparkSession, path, title, {k: counts.get(k, 0) for k in ("train", "validation")})


def vectors(df: DataFrame, path: str, by: str, vector: str = "embedding") -> None:
    """K4: a Parquet table of vectors and their columns in order of `by`, and <path>.npy with the vectors; see ranged.write_npy()."""
    from tessera.sources.ranged import write_npy

    write_npy(df, f"{path}.npy", path, by, vector)


def annotation_export(points: DataFrame, folder: str) -> None:
    """K7: raw points, point records, statistics and a report."""
    from tessera.operators.generate import point_records
    from tessera.operators.stats import annotation_statistics

    points.write.mode("overwrite").json(f"{folder}/raw")
    point_records(points).write.mode("overwrite").json(f"{folder}/points")
    found = annotation_statistics(points)
    put_file(points.sparkSession, f"{folder}/statistics.json", json.dumps(found.first().asDict()).encode())
    put_file(points.sparkSession, f"{folder}/report.md", markdown(found, "Annotations").encode())


def save_review(decisions: DataFrame, path: str) -> None:
    """Adds decisions (key, decision, ..) to a review's table."""
    decisions.write.mode("append").parquet(path)


def open_items(items: DataFrame, path: str, key: str) -> DataFrame:
    """Items without a decision yet; all of them before the first."""
    from pyspark.errors import AnalysisException

    try:
        done = items.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return items
    return items.join(done.select(key), key, "left_anti").select(*items.columns)


def json_lines(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def parquet_by_split(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def by_decision(df: DataFrame, path: str) -> None:
    """K8: one folder a decision."""
    df.write.mode("overwrite").partitionBy("decision").json(path)


def detections(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_detections(spark, path: str) -> DataFrame:  # noqa: ANN001
    """The centre is computed where it lacks."""
    df = spark.read.schema("frame_id string, label string, confidence double, bbox array<double>, center array<double>").json(path)
    centre = F.array((F.col("bbox")[0] + F.col("bbox")[2]) / 2, (F.col("bbox")[1] + F.col("bbox")[3]) / 2)
    return df.withColumn("center", F.coalesce("center", centre))


def _rows(metrics: DataFrame) -> tuple[list[str], list[list[str]]]:
    show = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    rows = metrics.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report holds {MOST_ROWS} rows at most; write larger tables as files")
    return metrics.columns, [[show(v) for v in r] for r in rows]


def markdown(metrics: DataFrame, title: str) -> str:
    """A small table of metrics; a value of 0 is printed, a missing one is a dash."""
    names, rows = _rows(metrics)
    lines = [f"# {title}", "", f"| {' | '.join(names)} |", f"|{'---|' * len(names)}", *(f"| {' | '.join(r)} |" for r in rows)]
    return "\n".join(lines) + "\n"


def latex(metrics: DataFrame, caption: str) -> str:
    names, rows = _rows(metrics)
    safe = lambda s: s.replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    body = "\n".join(" & ".join(map(safe, r)) + r" \\" for r in rows)
    return f"\\begin{{table}}\n\\caption{{{safe(caption)}}}\n\\begin{{tabular}}{{{'l' * len(names)}}}\n\\hline\n{' & '.join(map(safe, names))} \\\\\n\\hline\n{body}\n\\hline\n\\end{{tabular}}\n\\end{{table}}\n"


def html(metrics: DataFrame, title: str) -> str:
    from html import escape

    names, rows = _rows(metrics)
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{escape(c)}</{tag}>" for c in cells) + "</tr>"
    return f"<html><head><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table>{row(names, 'th')}{''.join(row(r, 'td') for r in rows)}</table></body></html>"
