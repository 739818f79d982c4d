"""A training corpus from `documents`: five stages, each written as Parquet and read again as the next one's input.

1. language ID: documents without a language, or with most letters in scripts of no known language, go.
2. line dedup: lines that repeat an earlier line, exactly or nearly, go; documents stay, emptied ones too.
3. SimHash near-dedup: of each group of near-duplicates, emptied documents among them, the one with the smallest doc_id stays.
4. benchmark decontamination: documents of which a twentieth of the words lies in benchmark windows go.
5. SentencePiece: texts become piece ids; `text` is what the ids decode to. Columns called ids or n_tokens are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, materialize, table
from tessera.llm.decontaminate import decontaminate
from tessera.llm.language import keep_identified, train_on_folds
from tessera.llm.lines import dedup_lines
from tessera.llm.pieces import default_path, encode_pieces
from tessera.llm.simhash import simhash_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs, train_on_folds(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = ["ids", "n_tokens", "decoded"]
    found = encode_pieces(docs, default_path(), decode=True)
    others = [c for c in docs.columns if c.lower() not in (*own, "text", "nbest")]
    return found.select(*others, F.col("decoded").alias("text"), "n_tokens", "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", near_dedup),
    ("decontaminate", decontamination),
    ("sentencepiece", sentencepiece),
]

#: No stage but a filter can be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
