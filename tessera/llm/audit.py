"""Filter interaction audit: what each filter removes alone, after others, and in every order.

Texts are scanned in their Arrow buffers, PART_BYTES at a time and a longer text alone:

* a table of byte classes marks spaces, capitals, symbols and first bytes of code points; prefix sums of a class, read
  at the texts' ends, give each text's counts, and words are the edges of the class of spaces;
* words are hashed by prefix sums too. In each text the hashes are sorted; a word equal to the one before it in that
  order is counted once, after its bytes are compared, eight at a time. Where hashes agree and bytes don't, the text's
  words are counted as they are, so the number of distinct words is exact;
* equal texts share a SHA-256.

Texts don't leave the scan: what is shuffled is a row of counts for each document, and equal rows are counted before. The
documents that repeat none with a smaller doc_id are found by a join on digest *and* doc_id, so a text that fills the
table is no hot key. What is left is one row for each part with the numbers of documents by failure mask, from
which every order's figures follow by sums over masks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chunks import _M1, mix, prefix_sums, shifts_back
from tessera.llm.common import documents, materialize, table

PART_BYTES = 1 << 22
LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10
SYMBOLS = b"#$%&*|"

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_FIRST = (np.arange(256) & 0xC0) != 0x80
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _M1)

LONG_WORD = 256  # bytes; longer repeated words are compared one by one


def _counted(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text the number of marked bytes, from a prefix sum."""
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return np.diff(sums[offsets])


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[starts[i]:ends[i]]."""
    sums = prefix_sums(data, _BYTES, np.stack([starts, ends], axis=1).reshape(-1))
    return mix((sums[1::2] - sums[::2]) * shifts_back(starts) + (ends - starts).astype(np.uint64))


def _equal_words(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether data[a:a + n] and data[b:b + n] are equal, for each of the words a, b."""
    same = np.ones(len(a), bool)
    short = np.flatnonzero(n <= LONG_WORD)
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", raw, 0, (1,))  # the eight bytes from each place on
    at = 0
    while len(short):
        rest = n[short] - at
        keep = np.where(rest >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.clip(rest, 0, 7)).astype(np.uint64)) - np.uint64(1))
        same[short] &= ((eight[a[short] + at] ^ eight[b[short] + at]) & keep) == 0
        at += 8
        short = short[rest > 8]
    for k in np.flatnonzero(n > LONG_WORD).tolist():
        same[k] = data[a[k] : a[k] + n[k]].tobytes() == data[b[k] : b[k] + n[k]].tobytes()
    return same


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hash_of=_hashes) -> np.ndarray:  # noqa: ANN001
    """Of each text the number of its distinct words; text k has the words first[k] to first[k + 1]."""
    n_words = np.diff(first)
    if not len(starts):
        return n_words
    hashes, text = hash_of(data, starts, ends), np.repeat(np.arange(len(n_words)), n_words)
    order = np.argsort(hashes)
    order = order[np.argsort(text[order].astype(np.uint16 if len(n_words) < 1 << 16 else np.int64), kind="stable")]
    h, t = hashes[order], text[order]
    again = np.flatnonzero((h[1:] == h[:-1]) & (t[1:] == t[:-1]))
    x, y = order[again], order[again + 1]
    n = ends[x] - starts[x]
    same = n == ends[y] - starts[y]
    same[same] = _equal_words(data, starts[x[same]], starts[y[same]], n[same])
    out = n_words - np.bincount(t[again], minlength=len(n_words))
    for k in np.unique(t[again[~same]]).tolist():  # two words with one hash
        out[k] = len({data[a:b].tobytes() for a, b in zip(starts[first[k] : first[k + 1]].tolist(), ends[first[k] : first[k + 1]].tolist())})
    return out


def counts_of(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of the texts data[offsets[k]:offsets[k + 1]], UTF-8 bytes."""
    space = _SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    np.not_equal(space[1:], space[:-1], out=edge[1:-1])
    edge[offsets] = True
    edge = np.flatnonzero(edge)
    is_word = ~space[edge[:-1]] if len(data) else np.zeros(0, bool)
    starts, ends = edge[:-1][is_word], edge[1:][is_word]
    first = np.searchsorted(starts, offsets)
    return {
        "n_words": np.diff(first),
        "n_distinct": distinct_words(data, starts, ends, first),
        "n_capitals": _counted(_CAPITAL[data], offsets),
        "n_chars": _counted(_FIRST[data], offsets),
        "n_symbols": _counted(_SYMBOL[data], offsets),
    }


COUNTS = ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols")


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of strings without nulls."""
    _, ends, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if ends else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, data = _buffers(batch.column("_text"))
        others = batch.drop_columns("_text")
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PART_BYTES, "right")) - 1)
            part, at = data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
            found = counts_of(part, at)
            raw = memoryview(part)
            digests = pa.array([hashlib.sha256(raw[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
            own = others.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(found[c].astype(np.int64)) for c in COUNTS), digests], [*own.schema.names, *COUNTS, "digest"])
            lo = hi


def text_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, the counts COUNTS of their whole texts and the SHA-256 `digest` of each.

    A null text counts as an empty one. Other columns are left out, so none can clash; `keep` names none of the results.
    """
    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"]
    return rows.mapInArrow(_scan, ", ".join([*fields, *(f"{c} long" for c in COUNTS), "digest binary"]))


def failures() -> list[Column]:
    """The conditions of the filters A to D on text_counts(); E, a text that a smaller doc_id has, is not one row's."""
    return [
        F.col("n_words") < MIN_WORDS,
        100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n_words"),
        100 * F.col("n_capitals") > MAX_CAPITALS * F.col("n_chars"),
        F.col("n_symbols") > 0,
    ]


def masked(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): numbers of documents of each part by failure mask, and of those with quality = 1 and toxic = 1.

    Bit k of a mask is the k-th of LETTERS. A null part counts as an empty string. Documents without doc_id have no label and
    fail E never; repeated rows count each, and fail E only if a smaller doc_id has their text. A document is good or
    toxic if any of its labels says so.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    counted = text_counts(rows, ["doc_id", "part"])
    bits = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(failures())]
    # documents without doc_id need no digest, so that they are counted, not gathered
    digest = F.when(F.col("doc_id").isNotNull(), F.col("digest"))
    own = counted.select("doc_id", "part", sum(bits[1:], bits[0]).alias("mask"), digest.alias("digest")).groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    own = materialize(own, "audit")

    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("is_good"), flag("toxic").alias("is_toxic"))
    named, nameless = own.where("doc_id is not null"), own.where("doc_id is null")
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("is_good")).alias("good"), F.sum(F.col("n") * F.col("is_toxic")).alias("toxic")]
    least = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    judged = named.join(least, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    judged = judged.select("part", (F.col("mask") + F.when(F.col("is_first"), 0).otherwise(1 << 4)).alias("mask"), "n", zero("is_good"), zero("is_toxic"))
    return judged.union(nameless.select("part", "mask", "n", F.lit(0), F.lit(0))).groupBy("part", "mask").agg(*sums)


def interactions(cube: DataFrame, letters: str = LETTERS) -> DataFrame:
    """For each part, order of the filters and step: what the step's filter removes, and what would be removed without it.

    cube: (part, mask, n, good, toxic) with one row a mask. Every part has all orders and steps, zeros included.
    """
    masks = range(1 << len(letters))
    at = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in masks]).alias(c)
    parts = cube.groupBy("part").agg(at("n"), at("good"), at("toxic"))
    orders = ["".join(o) for o in permutations(letters)]
    bit = lambda k: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), F.substring("filter_order", k, F.lit(1))) - 1)
    rows = parts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    earlier_bits = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(len(letters))), 1, F.col("step") - 1), F.lit(0), lambda sofar, k: sofar + bit(k))
    rows = rows.withColumns({"own": bit(F.col("step")), "before": earlier_bits})
    every = F.sequence(F.lit(0), F.lit(len(masks) - 1))

    def over(c: str, test, weight=None) -> Column:  # noqa: ANN001
        """The sum of an array over the masks that pass a test."""
        term = lambda m: F.when(test(m), F.element_at(c, m + 1) * (weight(m) if weight else F.lit(1))).otherwise(F.lit(0))
        return F.aggregate(every, F.lit(0).cast("long"), lambda sofar, m: sofar + term(m).cast("long"))

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    earlier = lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~earlier(m)
    return rows.select(
        "part",
        "filter_order",
        "step",
        over("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        over("n", here).alias("removed"),
        over("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        over("n", lambda m: m == F.col("own")).alias("unique_fails"),
        over("good", here).alias("good_lost"),
        over("toxic", here).alias("toxic_lost"),
        # of a document that fails k filters each is the first in one of k orders
        over("n", fails, lambda m: (F.lit(len(orders)) / F.bit_count(m)).cast("long")).alias("shapley"),
    )


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all 120 orders, by language.

    Null and empty texts have no words; null languages are the part "". Texts of any length are scanned whole. Repeated rows and
    null doc_ids: see masked(). Other columns are ignored; an empty table gives no rows, empty labels lose nothing.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return interactions(masked(docs, table(spark, sf_dir, "labels")))


SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), tests AS (
    SELECT doc_id, part,
        CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
        + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INT)
        + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
        + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INT) AS mask
    FROM words
), marks AS (
    SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), cube AS (
    SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM tests LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), letters AS (
    SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)
), orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
        AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
    SELECT filter_order, CAST(s AS INT) AS step, bits[s] AS own, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS earlier FROM orders, range(1, 6) r(s)
)
SELECT part, filter_order, step,
    CAST(coalesce(sum(n) FILTER (mask & own = 0 AND mask & earlier = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier <> 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (mask & own <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS toxic_lost,
    CAST(coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & own <> 0), 0) AS BIGINT) AS shapley
FROM cube, steps GROUP BY part, filter_order, step
"""
