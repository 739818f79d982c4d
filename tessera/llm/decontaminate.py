"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

A window is N consecutive words of a test item; an item with fewer words, but not none, is one window. Windows
come in blocks of at most BLOCK_WINDOWS, long items cut into pieces. A benchmark of one block is broadcast and documents
are scanned in one pass without a shuffle. Of a larger one each block is a pass of its own: a task holds one
block, writes the few documents that it hits, and the hits of all blocks are joined to the documents by a digest of
the text, which decides the hits. The driver builds one block at a time, and PASSES blocks are broadcast at a time.
A document's windows are hashed with a rolling polynomial over word ids of the block's vocabulary, looked up in the
sorted hash set, and verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, materialize, put_back, set_aside, table, text_bytes

N = 13
BLOCK_WINDOWS = 1 << 20
PASSES = 16  # blocks whose passes are one job
SHARE = 20  # contaminated: at least one word in SHARE is hit
_words = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and bytes above ASCII, A-Z lower-cased."""
    return text.translate(_words).split()


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n ids."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * _FACTOR + ids[k : len(ids) - n + 1 + k]
    return out ^ (out >> np.uint64(29))


class Block:
    """The windows of some items: by window length a sorted hash set, and the windows by hash."""

    def __init__(self, items: list[tuple[int | None, bytes | list[bytes]]], n: int = N) -> None:
        """items: (item_id, text or words). An item may come in pieces that overlap by n - 1 words."""
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[int, dict[int, list[tuple[tuple[int, ...], int]]]] = {}
        self.items = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            found = text if isinstance(text, list) else words(text)
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.uint64)
            if len(ids):
                size = min(n, len(ids))
                by_hash = self.windows.setdefault(size, {})
                for at, h in enumerate(_rolling(ids, size).tolist()):
                    entry = (tuple(ids[at : at + size].tolist()), k)
                    if entry not in (same := by_hash.setdefault(h, [])):
                        same.append(entry)
        self.hashes = {size: np.array(sorted(x), np.uint64) for size, x in self.windows.items()}

    def hits(self, document: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """(places of hit words, places of the items in self.items that occur)."""
        known = np.fromiter((self.vocabulary.get(w, 0) for w in document), np.uint64, len(document))
        unknown = np.concatenate([[0], np.cumsum(known == 0)])
        hit, found = np.zeros(len(known) + 1, np.int64), set()
        for size, hashes in self.hashes.items():
            if size > len(known):
                continue
            at = np.flatnonzero(unknown[size:] == unknown[: len(unknown) - size])
            if not len(at):
                continue
            h = _rolling(known, size)[at]
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in at[hashes[place] == h].tolist():
                window = tuple(known[i : i + size].tolist())
                same = [k for ids, k in self.windows[size][int(_rolling(known[i : i + size], size)[0])] if ids == window]
                if same:
                    found.update(same)
                    hit[i] += 1
                    hit[i + size] -= 1
        return np.flatnonzero(np.cumsum(hit[:-1]) > 0), found


def _blocks(benchmark: DataFrame, n: int) -> Iterator[Block]:
    """Blocks of the benchmark, which is the stated query set: read row by row, one block at a time."""
    items: list[tuple[int | None, list[bytes]]] = []
    held = 0
    for row in benchmark.select(F.col("item_id").cast("long"), text_bytes()).toLocalIterator():
        found = words(bytes(row[1]))
        for at in range(0, max(1, len(found) - n + 1) if found else 0, BLOCK_WINDOWS):
            piece = found[at : at + BLOCK_WINDOWS + n - 1]
            size = max(1, len(piece) - n + 1)
            if held + size > BLOCK_WINDOWS and items:
                yield Block(items, n)
                items, held = [], 0
            items.append((row[0], piece))
            held += size
    if items:
        yield Block(items, n)


HITS = {"n_words": "long", "hit_words": "array<int>", "hit_items": "array<long>"}
HIT_TYPES = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))


def _scanned(block, every: bool):  # noqa: ANN001, ANN202
    """Adds the columns HITS of one block, a broadcast or None, to rows with a text; without `every`, to rows with hits only and
    without their texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = block.value if block else None
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                batch, rows, kept = big.slice(lo, 512), [], []
                for k, text in enumerate(batch.column("text")):
                    text = text.as_py()
                    document = words(text.encode()) if text else []
                    hit, found = tool.hits(document) if tool else ((), ())
                    if every or len(hit):
                        kept.append(k)
                        rows.append((len(document), np.asarray(hit, np.int32), sorted({tool.items[i] for i in found} - {None})))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 3, HIT_TYPES)]
                if not every:
                    batch = batch.drop_columns("text").take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *HITS])

    return scan


def _fields(df: DataFrame) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *[f"{k} {v}" for k, v in HITS.items()]])


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """docs with n_words, hit_words (places of the words inside any occurrence of a window, in order) and
    hit_items (item_ids with an occurring window) in place of any columns of these names.

    A null text has no words; items without words are never hit; a null item_id is left out of
    hit_items. Repeated rows come back repeated. Without items nothing is hit. Texts of any length are scanned whole; a task holds one
    text's words.
    """
    spark, kept = docs.sparkSession, docs.drop(*HITS)
    blocks = _blocks(benchmark, n)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return kept.mapInArrow(_scanned(first and spark.sparkContext.broadcast(first), True), _fields(kept))

    # hits are those of the text, so equal texts are searched once a task and joined once
    key = [F.xxhash64("text").alias("_text"), F.hash("text").alias("_check"), F.length("text").alias("_length")]
    names = ["_text", "_check", "_length"]
    texts = kept.where("text is not null").select(*key, "text")
    found, pending, passes = None, [], chain([first, second], blocks)
    del first, second
    for block in passes:
        pending.append(spark.sparkContext.broadcast(block))
        del block
        if len(pending) == PASSES:
            found, pending = _passes(found, texts, pending), []
    if pending:
        found = _passes(found, texts, pending)
    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    hits = found.groupBy(*names).agg(joined("hit_words"), joined("hit_items"))
    keyed, moved = set_aside(kept, names)
    counted = keyed.mapInArrow(_scanned(None, True), _fields(keyed)).drop("hit_words", "hit_items")
    none = lambda c: F.coalesce(c, F.array().cast(HITS[c])).alias(c)
    rows = counted.select("*", *key).join(hits, names, "left").select(*[c for c in counted.columns if c != "n_words"], "n_words", none("hit_words"), none("hit_items"))
    return rows.withColumnsRenamed({v: k for k, v in moved.items()})


def _passes(found: DataFrame | None, texts: DataFrame, blocks: list) -> DataFrame:
    """found and the hits of blocks, written, by block and text."""
    scans = [texts.mapInArrow(_scanned(b, False), _fields(texts.drop("text"))).dropDuplicates(texts.drop("text").columns) for b in blocks]
    hits = materialize(reduce(DataFrame.union, scans), "hits")
    for b in blocks:
        b.destroy()
    return hits if found is None else found.union(hits)


def is_contaminated() -> F.Column:
    n = F.size("hit_words").cast("long")
    return (n > 0) & (SHARE * n >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, remove: str = "documents") -> DataFrame:
    """docs without contamination: contaminated documents are dropped, or ("spans") their hit words blanked out.

    With "spans" each hit word of a contaminated document goes, the characters between words stay.
    """
    columns = docs.columns
    docs, moved = set_aside(docs, [*HITS, "cut"])
    found = benchmark_hits(docs, benchmark, n)
    if remove == "documents":
        return put_back(found.where(~is_contaminated()), columns, moved)
    if remove != "spans":
        raise ValueError(remove)

    names = docs.columns

    def blank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
        for batch in batches:
            texts = []
            for text, hit in zip(batch.column("text").to_pylist(), batch.column("cut").to_pylist()):
                if hit:
                    gone, k, raw = set(hit), iter(range(1 << 62)), text.encode()
                    text = word.sub(lambda m: b"" if next(k) in gone else m[0], raw).decode()  # noqa: B023
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    cut = found.withColumn("cut", F.when(is_contaminated(), F.col("hit_words")))
    return put_back(cut.select(*docs.columns, "cut").mapInArrow(blank, docs.schema), columns, moved)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of all documents by the benchmark's windows of 13 words."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )
