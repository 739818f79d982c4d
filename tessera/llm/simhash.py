"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two fingerprints that differ in at most three bits differ in at most
three bytes, so they share at least MIN_SHARED = 5 positional bytes. A plain index of single
positional bytes has posting lists of one 256th of the corpus; pairs drawn from them grow with the
square of the input. The index here posts each fingerprint under eight *triples* of positional bytes
(COVER): of any five positions out of eight, one triple of COVER is contained whole, so no pair is
lost. In a list, the shared positional bytes of a pair are tallied, pairs below five are dropped,
and the rest are verified by their differing bits. (Three differing bits or fewer imply five shared bytes, so the
tally is a cheap first test that spares most pairs the second; it decides no pair alone.)

Lists above LIST_CAP members are not capped: their members are posted again under all sets of five
positions that the triple stands for (40 shared bits), and lists that are still large once more under
triples of the remaining nibbles (52 shared bits). A list of the last level has at most 4096 distinct
fingerprints, whatever the corpus holds. A list is searched breadth first and yields one
row per linked member, never its pairs.

Equal fingerprints are one node. Components come from alternating large-star and small-star
rounds on the linked nodes, each round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, documents, materialize, put_back, set_aside, text_bytes

SEED = 42
WORDS_IN_SHINGLE = 3
MAX_BITS = 3
MIN_SHARED = 8 - MAX_BITS
LIST_CAP = 256
CHUNK = 1 << 15
HOT_SHARE = 2048  # a fingerprint with one row in so many is hot; there are HOT_SHARE of them at most


def _mask(positions: tuple[int, ...], width: int = 8) -> int:
    return sum(((1 << width) - 1) << (width * p) for p in positions)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


COVER = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]
#: For each triple the sets of five positions of which it is the first triple.
FIVES = [[s for s in combinations(range(8), MIN_SHARED) if next(c for c in COVER if set(c) <= set(s)) == t] for t in COVER]


def fingerprint(text: bytes) -> int:
    """SimHash of the three-word shingles of a text, A-Z lower-cased; 0 without words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n < WORDS_IN_SHINGLE:
        return h(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[WORDS_IN_SHINGLE - 1 :].tolist()
    starts = starts[: n - WORDS_IN_SHINGLE + 1].tolist()
    total = np.zeros(64, np.int64)
    for lo in range(0, len(ends), CHUNK):
        part = [h(joined[a:b], SEED) for a, b in zip(starts[lo : lo + CHUNK], ends[lo : lo + CHUNK])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(ends), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_signed(fingerprint(x)) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])


def _keyed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_signed(fingerprint((x or "").encode())) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_text"), pa.array(found, pa.int64())], ["doc_id", "_text", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def linked_in_list(fps: np.ndarray) -> list[tuple[int, int]]:
    """(member, smallest member of its component) for the linked members of a posting list."""
    out = []
    rest = np.sort(fps)
    while len(rest) > 1:
        queue, rest, root = [rest[0]], rest[1:], rest[0]
        while queue and len(rest):
            x = np.bitwise_xor(rest, queue.pop())
            shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = shared >= MIN_SHARED
            near[near] = np.bitwise_count(x[near].view(np.uint64)) <= MAX_BITS
            if near.any():
                queue += list(rest[near])
                out += [(int(m), int(root)) for m in rest[near]]
                rest = rest[~near]
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("fps")
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy())
        found, at = [], 0
        for end in ends.tolist():
            found += linked_in_list(flat[at:end])
            at = end
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])


def _lists(entries: DataFrame) -> DataFrame:
    """entries (mask, v, fp, ...) with the length n of their posting list, where that is 2 or more."""
    return entries.join(entries.groupBy("mask", "v").agg(F.count("*").alias("n")).where("n > 1"), ["mask", "v"])


def _post(members: DataFrame, masks) -> DataFrame:
    """Posts each fp under each of masks, an array column of longs."""
    return members.select("fp", "mask_id", F.explode(masks).alias("mask")).withColumn("v", F.col("fp").bitwiseAND(F.col("mask")))


def links(nodes: DataFrame) -> DataFrame:
    """Rows (u, v), u > v, that connect the fingerprints of nodes (fp, distinct) as their links do."""
    triples = F.array(*[F.lit(_signed(_mask(t))) for t in COVER])
    first = _lists(
        nodes.select("fp", F.posexplode(triples).alias("mask_id", "mask")).withColumn("v", F.col("fp").bitwiseAND(F.col("mask")))
    )
    fives = F.array(*[F.array(*[F.lit(_signed(_mask(s))) for s in group]) for group in FIVES])
    second = _lists(_post(first.where(F.col("n") > LIST_CAP), F.element_at(fives, F.col("mask_id") + 1)))
    hot = second.where(F.col("n") > LIST_CAP)
    # the six nibbles of the three open bytes, by the mask of the five shared ones
    open_nibbles = {
        _signed(_mask(s)): [_signed(_mask(s) | _mask(tuple(c), 4)) for c in combinations([2 * p + k for p in range(8) if p not in s for k in (0, 1)], 3)]
        for group in FIVES
        for s in group
    }
    third_masks = F.create_map(*[x for k, v in open_nibbles.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    third = _lists(_post(hot.withColumn("mask_id", F.lit(0)), third_masks[F.col("mask")]))
    kept = [first.where(F.col("n") <= LIST_CAP), second.where(F.col("n") <= LIST_CAP), third]
    lists = [x.groupBy("mask", "v").agg(F.collect_set("fp").alias("fps")).select("fps") for x in kept]
    return lists[0].union(lists[1]).union(lists[2]).mapInArrow(_search, "u long, v long").distinct()


def _min_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(u, root) for every node of edges (u, v): root is the smallest node of its component.

    Alternating large-star and small-star rounds until nothing changes. Stars are made by joins with
    the smallest neighbour, so a hub with many neighbours is never gathered in one row.
    """
    edges = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_min_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = large.join(_min_neighbour(large), "u")
        stars = small.select("v", "m").union(small.select("u", "m")).toDF("a", "b").where("a != b").distinct()
        before, edges = edges, materialize(stars.select(F.col("a").alias("u"), F.col("b").alias("v")), "stars")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        if now == state:
            return edges.select("u", F.col("v").alias("root"))
        state = now
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")


def _labelled(prints: DataFrame) -> DataFrame:
    """prints (doc_id, fp, ...) with the root (a fingerprint) and the component_id of their fingerprints.

    Rows of hot fingerprints get it from a broadcast of HOT_SHARE rows at most, so that no task gathers them.
    """
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    roots = components(links(nodes.select("fp")))
    labelled = nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = materialize(labelled.join(least, "root").select("fp", "root", "component_id", "n"), "labels")
    rows = labels.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(labels.where(F.col("n") * HOT_SHARE >= rows).select("fp", F.struct("root", "component_id").alias("_hot")))
    tagged = prints.join(hot, "fp", "left")
    done = tagged.where("_hot is not null").select(*prints.columns, "_hot.*")
    rest = tagged.where("_hot is null").select(*prints.columns).join(labels.drop("n"), "fp")
    return done.unionByName(rest)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that links reach).

    A null text counts as empty; texts without words have fingerprint zero and link like any other.
    Repeated rows come back repeated; a row without doc_id gets the component of its fingerprint, null if
    no member has one. Columns besides doc_id and text are ignored. An empty table gives an empty one.
    """
    return _labelled(materialize(fingerprints(docs), "fingerprints")).select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate group: one whose doc_id is the component's id.

    Rows without doc_id can't be told apart and stay, whatever their texts. A row goes by its own text: of rows with
    one doc_id and texts of several groups, each is judged by its group. Where several rows have the keeping
    doc_id, the one with the smallest hash of its text stays, and of rows alike in both the one with the
    smallest hash of all columns, whole.
    """
    keyed, moved = set_aside(docs, ["_id", "_text", "_row"])
    own = F.struct(*[F.col(f"`{c}`") for c in keyed.columns])
    key = keyed.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"), "text")
    prints = key.mapInArrow(_keyed_fingerprints, "doc_id long, _text long, fp long")
    found = _labelled(materialize(prints, "fingerprints")).where("doc_id is not null and component_id is not null")
    rows = found.groupBy(F.col("doc_id").alias("_id"), "_text").agg(F.first("root").alias("root"), F.first("component_id").alias("c"), F.count("*").alias("n"))
    # of the texts with the keeping doc_id of a group one stays
    keeping = rows.where("_id = c")
    chosen = keeping.groupBy("root").agg(F.min("_text").alias("chosen"))
    judged = keeping.join(chosen, "root").select("_id", "_text", "n", (F.col("_text") == F.col("chosen")).alias("stays"))
    judged = judged.union(rows.where("_id != c").select("_id", "_text", "n", F.lit(False)))
    out = materialize(judged.where("not stays or n > 1").select("_id", "_text", "stays"), "judged")
    keyed = keyed.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_text", F.xxhash64("text"))
    kept = keyed.join(out.select("_id", "_text"), ["_id", "_text"], "left_anti").select(*keyed.drop("_id", "_text").columns)
    again = out.where("stays")
    if not again.isEmpty():
        once = keyed.join(again, ["_id", "_text"], "left_semi").groupBy("_id", "_text").agg(F.min_by(own, F.xxhash64(own)).alias("_row"))
        kept = kept.union(once.select("_row.*"))
    return put_back(kept, docs.columns, moved)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
