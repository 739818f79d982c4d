"""Hard-negative mining: scores of all rows to the anchors by block matrix multiplication, top lists by windows.

Anchors and rows are dealt to blocks by a hash of the whole row, and their components to chunks of dimensions. A task
multiplies an anchor tile (block i, chunk k) by a row tile (block j, chunk k); each tile is sent to the tasks that need
it, as in SUMMA. The partial tiles, 64-bit integers, are shuffled by (i, j) and added, and each finished tile is reduced
before anything leaves its task:

* to the first POSITIVES rows of each anchor's label, of which the first over all tiles are its positives;
* to its rows of other labels that can lie in a window at all: an anchor's last positive scores no less than the
  last of a tile, so what is below that one's window is below all.

The positives are then sent back to the tiles, each of which yields the first NEGATIVES rows of each window, and the
first of those over all tiles are the result. Memory is bounded by the sizes of blocks: labels, of which one may hold
any share of the rows, decide nothing about where a row goes.

Scores are exact: chunks are multiplied as doubles where no sum can reach 2^53, else as 64-bit integers; vectors whose
scores could pass 2^63 are refused. Partial tiles are written in the narrowest integers that hold them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.chunks import _M1, _M2, mix
from tessera.llm.common import materialize, table

SCALE = 256
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
ANCHOR_BLOCK, ROW_BLOCK = 256, 4096
LEAST_CHUNK, MOST_CHUNKS = 32, 8  # dimensions a chunk at least, chunks at most


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, components) of the rows of a batch (id, label, vector) that take part; shorter vectors end with zeros."""
    vectors = batch.column("vector")
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (bad[ends] == bad[ends - lengths]) & vectors.is_valid().to_numpy(zero_copy_only=False)
    good &= batch.column("label").is_valid().to_numpy(zero_copy_only=False) & batch.column("id").is_valid().to_numpy(zero_copy_only=False)
    ids = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False)[good]
    labels = batch.column("label").fill_null(0).to_numpy(zero_copy_only=False)[good]
    lengths, starts = lengths[good], (ends - lengths)[good]
    out = np.zeros((len(ids), int(lengths.max(initial=0))))
    there = np.arange(out.shape[1]) < lengths[:, None]
    out[there] = values[(starts[:, None] + np.arange(out.shape[1]))[there]]
    return ids, labels, np.floor(SCALE * out)


def _shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, anchors, dims, most = 0, 0, 0, 0.0
    for batch in batches:
        ids, _, x = _rows(batch)
        n, anchors, dims = n + len(ids), anchors + int((ids % ANCHOR_EVERY == 0).sum()), max(dims, x.shape[1])
        most = max(most, float(np.abs(x).max(initial=0)))
    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (n, anchors, dims, most)], ["n", "anchors", "dims", "most"])


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    """(bytes a number, little-endian integers), as few bytes as hold them all."""
    top = max(int(x.max(initial=0)), -1 - int(x.min(initial=0)))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - 1))
    return width, np.ascontiguousarray(x, f"<i{width}").tobytes()


def _wide(width: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{width}").astype(np.int64)


def _row_keys(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row, id, label and vector; trailing zeros count for nothing."""
    raw = x.astype(np.int64).view(np.uint64)
    out = []
    for seed in (_M1, _M2):
        h = mix(ids.view(np.uint64) ^ seed) + mix(labels.astype(np.int64).view(np.uint64) + seed)
        with np.errstate(over="ignore"):
            for d in range(raw.shape[1]):
                h += mix(raw[:, d] + np.uint64((d + 1) * int(seed) % (1 << 64))) * (raw[:, d] != 0)
        out.append(mix(h))
    return out[0], out[1]


PIECES = "side int, block long, chunk int, meta binary, width int, x binary"
META = np.dtype([("id", "<i8"), ("label", "<i8"), ("one", "<u8"), ("two", "<u8")])


def _deal(batches: Iterator[pa.RecordBatch], blocks: tuple[int, int], dims: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows (side 1) and anchors (side 0) of each batch by block and chunk of dimensions."""
    for batch in batches:
        ids, labels, x = _rows(batch)
        if not len(ids):
            continue
        full = np.zeros((len(ids), dims))
        full[:, : x.shape[1]] = x
        meta = np.zeros(len(ids), META)
        meta["id"], meta["label"] = ids, labels
        meta["one"], meta["two"] = _row_keys(ids, labels, full)
        out = []
        for side in (0, 1):
            own = np.flatnonzero(ids % ANCHOR_EVERY == 0) if side == 0 else np.arange(len(ids))
            block = (meta["two"][own] % np.uint64(blocks[side])).astype(np.int64)
            order = np.argsort(block, kind="stable")
            own, block = own[order], block[order]
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(own) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                for k in range(-(-dims // chunk) or 1):
                    out.append((side, int(block[a]), k, meta[own[a:b]].tobytes(), *_narrow(full[own[a:b], k * chunk : (k + 1) * chunk].astype(np.int64))))
        types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [f.split()[0] for f in PIECES.split(", ")])


def _assemble(key: tuple, pieces: pa.Table) -> pa.Table:
    """One tile of all its pieces: rows in one order, whatever the chunk, equal rows once."""
    meta = np.frombuffer(b"".join(pieces["meta"].to_pylist()), META)
    parts = [_wide(w, raw).reshape(len(m) // META.itemsize, -1) for w, raw, m in zip(pieces["width"].to_pylist(), pieces["x"].to_pylist(), pieces["meta"].to_pylist())]
    order = np.lexsort((meta["two"], meta["one"], meta["label"], meta["id"]))
    sorted_ = meta[order]
    order = order[np.concatenate([[True], sorted_[1:] != sorted_[:-1]])]
    width, raw = _narrow(np.concatenate(parts)[order])
    fields = [*(k.as_py() for k in key), meta[order].tobytes(), width, raw]
    return pa.table([pa.array([v], f.type) for v, f in zip(fields, pieces.schema)], schema=pieces.schema)


PARTIAL = "i long, j long, chunk int, anchors binary, rows binary, width int, x binary"


def _multiply(most: float) -> Callable:
    def multiply(key: tuple, tiles: pa.Table) -> pa.Table:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
        schema = pa.schema([(f.split()[0], t) for f, t in zip(PARTIAL.split(", "), kinds)])
        if len(tiles) < 2:
            return schema.empty_table()
        a, b = sorted(tiles.to_pylist(), key=lambda t: t["side"])
        x, y = (_wide(t["width"], t["x"]).reshape(len(t["meta"]) // META.itemsize, -1) for t in (a, b))
        if most * most * max(1, x.shape[1]) < 1 << 53:
            part = (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
        else:
            part = x @ y.T
        first = key[2].as_py() == 0
        return pa.table([pa.array([v], t) for v, t in zip((*(k.as_py() for k in key), a["meta"] if first else b"", b["meta"] if first else b"", *_narrow(part)), kinds)], schema=schema)

    return multiply


#: best: an anchor's first rows of its label; near: by anchor the number of its rows that a window may hold, their places and their scores.
REDUCED = "i long, j long, best array<struct<anchor:int,anchor_id:long,id:long,score:long>>, counts binary, near binary, width int, scores binary, ids binary"


def _first(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n by descending score, then id."""
    if len(scores) > 4 * n:
        cut = np.partition(scores, len(scores) - n)[len(scores) - n]
        among = np.flatnonzero(scores >= cut)
        return among[np.lexsort((ids[among], -scores[among]))[:n]]
    return np.lexsort((ids, -scores))[:n]


def _reducer(positives: int, low: int) -> Callable:
    def reduce_tile(key: tuple, parts: pa.Table) -> pa.Table:
        total, anchors, rows = None, None, None
        for width, raw, a, b in zip(parts["width"], parts["x"], parts["anchors"], parts["rows"]):
            part = _wide(width.as_py(), raw.as_py())
            total = part if total is None else np.add(total, part, out=total)
            if len(b := b.as_py()):
                anchors, rows = np.frombuffer(a.as_py(), META), np.frombuffer(b, META)
        total = total.reshape(len(anchors), len(rows))
        best, counts, near, scores = [], np.zeros(len(anchors), np.int32), [], []
        for k, (anchor, s) in enumerate(zip(anchors, total)):
            same = rows["label"] == anchor["label"]
            own = np.flatnonzero(same & (rows["id"] != anchor["id"]))
            own = own[_first(s[own], rows["id"][own], positives)]
            best += [{"anchor": k, "anchor_id": int(anchor["id"]), "id": int(rows["id"][p]), "score": int(s[p])} for p in own]
            # a positive below zero has no window, and the last one here is no better than the last of all
            least = max(0, int(s[own[-1]])) if len(own) == positives else 0
            fits = np.flatnonzero(~same & (s >= -(-low * least // 100)))
            counts[k] = len(fits)
            near.append(fits)
            scores.append(s[fits])
        width, raw = _narrow(np.concatenate(scores) if scores else np.zeros(0, np.int64))
        near = np.concatenate(near) if near else np.zeros(0, np.int64)
        kind = pa.list_(pa.struct([("anchor", pa.int32()), ("anchor_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]))
        columns = [pa.int64(), pa.int64(), kind, pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        fields = [key[0].as_py(), key[1].as_py(), best, counts.tobytes(), near.astype("<i4").tobytes(), width, raw, rows["id"].astype("<i8").tobytes()]
        names = ["i", "j", "best", "counts", "near", "width", "scores", "ids"]
        return pa.table([pa.array([v], t) for v, t in zip(fields, columns)], schema=pa.schema(zip(names, columns)))

    return reduce_tile


MINED = "i long, anchor int, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _windows(negatives: int, low: int, high: int) -> Callable:
    def windows(key: tuple, tile: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for t in tile.to_pylist():
            ends = np.cumsum(np.frombuffer(t["counts"], np.int32)).tolist()
            near, scores, ids = np.frombuffer(t["near"], "<i4"), _wide(t["width"], t["scores"]), np.frombuffer(t["ids"], "<i8")
            for p in t["positives"]:
                end = ends[p["anchor"]]
                begin = ends[p["anchor"] - 1] if p["anchor"] else 0
                s = scores[begin:end]
                fits = np.flatnonzero((100 * s >= low * p["score"]) & (100 * s <= high * p["score"]))
                own = ids[near[begin:end][fits]]
                out += [(key[0].as_py(), p["anchor"], p["place"], p["anchor_id"], p["id"], p["score"], int(own[f]), int(s[fits[f]])) for f in _first(s[fits], own, negatives)]
        types = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, types)], names=[f.split()[0] for f in MINED.split(", ")])

    return windows


def mine_negatives(
    rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK, least_chunk: int = LEAST_CHUNK
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id, label, vector).

    Anchors are the rows whose id is divisible by ANCHOR_EVERY. Rows with a null id, label, vector or component, or a
    component that isn't finite, take no part; shorter vectors end with zeros. Equal rows count once; other rows of one id
    count each, are anchors each, and neither positives nor other rows to each other. Anchors without positives, or whose windows are
    empty, have no row. Scores beyond 63 bits raise OverflowError.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector")
    shape = rows.mapInArrow(_shape, "n long, anchors long, dims long, most double").agg(F.sum("n"), F.sum("anchors"), F.max("dims"), F.max("most")).first()
    n, n_anchors, dims, most = (x or 0 for x in shape)
    if most * most * max(1, dims) * 100 >= 1 << 63:
        raise OverflowError(f"scores of {dims} components of up to {most:.3g} can pass 63 bits")
    blocks = (max(1, -(-n_anchors // anchor_block)), max(1, -(-n // row_block)))
    chunk = max(least_chunk, -(-dims // MOST_CHUNKS))

    pieces = rows.mapInArrow(lambda batches: _deal(batches, blocks, dims, chunk), PIECES)
    tiles = materialize(pieces.groupBy("side", "block", "chunk").applyInArrow(_assemble, PIECES), "tiles")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    anchors = tiles.where("side = 0").withColumnRenamed("block", "i").withColumn("j", upto(blocks[1]))
    others = tiles.where("side = 1").withColumnRenamed("block", "j").withColumn("i", upto(blocks[0]))
    partial = anchors.unionByName(others).groupBy("i", "j", "chunk").applyInArrow(_multiply(most), PARTIAL)
    reduced = materialize(partial.groupBy("i", "j").applyInArrow(_reducer(positives, low), REDUCED), "scores")

    order = Window.partitionBy("i", "anchor").orderBy(F.desc("score"), "id")
    found = reduced.select("i", F.inline("best")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    lists = found.groupBy("i").agg(F.collect_list(F.struct("anchor", "place", "anchor_id", "id", "score")).alias("positives"))  # of an anchor block
    lists = lists.withColumn("j", upto(blocks[1]))
    mined = reduced.drop("best").join(lists, ["i", "j"]).groupBy("i", "j").applyInArrow(_windows(negatives, low, high), MINED)
    rank = Window.partitionBy("i", "anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = mined.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings, a seventh of them with the next label. Nulls, repeated rows and ties: see mine_negatives().
    Other columns are ignored; an empty table gives no rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.pmod(F.col("vec_id"), F.lit(RELABEL_EVERY)) == 0, F.pmod(F.col("label") + 1, F.lit(LABELS))).otherwise(F.col("label"))
    return mine_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")))


SQL = """
WITH parts AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
    FROM embeddings
    WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
        CAST(coalesce(list_sum([coalesce(z[1] * z[2], 0) FOR z IN list_zip(a.q, b.q)]), 0) AS BIGINT) AS score
    FROM parts a, parts b WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same AND id <> anchor_id
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 10
"""
