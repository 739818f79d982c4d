"""Token ids in files of patched frame-of-reference blocks.

A segment (one file image) holds whole documents:

    magic "PFR1", documents u4, ids u8, blocks u4
    by document: doc_id i8, 1 if there is one u1, end u8 (ids up to and with this document)
    block index: blocks + 1 offsets u8 into the block area
    blocks of 128 ids: minimum u4, width u1, exceptions u1, the low width bits of the 128 differences
    to the minimum, then the exceptions' places u1 each and their differences u4 each

The width of a block is that of the percentile of its differences (PERCENTILES) for which block and
exceptions are smallest. Everything is little-endian; the last block is filled with its last id.

Segments are rows of a Parquet table, so that any store that Spark writes to holds them, commits are atomic and a
lost task is written again. `part` and `seq` order them; `start` counts the ids before a segment in its part.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.chunks import IdTable
from tessera.llm.common import documents, groups, materialize, text_bytes

MAGIC, BLOCK, HEADER = b"PFR1", 128, struct.Struct("<4sIQI")
PERCENTILES = (50, 75, 90, 97, 100)
SEGMENT_IDS = 1 << 20
END_ID = 2
JOINED = 2000


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)  # exact below 2**53


def _packed(values: np.ndarray, w: int) -> np.ndarray:
    """The low w bits of values (BLOCK, k), block by block as rows of bytes."""
    values = values.astype(np.uint64) & np.uint64((1 << w) - 1)
    out = np.zeros((2 * w, values.shape[1]), np.uint64)
    for j in range(BLOCK):
        word, shift = divmod(j * w, 64)
        out[word] |= values[j] << np.uint64(shift)
        if shift + w > 64:
            out[word + 1] |= values[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").view(np.uint8)


def _unpacked(rows: np.ndarray, w: int) -> np.ndarray:
    """Undoes _packed()."""
    words = np.ascontiguousarray(np.ascontiguousarray(rows).view("<u8").T)
    out = np.empty((BLOCK, len(rows)), np.uint32)
    mask = np.uint64((1 << w) - 1)
    for j in range(BLOCK):
        word, shift = divmod(j * w, 64)
        value = words[word] >> np.uint64(shift)
        if shift + w > 64:
            value |= words[word + 1] << np.uint64(64 - shift)
        out[j] = value & mask
    return out


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the blocks and their end, bytes) for ids (uint32)."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    rows = np.full(n * BLOCK, ids[-1], np.uint32)
    rows[: len(ids)] = ids
    rows = rows.reshape(n, BLOCK)
    low = rows.min(axis=1)
    diff = rows - low[:, None]
    places = [-(-p * BLOCK // 100) - 1 for p in PERCENTILES]
    candidates = _bit_length(np.sort(diff, axis=1)[:, places])  # n x percentiles
    most = ((np.uint64(1) << candidates.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    over = np.stack([np.count_nonzero(diff > most[:, k, None], axis=1) for k in range(len(places))], axis=1)
    best = np.argmin(candidates * (BLOCK // 8) + 5 * over, axis=1)
    width, exceptions, most = (x[np.arange(n), best] for x in (candidates, over, most))
    body = width * (BLOCK // 8)
    offsets = np.concatenate([[0], np.cumsum(6 + body + 5 * exceptions)])
    out = np.zeros(offsets[-1], np.uint8)
    head = np.concatenate([low.astype("<u4").view(np.uint8).reshape(n, 4), width[:, None].astype(np.uint8), exceptions[:, None].astype(np.uint8)], axis=1)
    out[offsets[:-1, None] + np.arange(6)] = head
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        packed = _packed(np.ascontiguousarray(diff[at].T), w)
        out[offsets[at, None] + 6 + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(diff > most[:, None])
    nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    begin = offsets[block] + 6 + body[block]
    out[begin + nth] = place
    values = diff[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(begin + exceptions[block] + 4 * nth)[:, None] + np.arange(4)] = values
    return offsets, out


def decode_blocks(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks, filling included."""
    n = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint32)
    head = data[offsets[:-1, None] + np.arange(6)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width, exceptions = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    diff = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        diff[at] = _unpacked(data[offsets[at, None] + 6 + np.arange(w * BLOCK // 8)], w).T
    block = np.repeat(np.arange(n), exceptions)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    begin = offsets[block] + 6 + width[block] * (BLOCK // 8)
    values = np.ascontiguousarray(data[(begin + exceptions[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4")[:, 0] if len(block) else np.zeros(0, np.uint32)
    diff[block, data[begin + nth]] = values
    return (diff + low[:, None]).reshape(-1)


def write_segment(doc_ids: list[int | None], ids: list[np.ndarray], sizes: list[int] | None = None) -> bytes:
    """ids: of the documents in turn; sizes: how many each document has, by default those of one array each."""
    sizes = [len(x) for x in ids] if sizes is None else sizes
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    offsets, data = encode_blocks(flat)
    ends = np.cumsum(sizes)
    docs = np.array([(x or 0, x is not None, e) for x, e in zip(doc_ids, ends)], np.dtype([("id", "<i8"), ("there", "u1"), ("end", "<u8")]))
    return b"".join([HEADER.pack(MAGIC, len(docs), len(flat), len(offsets) - 1), docs.tobytes(), offsets.astype("<u8").tobytes(), data.tobytes()])


class Segment:
    """Reads a segment; ids(lo, hi) decodes only the blocks that hold them."""

    def __init__(self, data: bytes) -> None:
        magic, docs, self.n_ids, blocks = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment")
        at = HEADER.size
        self.docs = np.frombuffer(data, np.dtype([("id", "<i8"), ("there", "u1"), ("end", "<u8")]), docs, at)
        at += self.docs.nbytes
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.data = np.frombuffer(data, np.uint8, offset=at + 8 * (blocks + 1))

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        hi = self.n_ids if hi is None else hi
        first, last = lo // BLOCK, -(-hi // BLOCK)
        return decode_blocks(self.offsets[first : last + 1], self.data)[lo - first * BLOCK : hi - first * BLOCK]


LONG = 1 << 16
_joint = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_letters = re.compile(r"( ?[^\W\d_]+)([!-/:-@\[-`{-~](?:.|\n)*)")


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: at texts and at spaces that follow a character other than white space.

    The pre-tokenizer always begins a new piece at such a space, and merges never cross pieces, so chunks can be
    encoded one by one. Whatever might be white space beyond ASCII counts as such."""
    before = np.concatenate([np.zeros(3, np.uint8), data])  # data[i - 1] is before[i + 2]
    last, second, third = before[2:-1], before[1:-2], before[:-3]
    doubtful = (second == 0xC2) & ((last == 0x85) | (last == 0xA0)) | (third == 0xE2) & ((second == 0x80) | (second == 0x81)) | (third == 0xE1) & (second == 0x9A) | (third == 0xE3) & (second == 0x80)
    begins = (data == 32) & (last > 32) & ~((last >= 0x80) & doubtful)
    begins = np.append(begins, False)
    begins[offsets] = True
    return np.flatnonzero(begins[:-1])


class Encoder:
    """Ids of texts by the tokenizers library; those of frequent chunks are kept.

    Chunks and the cuts within them rest on the byte-level pre-tokenizer; with any other, texts are encoded whole. A
    run of letters alone, or of digits, is one piece to the library, which then holds some 200 bytes a character of it."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        before = kind["pre_tokenizer"] or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and kind["normalizer"] is None
        # a byte-level vocabulary writes each byte as one character
        self.id_bytes = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
        for piece, i in self.tokenizer.get_vocab().items():
            self.id_bytes[i] = len(piece)
        self.table = IdTable(self.search)

    def search(self, chunks: list[str]) -> list[tuple[bytes]]:
        long = {c: self.in_parts(c) for c in set(chunks) if len(c) > LONG}
        if long:
            rest = [c for c in chunks if c not in long]
            found = long | dict(zip(rest, self.search(rest)))
            return [found[c] for c in chunks]
        # letters and what follows them, from an ASCII character on, are always pieces of their own
        split = [m.groups() if (m := _letters.fullmatch(c)) else (c, "") for c in chunks]
        heads, tails = list({a for a, _ in split}), list({b for _, b in split})
        known = self.encode_each([h for h in heads if h[0] == " " and not h[-1].isspace() and "<|" not in h])
        rest = [h for h in heads if h not in known] + tails
        known.update(zip(rest, self.plainly(rest)))
        return [(known[a] + known[b],) if b else (known[a],) for a, b in split]

    def in_parts(self, chunk: str) -> tuple[bytes]:
        """A long chunk, cut between letters and digits, which are always pieces of their own; one part of about LONG at a time."""
        out, lo = [], 0
        while lo < len(chunk):
            cut = _joint.search(chunk, lo + LONG)
            hi = cut.start() if cut else len(chunk)
            out += self.plainly([chunk[lo:hi]])
            lo = hi
        return (b"".join(out),)

    def plainly(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_each(self, chunks: list[str]) -> dict[str, bytes]:
        """Encodes chunks JOINED at a time as one text, which is faster, and cuts its ids where chunks end in bytes."""
        out: dict[str, bytes] = {}
        for lo in range(0, len(chunks), JOINED):
            part = chunks[lo : lo + JOINED]
            (found,) = self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = np.cumsum([len(c.encode()) for c in part])
            covered = np.cumsum(self.id_bytes[ids])
            at = np.searchsorted(covered, ends)
            if covered[-1] == ends[-1] and (covered[at] == ends).all():
                raw, cut = ids.tobytes(), (4 * (at + 1)).tolist()
                out.update(zip(part, (raw[a:b] for a, b in zip([0, *cut[:-1]], cut))))
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """By text its ids."""
        if not self.cuts:
            return [np.frombuffer(x, "<u4") for x in self.plainly([t.decode() for t in texts])]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        starts = chunk_starts(data, offsets)
        at = self.table.places(data, starts)
        ids, ends = self.table.gather(at), np.concatenate([[0], np.cumsum(self.table.size[at])])
        cut = ends[np.searchsorted(starts, offsets)].tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each tokenizer file and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


FILES = "part int, seq int, start long, n_ids long, payload binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of docs (doc_id, text), in ascending order of doc_id, and returns the table of segments.

    Rows without doc_id come first; rows with one doc_id follow the order of their texts. A null text
    counts as empty and has the end id only. Texts of any length are encoded whole. Other columns are ignored, so none can clash; an
    empty table gives an empty one.
    """
    end = np.array([end_id], np.uint32)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, seq, start = encoder(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        names, ids, sizes, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (start, pa.int64()), (held, pa.int64()), (write_segment(names, ids, sizes), pa.binary()))], ["part", "seq", "start", "n_ids", "payload"])

        for batch in batches:
            for some, texts in groups(batch.column("doc_id").to_pylist(), batch.column("text")):
                for doc_id, x in zip(some, tool.encode(texts)):
                    names.append(doc_id)
                    ids += [x, end]
                    sizes.append(len(x) + 1)
                    held += len(x) + 1
                    if held >= SEGMENT_IDS:
                        yield flush()
                        seq, start, names, ids, sizes, held = seq + 1, start + held, [], [], [], 0
        if names:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(encoded, FILES), "tokens")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, data in zip(batch.column("base").to_pylist(), batch.column("payload")):
            segment = Segment(data.as_py())
            raw, ends = segment.ids().astype("<u4").tobytes(), segment.docs["end"].astype(np.int64)
            begins = np.concatenate([[0], ends[:-1]])
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
            names = pa.array(segment.docs["id"].astype(np.int64), mask=segment.docs["there"] == 0)
            yield pa.RecordBatch.from_arrays([names, pa.array(begins + base), pa.array(ends - begins), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) by document. The parts' totals are as many rows as the
    files have parts, which bounds the one broadcast."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    bases = totals.select("part", before.alias("before"))
    placed = files.join(F.broadcast(bases), "part").select((F.col("before") + F.col("start")).alias("base"), "payload")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_ids(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Writes the token ids of all documents and reads the files back."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return read_token_files(write_token_files(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path))
