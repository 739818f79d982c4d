"""Line deduplication: an exact set-similarity join of lines.

A line's tokens are its five-word shingles, A-Z lower-cased, as a set; a line of fewer than WORDS words has one
token, all its words, so that it goes if it repeats. Lines without words stay. A line goes if an earlier line (by
doc_id, then line number) has a Jaccard similarity of 4/5 or more with it, whether or not that line stays itself.

* Tokens are ordered by rarity: a sketch of SKETCH counters, summed over all lines, gives each token a
  frequency (its bucket's), hashes break ties. Any such order is exact; a good one keeps frequent tokens out of prefixes.
  A token is its 64-bit shingle hash with the bucket's bits exchanged for the bucket's place in that order, so none is lost.
* Lines with equal token sets are one class; its first line stands for it, the others go. Sets are equal if two
  hashes of 64 bits agree, which rest on two unrelated hashes of the words: a polynomial of their bytes, and a chain of mixed groups of eight bytes.
  Each part of the input sends a class's first line only, so a line that occurs everywhere is gathered once a part.
* Prefix filter: similar sets share a token among their n - ceil(4n/5) + 1 rarest. Postings of those tokens are dealt
  by token as packed arrays, and posting lists give candidate pairs that pass the length and the positional filter.
  Sets of up to ALONE tokens are similar to equal sets only and post nothing.
* Postings and first lines are dealt to buckets of about BUCKET_BYTES, as many as the input needs.
* A list of up to LIST_CAP classes yields its pairs. A longer one yields its members: they are compared with 8 of
  the list, those still unmatched with the next 64, then 512, and so on to the end of the list, so no pair that
  could remove a line is left out, and a group of n similar lines costs about n comparisons instead of n squared.
  Members are dealt by token, by band of lengths and by SPREAD members of a list, so no task gathers a long list.
* Candidates are verified by the Jaccard similarity of their token sets; the later of a pair goes, by its place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chunks import _M1, _M2, _M3, prefix_sums, shifts_back
from tessera.llm.chunks import mix as _mix
from tessera.llm.common import discard, documents, materialize, put_back, set_aside, text_bytes

WORDS = 5
UP, DOWN = 4, 5  # similarity of UP / DOWN
SKETCH_BITS = 18
SKETCH, SKETCH_PART = 1 << SKETCH_BITS, 1 << 12
FIRST_TYPES, POST_TYPES, GONE_TYPES = ["<u8", "<u8", "<i8", "<i8", "<i4"], ["<u8", "<u8", "<u4", "<u4"], ["<i8", "<i8", "<i4"]
FIRST_BYTES, POST_BYTES = (sum(np.dtype(d).itemsize for d in x) for x in (FIRST_TYPES, POST_TYPES))
ALONE = 3
LIST_CAP, FIRST_WINDOW, WIDEN, SPREAD = 32, 8, 8, 4096
BAND = 1.26  # above DOWN / UP, so similar sets are in the same or in adjacent bands
BUCKETS_PER_PARTITION, BUCKET_BYTES, TASK_BYTES = 2, 1 << 24, 1 << 26
PART_BYTES = 1 << 22
LONG_WORD = 256
PAIRS = 1 << 18  # pairs of short lists tested at once
NOBODY = -(1 << 63)


#: A random value for each byte, A-Z as a-z.
_BYTES = _mix(np.array([c + 33 if 65 <= c <= 90 else c + 1 for c in range(256)], np.uint64) * _M1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of random byte values for each word data[starts[i]:ends[i]]."""
    edges = np.stack([starts, ends], axis=1).reshape(-1)
    sums = prefix_sums(data, _BYTES, edges)
    out = sums[1::2] - sums[::2]
    out *= shifts_back(starts)
    out += (ends - starts).astype(np.uint64)
    return _mix(out)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_checks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A second hash of each word, A-Z lower-cased: groups of eight bytes, mixed one after the other. The groups of words over
    LONG_WORD bytes are mixed with their places instead, all at once."""
    raw = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", raw, 0, (1,))  # the eight bytes from each place on
    n = ends - starts
    out, open_, at = n.astype(np.uint64) * _M3, np.flatnonzero(n <= LONG_WORD), 0
    while len(open_):
        rest = n[open_] - at
        group = eight[starts[open_] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * np.minimum(rest, 8)).astype(np.uint64))
        out[open_] = _mix(out[open_] ^ group) + _M1
        at += 8
        open_ = open_[rest > 8]
    for k in np.flatnonzero(n > LONG_WORD).tolist():
        word = np.zeros(-(-n[k] // 8) * 8, np.uint8)
        word[: n[k]] = raw[starts[k] : ends[k]]
        groups = word.view("<u8")
        out[k] = _mix(out[k] ^ _mix(groups ^ _mix(np.arange(1, len(groups) + 1, dtype=np.uint64) * _M1)).sum(dtype=np.uint64))
    return out


def _shingled(words: np.ndarray, first: np.ndarray, n: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Hashes of the runs of WORDS words, or of the whole of a shorter line, of lines that begin at first and have n words."""
    rolled = np.zeros(len(words), np.uint64)
    if len(words) >= WORDS:
        whole = rolled[: len(words) - WORDS + 1]
        for k in range(WORDS):
            whole *= _M1
            whole += words[k : k + len(whole)]
    for k in range(1, WORDS):
        at = first[n == k]
        rolled[at] = 0
        for j in range(k):
            rolled[at] = rolled[at] * _M1 + words[at + j]
        rolled[at] ^= _mix(np.full(len(at), k, np.uint64))
    return _mix(rolled[inside])


def shingle_lines(data: np.ndarray, offsets: np.ndarray, check: bool = False) -> tuple[np.ndarray, ...]:
    """(text, line number, shingles) of each line with words, and the hashes of all their shingles in turn; with `check`
    their second hashes too.

    Text k is data[offsets[k]:offsets[k + 1]], bytes. A line of fewer than WORDS words is one shingle."""
    space = data - np.uint8(9) < 5
    space |= data == 32
    edge = np.ones(len(data) + 1, bool)
    np.not_equal(space[1:], space[:-1], out=edge[1:-1])
    edge[offsets] = True
    edge = np.flatnonzero(edge)  # of runs of words or of spaces
    is_word = ~space[edge[:-1]] if len(data) else np.zeros(0, bool)
    starts, ends = edge[:-1][is_word], edge[1:][is_word]
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)[: 5 if check else 4])
    breaks = np.flatnonzero(data == 10)
    lines = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    first = np.searchsorted(starts, lines)
    n = np.diff(first, append=len(starts))
    full = np.flatnonzero(n)  # of lines that begin at one place only the last, of the last text there, can have words
    first, n, of = first[full], n[full], np.searchsorted(offsets, lines[full], "right") - 1
    number = full - of - np.searchsorted(breaks, offsets[of])
    inside = np.ones(len(starts), bool)
    for k in range(1, WORDS):
        inside[(first + n)[n > k] - k] = False
    found = (of, number, np.maximum(n - WORDS + 1, 1), _shingled(word_hashes(data, starts, ends), first, n, inside))
    return (*found, _shingled(word_checks(data, starts, ends), first, n, inside)) if check else found


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, offsets, rows, first line numbers) of the texts of a column, PART_BYTES at a time. A longer text
    comes in parts cut after a line's end."""
    wide = pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PART_BYTES, "right")) - 1)
        part, at = data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        if len(part) <= PART_BYTES:
            yield part, at, np.arange(lo, hi), np.zeros(hi - lo, np.int64)
        else:
            breaks = np.flatnonzero(part == 10) + 1
            cuts = np.unique([0, *breaks[np.searchsorted(breaks, np.arange(PART_BYTES, len(part), PART_BYTES), "right") - 1], len(part)]) if len(breaks) else [0, len(part)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield part[a:b], np.array([0, b - a]), np.array([lo]), np.array([np.searchsorted(breaks, a, "right")])
        lo = hi


def _prefix(n: np.ndarray) -> np.ndarray:
    """Of sets of n tokens the number of those that are posted."""
    return np.where(n > ALONE, n - -(-UP * n // DOWN) + 1, 0)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By part of the sketch its counts; in a further part the bytes of first lines and postings, at most."""
    counts, held = np.zeros(SKETCH, np.int64), 0
    for big in batches:
        for data, offsets, _, _ in _parts(big.column("text")):
            _, _, sizes, shingles = shingle_lines(data, offsets)
            counts += np.bincount((shingles & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            held += FIRST_BYTES * len(sizes) + POST_BYTES * int(_prefix(sizes).sum())
    parts = [*counts.reshape(-1, SKETCH_PART), np.array([held] + [0] * (SKETCH_PART - 1))]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([x.astype("<u4" if x.max() < 1 << 32 else "<u8").tobytes() for x in parts], pa.binary())], ["part", "counts"])


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if len(raw) == 4 * SKETCH_PART else "<u8").astype(np.int64)


def _sum_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            totals[part] = totals.get(part, 0) + _unpack(raw)
    if totals:
        yield pa.RecordBatch.from_arrays([pa.array(totals, pa.int32()), pa.array([x.astype("<u8").tobytes() for x in totals.values()], pa.binary())], ["part", "counts"])


def rarity(texts: DataFrame) -> tuple[np.ndarray, int]:
    """By sketch bucket its place in ascending order of frequency, and the bytes to be dealt. The sketch has a fixed size, so
    the driver can hold it."""
    schema = "part int, counts binary"
    parts = texts.mapInArrow(_sketch, schema).repartition("part").mapInArrow(_sum_sketches, schema).collect()
    counts = np.zeros(SKETCH + SKETCH_PART, np.int64)
    for r in parts:
        counts[r.part * SKETCH_PART : (r.part + 1) * SKETCH_PART] += _unpack(bytes(r["counts"]))
    return places_of(counts[:SKETCH]), int(counts[SKETCH])


def places_of(counts: np.ndarray) -> np.ndarray:
    out = np.empty(SKETCH, np.uint32)
    out[np.argsort(counts, kind="stable")] = np.arange(SKETCH, dtype=np.uint32)
    return out


def token_sets(sizes: np.ndarray, shingles: np.ndarray, checks: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places of some lines, their tokens by rarity in rows filled with the largest integer, their numbers of tokens, sums of
    the second hashes of those)."""
    bits = np.uint64(SKETCH_BITS)
    tokens = (rank[(shingles & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << (np.uint64(64) - bits)) | (shingles >> bits)
    starts = np.cumsum(sizes) - sizes
    checks = _mix(checks ^ _M2)
    sums = np.add.reduceat(checks, starts) if len(starts) else checks
    fill = np.uint64(0xFFFFFFFFFFFFFFFF)
    width = np.where(sizes <= 256, -(-sizes // 16) * 16, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    for w in np.unique(width).tolist():
        same = np.flatnonzero(width == w)
        for lo in range(0, len(same), max(1, (1 << 20) // w)):
            at = same[lo : lo + max(1, (1 << 20) // w)]
            rows = np.full((len(at), w), fill)
            there = np.arange(w) < sizes[at, None]
            cells = (starts[at, None] + np.arange(w))[there]
            rows[there] = tokens[cells]
            raw, rows = rows, np.sort(rows, axis=1)
            again = rows[:, 1:] == rows[:, :-1]
            again &= rows[:, 1:] != fill
            sum_ = sums[at]
            if len(double := np.flatnonzero(again.any(axis=1))):  # lines with a shingle twice, which counts once
                theirs = np.zeros(rows.shape, np.uint64)
                theirs[there] = checks[cells]
                theirs = np.take_along_axis(theirs[double], np.argsort(raw[double], axis=1, kind="stable"), axis=1)
                theirs[:, 1:][again[double]] = 0
                sum_[double] = theirs.sum(axis=1, dtype=np.uint64)
                rows[:, 1:][again] = fill
                rows[double] = np.sort(rows[double], axis=1)
            yield at, rows, (rows != fill).sum(axis=1), sum_


def _set_ids(rows: np.ndarray, n: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's token set, one of the tokens and one of their second hashes."""
    there = np.arange(rows.shape[1]) < n[:, None]
    one = np.where(there, _mix(rows), 0).sum(axis=1, dtype=np.uint64)
    return _mix(one + n.astype(np.uint64)), _mix(sums ^ n.astype(np.uint64) * _M3)


GONE = 2  # kinds of what is dealt: first lines, postings and lines that go
POSTED = "kind int, bucket int, blob binary"


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns one after the other, which compresses better than rows."""
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack_columns(blobs: list[bytes], dtypes: list[str]) -> list[np.ndarray]:
    width = sum(np.dtype(d).itemsize for d in dtypes)
    out: list[list[np.ndarray]] = [[] for _ in dtypes]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for k, d in enumerate(dtypes):
            out[k].append(np.frombuffer(blob, d, n, at))
            at += n * np.dtype(d).itemsize
    return [np.concatenate(x) for x in out]


def _dealt(kind: int, by: np.ndarray, columns: list[np.ndarray], buckets: int) -> list[tuple[int, int, bytes]]:
    bucket = (by % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    columns = [c[order] for c in columns]
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(kind, b, _pack([c[edges[b] : edges[b + 1]] for c in columns])) for b in range(buckets) if edges[b] < edges[b + 1]]


def _postings(part: tuple, doc: np.ndarray, row: np.ndarray, rank: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    data, offsets, places, lines = part
    of, number, sizes, shingles, checks = shingle_lines(data, offsets, True)
    if not len(of):
        return []
    number = number + lines[of]
    of = places[of]
    firsts, posts = [], []
    for at, rows, n, sums in token_sets(sizes, shingles, checks, rank):
        cls, check = _set_ids(rows, n, sums)
        firsts.append((cls, check, doc[of[at]], row[of[at]], number[at].astype("<i4")))
        prefix = _prefix(n)
        if prefix.any():
            _, one = np.unique(cls, return_index=True)
            rows, n, cls, prefix = rows[one], n[one], cls[one], prefix[one]
            k, idx = np.nonzero(np.arange(prefix.max()) < prefix[:, None])
            posts.append((rows[k, idx], cls[k], n[k].astype("<u4"), idx.astype("<u4")))
    first, gone = _split_firsts([np.concatenate(c) for c in zip(*firsts)])
    out = _dealt(0, first[0] >> np.uint64(7), first, buckets)
    if len(gone[0]):
        out += _dealt(GONE, _mix(gone[0].view(np.uint64)), gone, buckets)
    if posts:
        post = [np.concatenate(c) for c in zip(*posts)]
        out += _dealt(1, _mix(post[0]), post, buckets)
    return out


def _split_firsts(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Lines (cls, check, doc, row, line): those of them that are the first of their class, and (doc, row, line) of the others."""
    cls, check, doc, row, line = columns
    order = np.lexsort((line, row, doc, check, cls))
    cls, check, doc, row, line = (x[order] for x in (cls, check, doc, row, line))
    new = np.ones(len(cls), bool)
    new[1:] = (cls[1:] != cls[:-1]) | (check[1:] != check[:-1])
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    # repeated rows are the same document: their lines don't repeat each other
    other = (doc != doc[group]) | (row != row[group]) | (line != line[group])
    return [x[new] for x in (cls, check, doc, row, line)], [x[other] for x in (doc, row, line)]


#: kind 0: a (cls, check) = (a, b) begins at document d, row hash e, line n; 1: line n of document d, row hash e, repeats an
#: earlier line; 2: a candidate pair of classes (a, b); 3: class b, with size and place of the token in d, is member n of the
#: long list of token a, which has e members.
FOUND = "kind int, a long, b long, d long, e long, n int"


def _found(kind: int, a, b, d, e, n) -> pa.RecordBatch:  # noqa: ANN001
    size = max(len(x) for x in (a, b, d, e, n) if not isinstance(x, int))
    as_long = lambda x: pa.array(np.full(size, x, np.int64) if isinstance(x, int) else np.ascontiguousarray(x).view(np.int64))
    line = np.full(size, n, np.int32) if isinstance(n, int) else n.astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *map(as_long, (a, b, d, e)), pa.array(line)], ["kind", "a", "b", "d", "e", "n"])


def first_lines(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    (cls, check, doc, row, line), gone = _split_firsts(_unpack_columns(blobs, FIRST_TYPES))
    yield _found(0, cls, check, doc, row, line)
    if len(gone[0]):
        yield _found(1, 0, 0, *gone)


def repeats(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    yield _found(1, 0, 0, *_unpack_columns(blobs, GONE_TYPES))


def _pass_filters(sa: np.ndarray, ia: np.ndarray, sb: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Length and positional filter for sets of sa and sb tokens that share those at ia and ib."""
    need = -(-UP * (sa + sb) // (UP + DOWN))
    return (DOWN * np.minimum(sa, sb) >= UP * np.maximum(sa, sb)) & (1 + np.minimum(sa - ia, sb - ib) - 1 >= need)


def candidates(blobs: list[bytes], list_cap: int = LIST_CAP) -> Iterator[pa.RecordBatch]:
    token, cls, size, idx = _unpack_columns(blobs, POST_TYPES)
    order = np.lexsort((cls, token))
    token, cls, size, idx = token[order], cls[order], size[order].astype(np.int64), idx[order].astype(np.int64)
    own = np.ones(len(token), bool)
    own[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
    token, cls, size, idx = token[own], cls[own], size[own], idx[own]
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    lengths = np.diff(starts, append=len(token))
    pairs = []
    for m in np.unique(lengths[(lengths > 1) & (lengths <= list_cap)]).tolist():
        all_begin = starts[lengths == m]
        i, j = np.triu_indices(m, 1)
        step = max(1, PAIRS // len(i))
        for lo in range(0, len(all_begin), step):
            begin = all_begin[lo : lo + step]
            a, b = (begin[:, None] + i).reshape(-1), (begin[:, None] + j).reshape(-1)
            ok = _pass_filters(size[a], idx[a], size[b], idx[b])
            pairs.append(np.stack([cls[a[ok]], cls[b[ok]]], axis=1))
    if pairs and len(pairs := np.unique(np.concatenate(pairs), axis=0)):
        yield _found(2, pairs[:, 0], pairs[:, 1], 0, 0, 0)
    for k in np.flatnonzero(lengths > list_cap):
        part = slice(starts[k], starts[k] + lengths[k])
        # members by a hash of token and class; each keeps its size and place for the filters
        member = np.argsort(_mix(cls[part] ^ token[starts[k]]), kind="stable")
        yield _found(3, token[part][member], cls[part][member], size[part][member] << 32 | idx[part][member], np.full(lengths[k], lengths[k]), np.arange(lengths[k]))


def _reduced(key: tuple, dealt: pa.Table, list_cap: int) -> pa.Table:
    blobs = dealt.column("blob").to_pylist()
    kind = key[0].as_py()
    parts = list(candidates(blobs, list_cap) if kind == 1 else first_lines(blobs) if kind == 0 else repeats(blobs))
    schema = pa.schema([("kind", pa.int32()), *((x, pa.int64()) for x in "abde"), ("n", pa.int32())])
    return pa.Table.from_batches([p.cast(schema) for p in parts], schema)


def _line_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token sets of the wanted lines of texts, by class and place."""
    for big in batches:
        for lo in range(0, big.num_rows, 256):
            batch, names, found = big.slice(lo, 256), [], []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                lines = text.split(b"\n")
                for w in wanted:
                    names.append((w["a"], w["d"], w["e"], w["n"]))
                    found.append(lines[w["n"]])
            _, _, sizes, shingles = shingle_lines(*_joined(found))
            ends = np.cumsum(sizes).tolist()
            sets = [np.unique(shingles[a:b]).astype("<u8").tobytes() for a, b in zip([0, *ends[:-1]], ends)]
            columns = [pa.array([x[k] for x in names], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary())], ["a", "d", "e", "n", "tokens"])


PLACE = "a long, d long, e long, n int"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows with two lines (x, y) the later's class and place where the lines are similar."""
    kind = pa.struct([("a", pa.int64()), ("d", pa.int64()), ("e", pa.int64()), ("n", pa.int32())])
    for batch in batches:
        gone = []
        kept: tuple = (None, None)
        rows = zip(*(batch.column(c).to_pylist() for c in ("x_tokens", "y_tokens", "x_at", "y_at", "x", "y")))
        for x_tokens, y_tokens, x_at, y_at, x, y in rows:
            if kept[0] is not x_tokens and kept[0] != x_tokens:
                kept = (x_tokens, set(np.frombuffer(x_tokens, "<u8").tolist()))
            other = np.frombuffer(y_tokens, "<u8").tolist()
            shared = sum(map(kept[1].__contains__, other))
            if DOWN * shared >= UP * (len(kept[1]) + len(other) - shared):
                gone.append({"a": y, **y_at} if tuple(x_at.values()) < tuple(y_at.values()) else {"a": x, **x_at})
        yield pa.RecordBatch.from_struct_array(pa.array(gone, kind))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """PLACE of the lines that go because of pairs (x, y)."""
    at = F.struct("d", "e", "n")
    side = lambda s: sets.select(F.col("a").alias(s), F.col("tokens").alias(f"{s}_tokens"), at.alias(f"{s}_at"))
    return pairs.join(side("x"), "x").join(side("y"), "y").mapInArrow(_verify, PLACE).distinct()


def similar_lines(docs: DataFrame, list_cap: int = LIST_CAP) -> DataFrame:
    """(doc_id, row, line): lines that go. row is the hash of the text, which tells rows of one doc_id apart."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), text_bytes().alias("text"))
    rank, held = rarity(rows.select("text"))
    rank, partitions = spark.sparkContext.broadcast(rank), int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(BUCKETS_PER_PARTITION * partitions, -(-held // BUCKET_BYTES))

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            doc = big.column("doc_id").fill_null(NOBODY).to_numpy(zero_copy_only=False)
            row = big.column("row").to_numpy(zero_copy_only=False)
            for part in _parts(big.column("text")):
                out = _postings(part, doc, row, rank.value, buckets)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["kind", "bucket", "blob"])

    def reduced(key: tuple, dealt: pa.Table) -> pa.Table:
        return _reduced(key, dealt, list_cap)

    dealt = rows.mapInArrow(posted, POSTED)
    if held > partitions * TASK_BYTES:
        dealt = dealt.repartition(held // TASK_BYTES, "kind", "bucket")
    found = materialize(dealt.groupBy("kind", "bucket").applyInArrow(reduced, FOUND), "lines")
    firsts, pairs = found.where("kind = 0"), found.where("kind = 2").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()
    long_lists = found.where("kind = 3").select(
        F.col("a").alias("token"), F.col("b").alias("cls"), F.shiftright("d", 32).alias("size"), F.col("d").bitwiseAND(F.lit(0xFFFFFFFF)).alias("idx"), F.col("n").alias("k"), F.ceil(F.col("e") / SPREAD).alias("spread")
    )
    wanted = pairs.select(F.col("x").alias("a")).union(pairs.select("y")).union(long_lists.select("cls")).distinct()
    places = firsts.join(wanted, "a").select("a", "d", "e", "n")
    by_row = places.groupBy("d", "e").agg(F.collect_list(F.struct("a", "d", "e", "n")).alias("wanted"))
    key = F.coalesce("doc_id", F.lit(NOBODY).cast("long"))
    texts = rows.select(key.alias("d"), F.col("row").alias("e"), "text").join(by_row, ["d", "e"]).select("text", "wanted")
    sets = materialize(texts.mapInArrow(_line_sets, "a long, d long, e long, n int, tokens binary").dropDuplicates(["a", "d", "e", "n"]), "sets")

    gone = materialize(_similar(pairs, sets), "similar")  # each round adds the classes it found, and rewrites none
    longest = long_lists.agg(F.max("k")).first()[0] or 0
    lo, width = 0, FIRST_WINDOW
    # members that no comparison has removed yet meet the next window of their lists
    while longest and lo <= longest:
        open_ = long_lists.join(gone.select(F.col("a").alias("cls")), "cls", "left_anti")
        band = F.floor(F.log(F.col("size").cast("double")) / math.log(BAND)).alias("band")
        x = long_lists.where(F.col("k").between(lo, lo + width - 1)).select("token", F.col("cls").alias("x"), F.col("size").alias("x_size"), F.col("idx").alias("x_idx"), F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("salt"), band)
        x = x.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
        y = open_.select("token", F.col("cls").alias("y"), F.col("size").alias("y_size"), F.col("idx").alias("y_idx"), F.pmod(F.xxhash64("cls"), F.col("spread")).alias("salt"), band)
        need = F.ceil(F.lit(UP) * (F.col("x_size") + F.col("y_size")) / F.lit(UP + DOWN))
        fits = (F.lit(DOWN) * F.least("x_size", "y_size") >= F.lit(UP) * F.greatest("x_size", "y_size")) & (
            F.least(F.col("x_size") - F.col("x_idx"), F.col("y_size") - F.col("y_idx")) >= need
        )
        met = x.join(y, ["token", "salt", "band"]).where((F.col("x") != F.col("y")) & fits).select("x", "y").distinct()
        gone = gone.union(materialize(_similar(met, sets), "similar"))
        lo, width = lo + width, width * WIDEN
    discard(sets)

    removed = found.where("kind = 1").select("d", "e", "n").union(gone.select("d", "e", "n"))
    return removed.select(F.when(F.col("d") != F.lit(NOBODY).cast("long"), F.col("d")).alias("doc_id"), F.col("e").alias("row"), F.col("n").alias("line"))


def _with_removed(docs: DataFrame, removed: DataFrame, row: str = "_row") -> DataFrame:
    """docs with the column _gone: the numbers of the lines that go, in order."""
    lists = removed.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("line")).alias("_gone"))
    lists = lists.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_hash"), "_gone")
    return docs.join(lists, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.col(row) == F.col("_hash")), "left").drop("_doc", "_hash")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without later similar lines: texts lose those lines, rows and other columns stay.

    Lines of one to four words go if all their words repeat. A null or empty text has no lines to lose. Repeated rows lose the same lines; of rows with one
    doc_id, the one with the smaller hash of its text counts as earlier; rows without doc_id come first.
    """
    removed = similar_lines(docs.select("doc_id", "text"))
    columns = docs.columns
    docs, moved = set_aside(docs, ["_row", "_gone", "_doc", "_hash"])
    rows = _with_removed(docs.withColumn("_row", F.xxhash64("text")), removed)
    lines = F.split("text", "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone"), lambda i: F.element_at(lines, i + 1))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return put_back(rows.withColumn("text", text), columns, moved)


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that repeat an earlier line, exactly or nearly."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    removed = similar_lines(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_row"), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    found = _with_removed(rows, removed)
    return found.select("doc_id", "n_lines", F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("_gone", F.array().cast("array<int>")).alias("removed_lines"))
