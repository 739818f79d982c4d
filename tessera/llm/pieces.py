"""SentencePiece encoding and decoding with N-best segmentation.

The pieces of a public model form a lattice over a text: spaces become the piece mark, a mark is put in
front, and an edge spans each piece that occurs. Edges carry the score -log(rank + 1) - log(H), Zipf's law on the
rank that the model gives a piece, which makes it a unigram model over pieces. A character without a piece, and a
character that looks like the piece mark, is spelled in byte pieces, so decoding gives the text back exactly.

Forward Viterbi scores of all nodes are exact heuristics for A-star from the end to the start: hypotheses
leave the queue by score and the first N that arrive are the N best. The best path itself is that of the forward
pass, so A-star runs only on chunks that an alternative can come from. No piece of the model has the mark after
another character (checked at loading), so the lattice of a text is cut where a mark follows one.
Each chunk is searched on its own and kept by worker; the N best of a text use only its N - 1 chunks
with the smallest loss to their second-best segmentation, and a queue over these combines their lists.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chunks import IdTable
from tessera.llm.common import documents, groups

MARK, HIDDEN_MARK, UNMARKED = "▁", "\0", float("-inf")
N_BEST = 4
TABLE_BITS = 20
LISTS, LISTED_CHARS, LONG = 20_000, 32, 1 << 16


def _load(path: str) -> tuple[list[bytes], dict[str, tuple[bytes, float] | None], list[bytes], float]:
    """(what each id decodes to, pieces with their ids as they are stored and scores, ids of byte pieces, their score)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    norm = math.log(sum(1 / (r + 1) for r in range(size)))
    spelled, edge, byte_id = [b""] * size, {}, [b""] * 256
    for i in range(size):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            byte_id[int(name[3:5], 16)] = i.to_bytes(4, "little")
            spelled[i] = bytes([int(name[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            if MARK in name.lstrip(MARK):
                raise ValueError("a piece has the mark after another character")
            edge[name] = (i.to_bytes(4, "little"), -math.log(1 - model.get_score(i)) - norm)
            spelled[i] = name.replace(MARK, " ").encode()
    return spelled, edge, byte_id, -math.log(size + 1) - norm


class Pieces:
    def __init__(self, path: str) -> None:
        self.spelled, edge, self.byte_id, self.byte_score = _load(path)
        self.ending = dict(edge)  # None: ends a piece, but is none
        for name in list(edge):
            for k in range(1, len(name)):
                self.ending.setdefault(name[k:], None)
        self.table = IdTable(self.found, 2, TABLE_BITS)
        self.lists: dict[tuple[str, int], list] = {}
        self.last: tuple[str | None, Sequence[float], Sequence[int]] = (None, [], [])

    def found(self, chunks: list[str]) -> list[tuple[bytes, float, float]]:
        """(ids, score, loss of the second-best) of chunks that begin with a space."""
        known = {key: rest for key, *rest in self.first_two([c[1:] for c in chunks])}
        return [tuple(known[c[1:]]) for c in chunks]

    # lattice of one chunk

    def spaced(self, key: str) -> tuple[str, str]:
        """The chunk " " + key, and the same with marks."""
        body = key.lstrip(" ")
        raw = " " * (1 + len(key) - len(body)) + body
        return raw, MARK * (len(raw) - len(body)) + body.replace(MARK, HIDDEN_MARK)

    def in_bytes(self, c: str) -> bytes:
        return b"".join(self.byte_id[b] for b in c.encode())

    def edges(self, raw: str, s: str, j: int) -> Iterator[tuple[int, float, bytes]]:
        """(start, score, ids) of the edges that end at node j of a chunk."""
        get, i = self.ending.get, j
        while i:
            i -= 1
            found = get(s[i:j], 0)
            if found:
                yield i, found[1], found[0]
            elif found == 0:
                break
        if not get(s[j - 1]):
            yield j - 1, len(raw[j - 1].encode()) * self.byte_score, self.in_bytes(raw[j - 1])

    def forward(self, key: str) -> tuple[Sequence[float], Sequence[int]]:
        """Forward Viterbi scores of all nodes, and where their best edges start."""
        if self.last[0] == key:  # of a long chunk, which first_two() has just seen
            return self.last[1:]
        raw, s = self.spaced(key)
        best, came = [0.0], [0]
        for j in range(1, len(s) + 1):
            score, i = max((best[i] + score, i) for i, score, _ in self.edges(raw, s, j))
            best.append(score)
            came.append(i)
        return best, came

    def n_best(self, key: str, n_best: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n_best segmentations of a chunk, kept for frequent ones."""
        found = self.lists.get((key, n_best))
        if found is None:
            if len(self.lists) > LISTS:
                self.lists.clear()
            found = self.search(key, n_best)
            if len(key) < LISTED_CHARS:
                self.lists[key, n_best] = found
        return found

    def search(self, key: str, n_best: int) -> list[tuple[float, Sequence[int]]]:
        """A-star from the end of a chunk; among ties the later hypothesis goes first.

        Heuristics are exact, so each hypothesis leads to a path with its score, and no path belongs to two: a queue
        of as many hypotheses as paths are still wanted loses none of the best."""
        raw, s = self.spaced(key)
        best, came = self.forward(key)
        # a path is known by its edges that aren't the best ones of their nodes: (node, start, path before)
        queue: list = [(-best[len(s)], 0, len(s), 0.0, None)]
        made, out = 0, []
        while queue:
            _, _, node, done, path = queue.pop(0)
            if node == 0:
                out.append((done, self.spelled_out(raw, s, came, path)))
                continue
            for start, score, _ in self.edges(raw, s, node):
                made -= 1
                insort(queue, (-(best[start] + done + score), made, start, done + score, path if start == came[node] else (node, start, path)))
            del queue[n_best - len(out) :]
        return out

    def spelled_out(self, raw: str, s: str, came: Sequence[int], path: tuple | None) -> Sequence[int]:
        """The ids of the path that takes the best edges but for those of path."""
        other, ids, node = {}, [], len(s)
        while path:
            other[path[0]] = path[1]
            path = path[2]
        while node:
            start = other.get(node, came[node])
            found = self.ending.get(s[start:node])
            ids.append(found[0] if found else self.in_bytes(raw[start]))
            node = start
        ids.reverse()
        found = np.frombuffer(b"".join(ids), "<u4")
        return found if len(found) > LONG else tuple(found.tolist())

    def first_two(self, keys: list[str]) -> Iterator[tuple[str, bytes, float, float]]:
        """(chunk, its ids, score, loss of the second-best): forward Viterbi with the two best scores of each node.

        Chunks are taken in order, so that each begins with the nodes that it shares with the one before. Scores and
        back-pointers of long chunks are packed."""
        packed = any(len(k) > LONG for k in keys)
        best, second, came = (array("d", [0.0]), array("d", [UNMARKED]), array("i", [0])) if packed else ([0.0], [UNMARKED], [0])
        get, before = self.ending.get, ""
        for key in sorted(keys):
            raw, s = self.spaced(key)
            n, same = len(s), 0
            for x, y in zip(raw, before):
                if x != y:
                    break
                same += 1
            before = raw
            del best[same + 1 :], second[same + 1 :], came[same + 1 :]
            for j in range(same + 1, n + 1):
                top, next_, start, i = UNMARKED, UNMARKED, j, j
                while i:
                    i -= 1
                    found = get(s[i:j], 0)
                    if found:
                        score = found[1]
                        value = best[i] + score
                        if value > top:
                            other = second[i] + score
                            next_ = top if top > other else other
                            top, start = value, i
                        elif value > next_:
                            next_ = value
                    elif found == 0:
                        break
                if not get(s[j - 1]):
                    score = len(raw[j - 1].encode()) * self.byte_score
                    value = best[j - 1] + score
                    if value > top:
                        next_ = max(top, second[j - 1] + score)
                        top, start = value, j - 1
                    else:
                        next_ = max(next_, value)
                best.append(top)
                second.append(next_)
                came.append(start)
            path, node = [], n
            while node:
                start = came[node]
                found = get(s[start:node])
                path.append(found[0] if found else self.in_bytes(raw[start]))
                node = start
            path.reverse()
            if n > LONG:
                self.last = (key, best[:], came[:])
            yield key, b"".join(path), best[n], best[n] - second[n]

    # whole texts

    def encode(self, texts: list[bytes], n_best: int = N_BEST) -> list[tuple[np.ndarray, list[tuple[float, list[tuple[int, tuple[int, ...]]]]]]]:
        """By text: ids of the best segmentation, and the N best as (score, [(chunk, its ids), ...] where they differ from the best).

        A chunk is a run of spaces with what follows it up to the next; a text that isn't empty gets a space in front."""
        marked = [b" " + t if t else t for t in texts]
        data, offsets = np.frombuffer(b"".join(marked), np.uint8), np.cumsum([0, *map(len, marked)])
        begins = np.append((data == 32) & (np.concatenate([[0], data[:-1]]) != 32), False)
        begins[offsets] = True
        starts = np.flatnonzero(begins[:-1])
        at = self.table.places(data, starts)
        ids, ends = self.table.gather(at), np.concatenate([[0], np.cumsum(self.table.size[at])])
        score, loss = self.table.numbers[at].T
        bounds, stops = np.searchsorted(starts, offsets).tolist(), np.append(starts[1:], len(data))
        out = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            key = lambda k, lo=lo: data[starts[lo + k] + 1 : stops[lo + k]].tobytes().decode()
            out.append((ids[ends[lo] : ends[hi]], self.combined(key, float(score[lo:hi].sum()), loss[lo:hi], n_best)))
        return out

    def combined(self, key, best: float, loss: np.ndarray, n_best: int) -> list[tuple[float, list]]:  # noqa: ANN001
        """The N best of a text from its chunks key(0), key(1), ..., their losses, and the score of the best."""
        if n_best <= 1 or not len(loss):
            return [(best, [])]
        few = min(n_best - 1, len(loss))
        near = np.sort(np.argpartition(loss, few - 1)[:few])
        lists = [self.n_best(key(k), n_best) for k in near.tolist()]
        first = (0,) * few
        queue, seen, out = [(0.0, first)], {first}, []
        while queue and len(out) < n_best:
            lost, pick = heapq.heappop(queue)
            out.append((best - lost, [(int(near[j]), lists[j][p][1]) for j, p in enumerate(pick) if p]))
            for j in range(few):
                more = pick[:j] + (pick[j] + 1,) + pick[j + 1 :]
                if more[j] < len(lists[j]) and more not in seen:
                    seen.add(more)
                    heapq.heappush(queue, (sum(lists[i][0][0] - lists[i][p][0] for i, p in enumerate(more)), more))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return decoded_text(self.spelled, ids)


def decoded_text(spelled: list[bytes], ids: np.ndarray) -> str:
    return b"".join(map(spelled.__getitem__, ids.tolist())).decode()[1:]


_models: dict[str, Pieces] = {}
_spellings: dict[str, list[bytes]] = {}


def spellings(path: str) -> list[bytes]:
    """What each id decodes to; a worker that only decodes keeps no lattice."""
    if path not in _spellings:
        _spellings[path] = _load(path)[0]
    return _spellings[path]


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


CHANGE = "array<struct<score:double,changes:array<struct<chunk:int,ids:array<int>>>>>"


def encode_pieces(docs: DataFrame, path: str, n_best: int = N_BEST, decode: bool = False) -> DataFrame:
    """docs with columns ids (binary, little-endian unsigned 32-bit), n_tokens and nbest in place of any columns of these names.

    nbest holds the scores of the N best segmentations and the chunks where each differs from the best.
    A null or empty text has no tokens and the score 0. Ties go to the segmentation found first. With decode, decoded has
    what decode_pieces() makes of the ids, in the same pass over the texts.
    """
    added = {"ids": "binary", "n_tokens": "long", "nbest": CHANGE} | ({"decoded": "string"} if decode else {})
    kept = docs.drop(*added)
    change = pa.list_(pa.struct([("chunk", pa.int32()), ("ids", pa.list_(pa.int32()))]))
    kind = pa.list_(pa.struct([("score", pa.float64()), ("changes", change)]))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for big in batches:
            lo = 0
            for own, texts in groups(list(range(big.num_rows)), big.column("text").cast(pa.binary()).fill_null(b"")):
                batch = big.slice(lo, len(own))
                lo += len(own)
                found = model.encode(texts, n_best)
                ids = [x.astype("<u4").tobytes() for x, _ in found]
                best = [[{"score": s, "changes": [{"chunk": c, "ids": list(i)} for c, i in changes]} for s, changes in x] for _, x in found]
                columns = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(best, kind)]
                if decode:
                    columns.append(pa.array([model.decode(np.frombuffer(x, "<u4")) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *added])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return kept.mapInArrow(encoded, ", ".join([*fields, *[f"{k} {v}" for k, v in added.items()]]))


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with the column decoded, from ids alone."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = spellings(path)
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                batch = big.slice(lo, 512)
                texts = [None if x is None else decoded_text(spelled, np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "decoded"]
    return encoded.drop("decoded").mapInArrow(decoded, ", ".join([*fields, "decoded string"]))


def op6_pieces(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Encodes all documents, decodes what came out, and compares it with the text."""
    path = path or default_path()
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = encode_pieces(docs, path, decode=True)
    return found.select(
        "doc_id",
        "n_tokens",
        F.crc32("ids").alias("ids_crc32"),
        F.transform("nbest", lambda x: x.score).alias("nbest_scores"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
