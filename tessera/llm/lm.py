"""Language-model scores: a gated recurrent network with a class-factored softmax, in numpy.

Words are counted over all training rows. The HEAD most frequent words, ordered by count, fall into
classes of CLASS_WORDS words each; every other word belongs to one of TAIL classes by a hash of its last
letters, so that words never seen have a class too. The model predicts the class from the state of a
gated recurrent unit and, within a head class, the word; within a tail class the word has its
smoothed share of that class's training tokens, (c + 1) / (N_k + V_k + 1), with one share for unseen
words. The probabilities of all words and one unseen word per tail class add up to one.

Weights are learned with truncated backpropagation (windows of WINDOW tokens, the state carried from
window to window). One task begins them, on SAMPLE_DOCS training texts; then every training row is
learned from, in ROUNDS rounds: each row belongs by a hash to one round and to one of as many parts as PART_TOKENS training
tokens ask for, a round's rows of a part are learned from in the order of that hash, those of more than LONG_TOKENS tokens first, all parts from the same weights, and what
they learned is averaged by their tokens, in whole numbers. So weights depend on the rows alone, not on how many tasks or cores
there are. A text of any length goes through its lane window by window. When scoring, the state is carried across windows to
the end of each document. Texts become ids once, in a table that learning and scoring read.

The TOP most frequent words are broadcast (a bound of a few megabytes). Other words of a document are
joined with the counts on the word, so nothing that grows with the corpus reaches one task or the driver.
"""

from __future__ import annotations

import copy
import heapq
import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, key_crc, materialize, text_bytes

END = b"\n"  # can't be a word
HEAD, CLASS_WORDS, TAIL, TOP = 4096, 64, 32, 1 << 18
HEAD_CLASSES = HEAD // CLASS_WORDS
HIDDEN, WINDOW, STREAMS, EPOCHS, RATE = 32, 24, 48, 4, 0.01
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 1 << 16
ROUNDS, ROUND_RATE, STEP_TOKENS, WEIGHT_PARTS, PART_TOKENS, LONG_TOKENS = 4, 0.002, 4096, 64, 1 << 21, 2048
PIECE_BYTES = 1 << 25
LANES, SCORED_WINDOW = 256, 32
OUT_ROWS, STEP_WEIGHTS = 512, 1 << 14  # rows of class logits, and weights of a step, at a time: they stay in a core's cache
FOLDS, HELD_OUT_FOLD = 7, 2
NEVER = np.float32(-1e9)


def tail_class(word: bytes) -> int:
    return zlib.crc32(word.rstrip(b".,;:!?)\"'")[-3:]) % TAIL


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in pieces whose texts hold PIECE_BYTES at most, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE_BYTES, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (binary, no nulls), A-Z lower-cased, and where each text's begin and end among them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)))
    words, bounds = lists.flatten(), lists.offsets.to_numpy()
    full = pc.binary_length(words).to_numpy() > 0  # white space at the ends of a text leaves empty ones
    return words.filter(pa.array(full)), np.append(0, np.cumsum(full))[bounds - bounds[0]]


def _as_binary(words: pa.Array) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(words), words.buffers(), offset=words.offset)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = 0
    for piece in _pieces(batches):
        found = pc.value_counts(_words(piece.column("text"))[0])
        words, n = _as_binary(found.field("values")), found.field("counts").cast(pa.int64())
        yield pa.RecordBatch.from_arrays([words, pa.array(map(tail_class, words.to_pylist()), pa.int32()), n], ["word", "tail", "n"])
        ends += piece.num_rows
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([tail_class(END)], pa.int32()), pa.array([ends], pa.int64())], ["word", "tail", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, tail, c) over texts (text binary), each text with one end."""
    partial = texts.mapInArrow(_count, "word binary, tail int, n long")
    return partial.groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    words: list[bytes]  # the end first, then by falling count
    counts: np.ndarray
    tails: np.ndarray
    tail_tokens: np.ndarray  # by tail class, of the words outside the head
    tail_words: np.ndarray
    tokens: int
    distinct: int

    def __post_init__(self) -> None:
        ids = np.arange(len(self.words))
        self.log_count = np.log10(self.counts + 1.0)
        self.tail_norm = np.log10(self.tail_tokens + self.tail_words + 1.0)
        self.model_id = np.where(ids < HEAD, ids, HEAD + self.tails).astype(np.int32)


class Lookup:
    """Places of words in the vocabulary, -1 for others. Made from pairs of a word and its place, in the order of places from 0."""

    def __init__(self, places: Iterable[tuple[bytes, int]]) -> None:
        words = pa.array([word for word, _ in places], pa.binary())
        self.words = pa.Array.from_buffers(pa.string(), len(words), words.buffers())

    def of(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()


def vocabulary(counts: DataFrame) -> Vocabulary:
    by_tail = {r.tail: (r.n, r.d) for r in counts.where(F.col("word") != F.lit(END)).groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("d")).collect()}
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    top = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(TOP - 1).toArrow()
    words = [END, *top["word"].to_pylist()]
    c = np.concatenate([[ends], top["c"].to_numpy()]).astype(np.int64)
    tails = np.concatenate([[0], top["tail"].to_numpy()]).astype(np.int64)
    tokens = np.array([by_tail.get(k, (0, 0))[0] for k in range(TAIL)], np.int64)
    distinct = np.array([by_tail.get(k, (0, 0))[1] for k in range(TAIL)], np.int64)
    total, types = int(tokens.sum() + ends), int(distinct.sum() + (ends > 0))
    head = slice(1, min(HEAD, len(words)))
    tokens -= np.bincount(tails[head], c[head], TAIL).astype(np.int64)
    distinct -= np.bincount(tails[head], minlength=TAIL)
    return Vocabulary(words, c, tails, tokens, distinct, total, types)


# The network. x: ids of the words before (HEAD + TAIL of them); y: ids to predict.


def new_weights(v: Vocabulary) -> dict[str, np.ndarray]:
    """Small random weights; biases that give each class and word its share of the training tokens."""
    rng = np.random.default_rng(7)
    c = np.zeros(HEAD)
    c[: min(HEAD, len(v.words))] = v.counts[:HEAD]
    with np.errstate(divide="ignore"):
        word_bias = np.maximum(np.log(c), NEVER).reshape(HEAD_CLASSES, CLASS_WORDS)
        classes = np.concatenate([c.reshape(HEAD_CLASSES, CLASS_WORDS).sum(axis=1), v.tail_tokens + v.tail_words + 1.0])
        class_bias = np.maximum(np.log(classes / classes.sum()), NEVER)
    weights = {
        "x": rng.normal(0, 0.1, (HEAD + TAIL, 3 * HIDDEN)),
        "u": rng.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)),
        "class": rng.normal(0, 0.02, (HIDDEN, HEAD_CLASSES + TAIL)),
        "class_bias": class_bias,
        "word": rng.normal(0, 0.02, (HEAD_CLASSES, HIDDEN, CLASS_WORDS)),
        "word_bias": word_bias,
    }
    return {k: np.ascontiguousarray(w, dtype=np.float32) for k, w in weights.items()}


def _softmax(x: np.ndarray, target: np.ndarray, share: float, ones: np.ndarray) -> tuple[np.ndarray, float]:
    """Of logits x (n, classes): x becomes e, such that r[:, None] * e is the gradient of share times the summed loss at target; (r, the loss).

    Rows are summed by a product with ones, which is faster than along short rows, and not divided one by one."""
    rows = np.arange(len(x))
    peak = x.max()
    if peak > 60:  # else no sum overflows
        x -= x.max(axis=1, keepdims=True)
    at = x[rows, target]
    np.exp(x, out=x)
    total = np.maximum(x @ ones, 1e-30)
    x[rows, target] -= total
    return share / total, float((np.log(total) - at).sum())


def _by_gate(u: np.ndarray) -> np.ndarray:
    """(HIDDEN, 3 * HIDDEN) as (3, HIDDEN, HIDDEN), so that what a gate computes lies together."""
    return np.ascontiguousarray(u.reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))


def run_states(w: dict, x: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None, tape: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States after each of x (T, B), from h (B, HIDDEN). keep (T, B): 0 where a text starts anew.

    tape gets the states before, the gates (3, T, B, HIDDEN) and what the states add to the third before its gate."""
    sign = np.array([-1, -1, -2], w["u"].dtype)  # exp(-a) in sigmoids, exp(-2a) in tanh
    u = _by_gate(w["u"]) * sign[:, None, None]
    gates = np.take(w["x"].reshape(-1, HIDDEN), x.astype(np.intp) * 3 + np.arange(3)[:, None, None], axis=0)
    gates *= sign[:, None, None, None]
    out = np.empty((*x.shape, HIDDEN), gates.dtype)
    befores, pulls = (np.empty_like(out) for _ in range(2)) if tape is not None else (None, None)
    pull, part = np.empty((3, len(h), HIDDEN), gates.dtype), np.empty((len(h), HIDDEN), gates.dtype)
    whole = None if keep is None else keep.all(axis=1).tolist()
    for t in range(len(x)):
        if whole is not None and not whole[t]:
            h = h * keep[t][:, None]
        np.matmul(h, u, out=pull)
        zr, n = gates[:2, t], gates[2, t]
        zr += pull[:2]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        n += np.multiply(zr[1], pull[2], out=part)
        np.exp(n, out=n)
        n += 1
        np.divide(2, n, out=n)
        n -= 1
        if tape is not None:
            befores[t], pulls[t] = h, pull[2]
        new = np.subtract(h, n, out=out[t])
        new *= zr[0]
        new += n
        h = new
    if tape is not None:
        pulls *= gates.dtype.type(-0.5)
        tape += [befores, gates, pulls]
    return out, h


def _picked(logits: np.ndarray, target: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log softmax of logits (changed in place) at target, row by row."""
    at = logits[np.arange(len(target)), target]
    peak = logits.max()
    if peak > 60:  # else no sum overflows
        logits -= peak
        at -= peak
    np.exp(logits, out=logits)
    at -= np.log(np.maximum(logits @ ones, 1e-30))
    return at


def _by_class(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes of y, its places by class, where each head class begins among these)."""
    cls = np.where(y < HEAD, y // CLASS_WORDS, y - HEAD + HEAD_CLASSES)
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    return cls, order, np.searchsorted(cls[order], np.arange(HEAD_CLASSES + 1))


def _with_ones(states: np.ndarray) -> np.ndarray:
    out = np.ones((len(states), HIDDEN + 1), states.dtype)
    out[:, :HIDDEN] = states
    return out


def _by_rows(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights with the bias as their last row, for states with a last column of ones."""
    return np.concatenate([weights, bias[..., None, :]], axis=-2)


def log_probs(w: dict, states: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log p of the classes and head words y (n) after states (n, HIDDEN); of tail words the class only."""
    cls, order, starts = _by_class(y)
    states, ones = _with_ones(states), np.ones(HEAD_CLASSES + TAIL, states.dtype)
    out, classes, words = np.empty(len(y), states.dtype), _by_rows(w["class"], w["class_bias"]), _by_rows(w["word"], w["word_bias"])
    logits = np.empty((min(OUT_ROWS, len(y)), HEAD_CLASSES + TAIL), states.dtype)
    for lo in range(0, len(y), OUT_ROWS):
        at = slice(lo, lo + OUT_ROWS)
        s = states[at]
        out[at] = _picked(np.matmul(s, classes, out=logits[: len(s)]), cls[at], ones)
    head = order[: starts[-1]]
    if len(head):
        s, e = np.take(states, head, axis=0), np.empty((len(head), CLASS_WORDS), states.dtype)
        for k in np.flatnonzero(np.diff(starts)).tolist():
            at = slice(starts[k], starts[k + 1])
            np.matmul(s[at], words[k], out=e[at])
        out[head] += _picked(e, y[head] % CLASS_WORDS, ones[:CLASS_WORDS])
    return out


def output_gradients(w: dict, states: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
    """Gradients of the mean loss at y after states, "states" among them, and the loss.

    The states' last column is one, so that biases are rows of the weights."""
    cls, order, starts = _by_class(y)
    loss, share = 0.0, states.dtype.type(1 / max(1, len(y)))
    states, up = _with_ones(states), np.empty_like(states)
    classes, ones = _by_rows(w["class"], w["class_bias"]), np.ones(HEAD_CLASSES + TAIL, states.dtype)
    g_class, g_word = np.zeros_like(classes), np.zeros((HEAD_CLASSES, HIDDEN + 1, CLASS_WORDS), states.dtype)
    logits = np.empty((min(OUT_ROWS, len(y)), HEAD_CLASSES + TAIL), states.dtype)
    for lo in range(0, len(y), OUT_ROWS):
        at = slice(lo, lo + OUT_ROWS)
        s = states[at]
        e = np.matmul(s, classes, out=logits[: len(s)])
        r, lost = _softmax(e, cls[at], share, ones)
        loss += lost
        r = r[:, None]
        g_class += (s * r).T @ e
        np.matmul(e, w["class"].T, out=up[at])
        up[at] *= r
    head = order[: starts[-1]]
    if len(head):
        s, words = np.take(states, head, axis=0), _by_rows(w["word"], w["word_bias"])
        e, back, used = np.empty((len(head), CLASS_WORDS), s.dtype), np.empty((len(head), HIDDEN), s.dtype), np.flatnonzero(np.diff(starts)).tolist()
        spans = [(k, slice(starts[k], starts[k + 1])) for k in used]
        for k, at in spans:
            np.matmul(s[at], words[k], out=e[at])
        r, lost = _softmax(e, y[head] % CLASS_WORDS, share, ones[:CLASS_WORDS])
        loss += lost
        s *= r[:, None]
        for k, at in spans:
            np.matmul(s[at].T, e[at], out=g_word[k])
            np.matmul(e[at], w["word"][k].T, out=back[at])
        back *= r[:, None]
        up[head] += back
    grads = {"class": g_class[:HIDDEN], "class_bias": g_class[HIDDEN], "word": g_word[:, :HIDDEN], "word_bias": g_word[:, HIDDEN], "states": up}
    return grads, loss / max(1, len(y))


RANKS = 16


def _sums_by_id(x: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """rows (3, n, HIDDEN) summed by their ids x, as (size, 3 * HIDDEN): the first RANKS of each id's rows together for all ids, more of them id by id."""
    out = np.zeros((size, 3, HIDDEN), rows.dtype)
    order = np.argsort(x.astype(np.uint16) if size <= 1 << 16 else x, kind="stable")
    x = x[order]
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    n = np.diff(np.append(starts, len(x)))
    most = np.argsort(-n, kind="stable")
    starts, n = starts[most], n[most]
    sums = np.take(rows, order[starts], axis=1)
    for rank in range(1, min(RANKS, int(n[0]))):
        own = starts[: np.searchsorted(-n, -rank)]  # ids with more rows than rank
        sums[:, : len(own)] += np.take(rows, order[own + rank], axis=1)
    for k in range(np.searchsorted(-n, -RANKS)):
        sums[:, k] += np.take(rows, order[starts[k] + RANKS : starts[k] + n[k]], axis=1).sum(axis=1)
    out[x[starts]] = sums.transpose(1, 0, 2)
    return out.reshape(size, 3 * HIDDEN)


def window_gradients(w: dict, x: np.ndarray, y: np.ndarray, h: np.ndarray, keep: np.ndarray, there: np.ndarray | None = None) -> tuple[dict, np.ndarray, float]:
    """Gradients of the mean loss over x, backpropagated to the start of each WINDOW of it; the last state; the loss.

    there (T, B): which places hold a token, all if None."""
    tape: list = []
    states, last = run_states(w, x, h, keep, tape)
    if there is None:
        g, loss = output_gradients(w, states.reshape(-1, HIDDEN), y.reshape(-1))
        up = g.pop("states").reshape(states.shape)
    else:
        g, loss = output_gradients(w, states[there], y[there])
        up = np.zeros_like(states)
        up[there] = g.pop("states")
    befores, gates, pulls = tape
    back = np.ascontiguousarray(_by_gate(w["u"]).transpose(0, 2, 1))
    drive, reset, into = np.empty_like(gates), np.empty_like(states), np.empty((3, *h.shape), states.dtype)
    dh, whole = np.zeros_like(states[0]), keep.all(axis=1).tolist()
    for t in range(len(x) - 1, -1, -1):
        z, r, n = gates[:, t]
        dz, dr, dn = drive[:, t]
        if (t + 1) % WINDOW == 0:
            dh[:] = 0
        dh += up[t]
        np.subtract(1, z, out=dr)
        np.subtract(befores[t], n, out=dz)
        dz *= z
        dz *= dr
        dz *= dh
        np.multiply(n, n, out=dn)
        np.subtract(1, dn, out=dn)
        dn *= dr
        dn *= dh
        dpull = np.multiply(dn, r, out=reset[t])
        np.subtract(1, r, out=dr)
        dr *= pulls[t]
        dr *= dpull
        dh *= z
        np.matmul(drive[:2, t], back[:2], out=into[:2])
        np.matmul(dpull, back[2], out=into[2])
        for part in into:
            dh += part
        if t and not whole[t]:
            dh *= keep[t][:, None]
    before = befores.reshape(-1, HIDDEN).T
    g["u"] = np.concatenate([before @ d.reshape(-1, HIDDEN) for d in (*drive[:2], reset)], axis=1)
    g["x"] = _sums_by_id(x.reshape(-1), drive.reshape(3, -1, HIDDEN), len(w["x"]))
    return g, last, loss


class Adam:
    """Moments of the gradients, and steps along them."""

    def __init__(self, w: dict) -> None:
        self.first = {k: np.zeros_like(a) for k, a in w.items()}
        self.second = {k: np.zeros_like(a) for k, a in w.items()}
        self.steps = 0

    def step(self, w: dict, g: dict, rate: float) -> None:
        norm = math.sqrt(sum(float(np.vdot(a, a)) for a in g.values()))
        self.steps += 1
        rate *= math.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        scale = min(1.0, 1.0 / (norm + 1e-9))
        for k, a in g.items():
            flat = [np.reshape(x, -1) for x in (a, self.first[k], self.second[k], w[k])]
            for lo in range(0, a.size, STEP_WEIGHTS):
                a, first, second, own = (x[lo : lo + STEP_WEIGHTS] for x in flat)
                if scale < 1:
                    a *= a.dtype.type(scale)
                first *= 0.9
                second *= 0.999
                part = 0.1 * a
                first += part
                np.multiply(a, a, out=part)
                part *= 0.001
                second += part
                np.sqrt(second, out=part)
                part += 1e-8
                np.divide(first, part, out=part)
                part *= rate
                own -= part


def train(w: dict, texts: list[np.ndarray], adam: Adam | None = None) -> list[float]:
    """Learns in place from texts, arrays of ids that end with the end's. The mean loss by epoch."""
    if not texts:
        return []
    adam = adam or Adam(w)
    losses = []
    for epoch in range(EPOCHS):
        order = np.random.default_rng(epoch).permutation(len(texts))
        line = np.concatenate([texts[i] for i in order])
        streams = max(1, min(STREAMS, len(line) // WINDOW))
        length = len(line) // streams
        y = line[: streams * length].reshape(streams, length).T
        x = np.concatenate([[0], line[:-1]])[: streams * length].reshape(streams, length).T
        keep = (x != 0).astype(np.float32)
        h, total = np.zeros((streams, HIDDEN), np.float32), []
        windows = range(0, length, WINDOW)
        for lo in windows:
            part = slice(lo, lo + WINDOW)
            g, h, loss = window_gradients(w, x[part], y[part], h, keep[part])
            total.append(loss)
            adam.step(w, g, RATE * (1 - 0.9 * (adam.steps + 1) / (EPOCHS * len(windows) + 1)))
        losses.append(float(np.mean(total)))
    return losses


def train_stream(w: dict, adam: Adam, texts: Iterator[np.ndarray], rate: float) -> int:
    """Learns in place from each token of texts once, LANES texts side by side; the number of tokens.

    A lane takes the next text when its own ends. A step takes as many windows as make STEP_TOKENS tokens or more."""
    rests, last = [np.zeros(0, np.int32)] * LANES, np.zeros(LANES, np.int32)
    h, total = np.zeros((LANES, HIDDEN), np.float32), 0
    while True:
        span = WINDOW * -(-STEP_TOKENS // (WINDOW * max(1, len(rests))))
        lanes, n = np.zeros((len(rests), span), np.int32), np.zeros(len(rests), np.int64)
        for j, rest in enumerate(rests):
            lane, held = lanes[j], 0
            while held < span and (len(rest) or (rest := next(texts, None)) is not None):
                part = rest[: span - held]
                lane[held : held + len(part)] = part
                held += len(part)
                rest = rest[len(part) :]
            n[j], rests[j] = held, np.zeros(0, np.int32) if rest is None else rest
        active = np.flatnonzero(n)
        if not len(active):
            return total
        y, n, last, h, rests = np.ascontiguousarray(lanes[active, : n.max()].T), n[active], last[active], h[active], [rests[j] for j in active]
        x = np.concatenate([last[None], y[:-1]])
        last = y[-1]
        there = np.arange(len(y))[:, None] < n
        g, h, _ = window_gradients(w, x, y, h, (x != 0).astype(np.float32), None if there.all() else there)
        adam.step(w, g, rate)
        total += int(n.sum())


def score_texts(w: dict, texts: list[np.ndarray]) -> np.ndarray:
    """Sum of log p (natural) over each text of ids, the state carried through the whole text.

    Texts are dealt to LANES lanes, the longest first, each to the lane with the fewest tokens so far; a lane's texts follow
    each other, and as each ends with the end's id 0, what comes before a text's first word is 0 too."""
    if not texts:
        return np.zeros(0)
    sizes = np.array([len(t) for t in texts])
    lanes: list[list[int]] = [[] for _ in range(min(LANES, len(texts)))]
    least = [(0, j) for j in range(len(lanes))]
    for k in np.argsort(-sizes, kind="stable").tolist():
        held, j = least[0]
        lanes[j].append(k)
        heapq.heapreplace(least, (held + int(sizes[k]), j))
    held = np.zeros(len(lanes), np.int64)
    for n, j in least:
        held[j] = n
    lane_order = np.argsort(-held, kind="stable")
    order, held = [k for j in lane_order.tolist() for k in lanes[j]], held[lane_order]
    y = np.concatenate([texts[k] for k in order])
    x = np.append(y.dtype.type(0), y[:-1])
    logs, starts, h = np.empty(len(y), np.float32), np.cumsum(held) - held, np.zeros((len(lanes), HIDDEN), np.float32)
    for t in range(0, int(held[0]), SCORED_WINDOW):
        active = int(np.searchsorted(-held, -t, side="left"))
        steps = np.arange(t, min(t + SCORED_WINDOW, int(held[0])))[:, None]
        there = steps < held[:active]
        at = np.where(there, starts[:active] + steps, 0)
        before = x[at]
        states, h = run_states(w, before, h[:active], before != 0)
        if there.all():
            logs[at.reshape(-1)] = log_probs(w, states.reshape(-1, HIDDEN), y[at.reshape(-1)])
        else:
            logs[at[there]] = log_probs(w, states[there], y[at[there]])
    total = np.empty(len(texts))
    sizes = sizes[order]
    total[order] = np.add.reduceat(logs, np.cumsum(sizes) - sizes, dtype=np.float64)
    return total


def encode_batch(lookup: Lookup, v: Vocabulary, texts: pa.Array) -> dict[str, list]:
    """What a batch (texts binary) yields by document before the network: the network's ids, and sums without the counts of words outside the vocabulary."""
    words, bounds = _words(texts)
    starts = bounds[:-1] + np.arange(len(texts))
    found, is_word = lookup.of(words), np.ones(len(words) + len(texts), bool)
    is_word[bounds[1:] + np.arange(len(texts))] = False
    at = np.zeros(len(is_word), np.int32)  # ends have place 0
    at[is_word] = found
    missing = np.flatnonzero(found < 0)
    ids, others = v.model_id[at].astype(np.uint16), pc.dictionary_encode(words.take(pa.array(missing)))
    distinct, codes = _as_binary(others.dictionary), others.indices.to_numpy()
    outside = at < 0
    ids[outside] = np.array([HEAD + tail_class(x) for x in distinct.to_pylist()], np.uint16)[codes]
    log_count, tail = np.where(outside, 0.0, v.log_count[at]), ids >= HEAD
    model = np.where(tail, log_count, 0.0)
    model[tail] -= v.tail_norm[ids[tail] - HEAD]
    doc = np.searchsorted(bounds, missing, side="right") - 1
    pairs, n = np.unique(doc * max(1, len(distinct)) + codes, return_counts=True)
    lists = np.searchsorted(pairs, np.arange(len(texts) + 1) * max(1, len(distinct))).astype(np.int32)
    rare = distinct.take(pa.array(pairs % max(1, len(distinct))))
    sums = (np.add.reduceat(x, starts) if len(texts) else np.zeros(0) for x in ((~outside & (v.counts[at] > 0)).astype(np.int64), log_count, model))
    known, base, model = sums
    return {
        "n_tokens": np.diff(bounds) + 1,
        "known": known,
        "base": base,
        "model": model,
        "rare": pa.ListArray.from_arrays(pa.array(lists), rare),
        "rare_n": pa.ListArray.from_arrays(pa.array(lists), pa.array(n.astype(np.int64))),
        "ids": np.split(ids, starts[1:])[: len(texts)],
    }


def score_batch(lookup: Lookup, v: Vocabulary, w: dict, texts: list[bytes]) -> dict[str, list]:
    """encode_batch() with the network's scores added to "model"."""
    out = encode_batch(lookup, v, pa.array(texts, pa.binary()))
    out["model"] = out["model"] + score_texts(w, out["ids"]) / math.log(10)
    return out


KEPT = "row long, doc_id long, held_out boolean, turn int, h long, bytes long"
ENCODED = f"{KEPT}, n_tokens long, known long, base double, model double, rare array<binary>, rare_n array<long>, ids binary"
SCORED_TOKENS = 1 << 23


def _ids(raw: pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), "<u2")


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    A null text counts as empty (one token, the end); a null doc_id counts as empty text in the fold. Repeated
    rows come back repeated. Without training rows every word is unknown and scores are finite; an empty table gives no rows. Texts of any length
    are learned from and scored whole. Other columns are ignored, so none can clash.
    """
    spark = docs.sparkSession
    fold, turn = key_crc() % FOLDS, F.floor(key_crc() / FOLDS) % ROUNDS
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == HELD_OUT_FOLD).alias("held_out"), turn.cast("int").alias("turn"), text_bytes().alias("text"))
    counts = materialize(word_counts(docs.where("not held_out").select("text")), "words")
    v = vocabulary(counts)
    coded = materialize(_encoded(docs, v), "ids")
    training = coded.where("not held_out").select("turn", "h", "doc_id", "bytes", "n_tokens", "ids")
    weights = train_rounds(training, *begin(training, new_weights(v)), v.tokens)
    shared = spark.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            ids, model = [_ids(raw) for raw in columns.pop("ids")], columns["model"].to_numpy().copy()
            ends = np.cumsum([len(x) for x in ids])
            while len(ids):  # SCORED_TOKENS or a little more at a time, a longer text alone
                done = len(ends) - len(ids)
                n = int(np.searchsorted(ends, (ends[done - 1] if done else 0) + SCORED_TOKENS)) + 1 - done
                model[done : done + n] += score_texts(shared.value, ids[:n]) / math.log(10)
                ids = ids[n:]
            columns["model"] = pa.array(model)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kept = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "model"]
    found = coded.select(*kept, "ids")
    found = materialize(found.mapInArrow(scored, found.drop("ids").schema), "scored")
    rare = coded.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("n"))
    rare = rare.join(counts.select("word", "c"), "word").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("gain"))
    base = F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(v.tokens + v.distinct + 1))
    return found.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("model") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )


def _encoded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """ENCODED: each row's text as the network's ids, which training and scoring read instead of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        lookup = Lookup(zip(v.words, range(len(v.words))))
        row = TaskContext.get().partitionId() << 33
        types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary())
        for piece in _pieces(batches):
            out = encode_batch(lookup, v, piece.column("text"))
            out["ids"] = [x.astype("<u2").tobytes() for x in out["ids"]]
            rows = pa.array(range(row, row + piece.num_rows), pa.int64())
            row += piece.num_rows
            kept = [piece.column(c) for c in ("doc_id", "held_out", "turn", "h", "bytes")]
            yield pa.RecordBatch.from_arrays([rows, *kept, *[pa.array(x, t) if not isinstance(x, pa.Array) else x for x, t in zip(out.values(), types)]], [c.split()[0] for c in ENCODED.split(", ")])

    return docs.select("doc_id", "held_out", "turn", F.xxhash64("doc_id", "text").alias("h"), F.length("text").cast("long").alias("bytes"), "text").mapInArrow(encoded, ENCODED)


def _sum_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of whole numbers, which no order of addition changes."""
    totals: dict[int, tuple] = {}
    for batch in batches:
        for part, n, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "w"))):
            tokens, total = totals.get(part, (0, 0))
            totals[part] = (tokens + n, total + np.frombuffer(raw, "<i8"))
    if totals:
        yield pa.RecordBatch.from_arrays([pa.array(totals, pa.int32()), pa.array([n for n, _ in totals.values()], pa.int64()), pa.array([x.tobytes() for _, x in totals.values()], pa.binary())], ["part", "n", "w"])


WEIGHT_BITS = 6  # weights lie between -64 and 64


def train_rounds(training: DataFrame, w: dict, adam: Adam, tokens: int, part_tokens: int = PART_TOKENS) -> dict[str, np.ndarray]:
    """Weights learned from all rows of training (turn, h, n_tokens, ids), of so many tokens, beginning with w and the moments of adam.

    A part's texts of more than LONG_TOKENS come first, the longest before the others, lest at the end a few lanes go on alone.
    A part's weights are sent in WEIGHT_PARTS slices that are averaged apart, so the driver gets one set of weights a round."""
    spark = training.sparkSession
    parts = max(1, -(-tokens // part_tokens))
    scale = 2.0 ** min(40, 62 - WEIGHT_BITS - max(1, tokens).bit_length())
    long = F.when(F.col("n_tokens") > LONG_TOKENS, -F.col("n_tokens")).otherwise(0)
    rows = training.select("turn", F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int").alias("part"), long.alias("long"), "h", "ids")
    schema = "part int, n long, w binary"
    for r in range(ROUNDS):
        shared, rate = spark.sparkContext.broadcast((w, adam)), ROUND_RATE * (1 - r / ROUNDS)

        def learned(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            sorted_rows = (row for b in batches for row in zip(b.column("part").to_pylist(), b.column("ids")))
            for _, own in groupby(sorted_rows, key=lambda row: row[0]):
                w, adam = copy.deepcopy(shared.value)
                n = train_stream(w, adam, (_ids(raw) for _, raw in own), rate)
                flat = np.concatenate([a.reshape(-1) for a in w.values()]).astype(np.float64)
                whole = np.rint(np.clip(flat, -(1 << WEIGHT_BITS), 1 << WEIGHT_BITS) * scale).astype(np.int64) * n
                slices = np.array_split(whole, WEIGHT_PARTS)
                yield pa.RecordBatch.from_arrays([pa.array(range(WEIGHT_PARTS), pa.int32()), pa.array([n] * WEIGHT_PARTS, pa.int64()), pa.array([x.astype("<i8").tobytes() for x in slices], pa.binary())], ["part", "n", "w"])

        own = rows.where(F.col("turn") == r).drop("turn")
        sent = own.repartitionById(parts, "part").sortWithinPartitions("part", "long", "h", "ids").select("part", "ids").mapInArrow(learned, schema)
        sums = sorted(sent.repartition("part").mapInArrow(_sum_weights, schema).collect())
        if sums:
            w = _unflattened(b"".join((np.frombuffer(m.w, "<i8") / (m.n * scale)).astype("<f4").tobytes() for m in sums), w)
    return w


def begin(training: DataFrame, w: dict) -> tuple[dict, Adam]:
    """Weights and moments that one task learns from _sample(), whatever the size of training, so a lost executor only
    repeats it."""
    shared = training.sparkSession.sparkContext.broadcast(w)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = copy.deepcopy(shared.value)
        adam = Adam(w)
        train(w, [_ids(raw) for b in batches for raw in b.column("ids")], adam)
        blobs = [np.concatenate([a.reshape(-1) for a in x.values()]).astype("<f4").tobytes() for x in (w, adam.first, adam.second)]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1, 2], pa.int32()), pa.array([adam.steps] * 3, pa.int64()), pa.array(blobs, pa.binary())], ["part", "steps", "w"])

    rows = sorted(_sample(training).coalesce(1).mapInArrow(begun, "part int, steps long, w binary").collect())
    adam = Adam(w)
    if rows:
        w, adam.first, adam.second = (_unflattened(bytes(r.w), w) for r in rows)
        adam.steps = rows[0].steps
    return w, adam


def _unflattened(raw: bytes, like: dict) -> dict[str, np.ndarray]:
    ends = np.cumsum([a.size for a in like.values()])
    return {k: x.reshape(a.shape).copy() for (k, a), x in zip(like.items(), np.split(np.frombuffer(raw, "<f4"), ends[:-1]))}


def _sample(training: DataFrame) -> DataFrame:
    """(ids): SAMPLE_DOCS training texts of at most SAMPLE_BYTES, the smallest by a hash of the row, in its order."""
    rows = training.where(F.col("bytes") <= SAMPLE_BYTES)
    least = rows.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    return rows.where(F.col("h") <= F.lit(least)).orderBy("h", "doc_id").limit(SAMPLE_DOCS).select("ids")


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model and a base learned from the other folds."""
    return lm_scores(documents(spark, sf_dir).select("doc_id", "text"))
