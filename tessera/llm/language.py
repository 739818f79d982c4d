"""Language identification: scripts narrow the candidates, Viterbi labels spans of words.

Character trigrams of words are counted over all training rows, language by language. The KEPT most frequent
of each language are kept one by one; the others share TAIL buckets by a hash, with the mean count of a
bucket's trigrams in each language, so none is dropped and the model's size is bounded. A word scores its
trigrams' log probabilities, for the languages only that use its script in training. Viterbi over the words with a
switching penalty gives each word a language, and so spans of mixed-language text; the language that covers
most letters is the document's, and its share of all letters the score.

A text of more than LONG characters is cut into pieces at white space, and these into segments. A segment's best
scores from each label before it to each label at its end are found for all segments of a piece side by side;
chaining them gives the labels at the cuts of the best path, and between two cuts the path is found segment by segment.
That is exact, and what is held is one piece, a label a word, and a pointer a label and segment.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, key_crc, materialize, put_back, set_aside

UNDETERMINED = "und"
FOLDS, HELD_OUT_FOLD = 4, 2
KEPT, TAIL = 20_000, 1 << 14
SWITCH = 6.0  # nats
SCRIPT_SHARE = 0.001  # of a language's training letters, to count a script as its own
COUNTER_CAP, CACHE = 200_000, 400_000
GRID, LANES = 1 << 22, 512
LONG, SEGMENT, GRAMS = 1 << 18, 256, 1 << 18
MIN_EXPLAINED = 0.5
PUNCTUATION = ".,;:!?()[]{}\"'|-*#%&$0123456789"

# fixed values: blocks of scripts, by first code point
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2E80, "han"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3400, "han"),
    (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0xFFDD, "other"), (0x20000, "han"), (0x30000, "other"),
]
_starts = [s for s, _ in SCRIPTS]


def script_of(word: str) -> str:
    """The script of most letters; the first such on a tie."""
    if max(word) < "\u0370":
        return "latin"
    seen = Counter(SCRIPTS[bisect_right(_starts, ord(c)) - 1][1] for c in word)
    return max(seen, key=seen.__getitem__)


def letters(token: str) -> str:
    if not token.isalpha():
        token = token.strip(PUNCTUATION)
        if not token.isalpha():
            return "".join(filter(str.isalpha, token))
    return token


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = defaultdict(Counter)

    def flush() -> pa.RecordBatch:
        names, found, sizes = [], [], []
        for lang, counts in words.items():
            grams: dict[str, int] = defaultdict(int)
            for token, n in counts.items():
                if word := letters(token):
                    grams["!" + script_of(word)] += n * len(word)
                    s = f"^{word}$"
                    for i in range(len(word)):
                        grams[s[i : i + 3]] += n
            names += [lang] * len(grams)
            found += grams
            sizes += grams.values()
        words.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string()), pa.array(sizes, pa.int64())], ["lang", "gram", "n"])

    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
            words[lang].update(text.as_py().lower().split())
            if sum(map(len, words.values())) > COUNTER_CAP:
                yield flush()
    if words:
        yield flush()


class Model:
    """Trigram log probabilities by language, and each script's languages."""

    def __init__(self, rows: list[tuple[str, str, int, int]], tail: list[tuple[str, int, float]] = ()) -> None:
        """rows: (lang, trigram or "!script", count, all trigrams of lang); tail: (lang, bucket, mean count)."""
        self.langs = sorted({r[0] for r in rows})
        at = {x: k for k, x in enumerate(self.langs)}
        totals = np.ones(len(self.langs))
        scripts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(self.langs)))
        for lang, gram, n, total in rows:
            totals[at[lang]] = total
            if gram[0] == "!" and len(gram) > 3:
                scripts[gram[1:]][at[lang]] = n
        all_letters = sum(scripts.values(), np.zeros(len(self.langs)))
        self.scripts = {s: n > SCRIPT_SHARE * np.maximum(all_letters, 1) for s, n in scripts.items()}
        floor = -np.log(totals + KEPT)
        counts: dict[str, np.ndarray] = {}
        for lang, gram, n, _ in rows:
            if not (gram[0] == "!" and len(gram) > 3):
                counts.setdefault(gram, np.zeros(len(self.langs)))[at[lang]] = n
        self.place = {g: k + 1 for k, g in enumerate(counts)}
        # row 0: any other trigram, unless there is a tail, whose buckets come last
        self.tail = len(counts) + 1 if tail else 0
        shared = np.zeros((TAIL if tail else 0, len(self.langs)))
        for lang, bucket, mean in tail:
            shared[bucket, at[lang]] = mean
        self.grams = np.log(np.concatenate([np.zeros((1, len(self.langs))), np.array(list(counts.values())).reshape(len(counts), len(self.langs)), shared]) + 1) + floor
        self.forget()

    def parts(self) -> tuple:
        return self.langs, self.place, self.grams, self.scripts, self.tail

    @classmethod
    def of(cls, parts: tuple) -> Model:
        out = cls([])
        out.langs, out.place, out.grams, out.scripts, out.tail = parts
        out.forget()
        return out

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.langs)), np.float32)
        self.size = np.zeros(1024, np.int32)
        self.blind = np.zeros(1024, bool)

    def _rows(self, s: str, lo: int, hi: int) -> list[int]:
        """Rows of the trigrams that begin at places lo to hi of s, a word between its marks."""
        get = self.place.get
        if not self.tail:
            return [get(s[i : i + 3], 0) for i in range(lo, hi)]
        return [get(g := s[i : i + 3]) or self.tail + zlib.crc32(g.encode()) % TAIL for i in range(lo, hi)]

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By word, which has letters, its scores, 0 for the best language; and whether no language has its script."""
        out, lo = np.empty((len(words), len(self.langs))), 0
        while lo < len(words):
            rows, hi = [], lo
            while hi < len(words) and len(rows) + len(words[hi]) <= GRAMS:
                rows += self._rows(f"^{words[hi]}$", 0, len(words[hi]))
                hi += 1
            if rows:
                sizes = np.fromiter(map(len, words[lo:hi]), np.int64, hi - lo)
                out[lo:hi] = np.add.reduceat(self.grams[rows], np.cumsum(sizes) - sizes)
            else:  # a word of any length, part by part
                s, n, hi = f"^{words[lo]}$", len(words[lo]), lo + 1
                out[lo] = sum(self.grams[self._rows(s, at, min(n, at + GRAMS))].sum(axis=0) for at in range(0, n, GRAMS))
            lo = hi
        # a script of no language is no evidence
        every = np.ones(len(self.langs), bool)
        masks = [self.scripts.get(script_of(w)) for w in words]
        blind = np.array([m is None or not m.any() for m in masks])
        fits = np.array([every if m is None else m for m in masks])
        out = np.where(fits, out, out.min(axis=1, keepdims=True) - 10.0)
        out -= out.max(axis=1, keepdims=True)
        out[blind] = 0
        return out, blind

    def learn(self, wanted: set[str], batch: set[str]) -> None:
        if len(self.known) > CACHE:
            self.forget()
            wanted = batch
        need = len(self.known) + len(wanted)
        if need > len(self.size):
            more = max(need, 2 * len(self.size)) - len(self.size)
            self.scores = np.concatenate([self.scores, np.zeros((more, len(self.langs)), np.float32)])
            self.size = np.concatenate([self.size, np.zeros(more, np.int32)])
            self.blind = np.concatenate([self.blind, np.zeros(more, bool)])
        new = list(wanted)
        words = list(map(letters, new))
        first = len(self.known)
        self.known.update(zip(new, range(first, first + len(new))))
        self.size[first : first + len(new)] = list(map(len, words))
        full = [k for k, w in enumerate(words) if w]
        if full and self.langs:
            at = first + np.array(full)
            self.scores[at], self.blind[at] = self.word_scores([words[k] for k in full])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """By text the places of its tokens, lower-case runs without white space."""
        split = [t.lower().split() for t in texts]
        batch = set().union(*split)
        self.learn(batch - self.known.keys(), batch)
        return [np.fromiter(map(self.known.__getitem__, x), np.int32, len(x)) for x in split]

    def label(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """By text (language of each token, letters of each token, letters in scripts of no language)."""
        out: list = [None] * len(texts)
        short = [k for k, t in enumerate(texts) if len(t) <= LONG or not self.langs]
        ids = dict(zip(short, self.ids([texts[k] for k in short])))
        order = sorted(short, key=lambda k: -len(ids[k]))
        lo = 0
        while lo < len(order):
            # longer texts go in fewer at a time, which bounds the grid
            lane = order[lo : lo + max(1, min(LANES, GRID // max(1, len(ids[order[lo]]) * len(self.langs))))]
            lo += len(lane)
            for k, path in zip(lane, viterbi([self.scores[ids[k]] for k in lane])):
                out[k] = (path, self.size[ids[k]], int(self.size[ids[k]][self.blind[ids[k]]].sum()))
        for k, t in enumerate(texts):
            if out[k] is None:
                out[k] = self.label_long(t)
        return out

    def label_long(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        k = len(self.langs)
        value, cuts, sizes, blind, counts = np.zeros(k), [], [], 0, []
        for piece in _pieces(text):
            (ids,) = self.ids([piece])
            sizes.append(self.size[ids])
            blind += int(sizes[-1][self.blind[ids]].sum())
            counts.append(-(-len(ids) // SEGMENT))
            for step in _transfers(self.scores[ids]):
                through = value[:, None] + step  # from a label before to one at the end
                cuts.append(through.argmax(axis=0).astype(np.int16))
                value = through.max(axis=0)
                value -= value.max()
        last = np.empty(len(cuts) + 1, np.int64)
        last[-1] = value.argmax()
        for i in range(len(cuts) - 1, -1, -1):
            last[i] = cuts[i][last[i + 1]]
        paths, at = [], 0
        for piece, n in zip(_pieces(text), counts):
            (ids,) = self.ids([piece])
            paths.append(_between(self.scores[ids], last[at : at + n], last[at + 1 : at + n + 1]))
            at += n
        return np.concatenate(paths), np.concatenate(sizes), blind

    def predict(self, path: np.ndarray, size: np.ndarray) -> tuple[str, float]:
        total = int(size.sum())
        if not total or not self.langs:
            return UNDETERMINED, 0.0
        share = np.bincount(path, size, len(self.langs)) / total
        best = int(share.argmax())
        return self.langs[best], float(share[best])


def _pieces(text: str) -> Iterator[str]:
    """Parts of about LONG characters, cut at white space."""
    space, lo = re.compile(r"\s"), 0
    while lo < len(text):
        cut = space.search(text, lo + LONG)
        hi = cut.start() if cut else len(text)
        yield text[lo:hi]
        lo = hi


def _segments(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores by place and segment, the segments' lengths)."""
    n = -(-len(scores) // SEGMENT)
    sizes = np.full(n, SEGMENT)
    if n:
        sizes[-1] = len(scores) - (n - 1) * SEGMENT
    grid = np.zeros((n * SEGMENT, scores.shape[1]), np.float32)
    grid[: len(scores)] = scores
    return grid.reshape(n, SEGMENT, -1).swapaxes(0, 1), sizes


def _transfers(scores: np.ndarray) -> np.ndarray:
    """By segment the best score from each label before it (rows) to each label at its end (columns)."""
    grid, sizes = _segments(scores)
    k = scores.shape[1]
    value = np.tile(np.where(np.eye(k, dtype=bool), 0, -SWITCH), (len(sizes), 1, 1))
    for t in range(SEGMENT):
        live = int((sizes > t).sum())  # only the last can be shorter
        part = value[:live]
        if t:
            np.maximum(part, part.max(axis=2, keepdims=True) - SWITCH, out=part)
        part += grid[t, :live, None, :]
    return value


def _between(scores: np.ndarray, before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The best labels of each segment's words, given the label before it and that of its last word."""
    grid, sizes = _segments(scores)
    n, k = len(sizes), scores.shape[1]
    came, top = np.zeros((SEGMENT, n, k), bool), np.zeros((SEGMENT, n), np.int16)
    value = np.full((n, k), -np.float32(SWITCH))
    value[np.arange(n), before] = 0
    for t in range(SEGMENT):
        live = int((sizes > t).sum())
        part = value[:live]
        if t:
            top[t, :live] = best = part.argmax(axis=1)
            jump = part[np.arange(live), best][:, None] - np.float32(SWITCH)
            np.greater(jump, part, out=came[t, :live])
            np.maximum(part, jump, out=part)
        part += grid[t, :live]
        part -= part.max(axis=1, keepdims=True)
    path, now, rows = np.zeros((n, SEGMENT), np.int16), last.copy(), np.arange(n)
    for t in range(SEGMENT - 1, -1, -1):
        live = int((sizes > t).sum())
        path[:live, t] = now[:live]
        jumped = came[t, rows[:live], now[:live]]
        now[:live] = np.where(jumped, top[t, :live], now[:live])
    return path.reshape(-1)[: len(scores)]


def viterbi(scores: list[np.ndarray]) -> list[np.ndarray]:
    """Best label sequences for texts given scores (words, labels), longest first; a change of label costs SWITCH.
    Ties keep the label, and take the first label at the end."""
    n = np.array([len(s) for s in scores])
    if not len(n) or not n[0]:
        return [np.zeros(0, np.int64) for _ in scores]
    k = scores[0].shape[1]
    grid = np.zeros((n[0], len(scores), k), np.float32)
    for j, s in enumerate(scores):
        grid[: len(s), j] = s
    came = np.zeros(grid.shape, bool)  # from the best label before, by a switch
    top = np.zeros(grid.shape[:2], np.int16)  # the best label before
    value = grid[0].copy()
    ends = np.zeros(len(scores), np.int64)
    for t in range(1, n[0]):
        live = int(np.searchsorted(-n, -t, side="left"))
        if live < len(value):
            ends[live : len(value)] = value[live:].argmax(axis=1)
            value = value[:live]
        best = value.argmax(axis=1)
        jump = value[np.arange(live), best][:, None] - np.float32(SWITCH)
        np.greater(jump, value, out=came[t, :live])
        top[t, :live] = best
        value = np.maximum(value, jump)
        value += grid[t, :live]
        value -= value.max(axis=1, keepdims=True)
    ends[: len(value)] = value.argmax(axis=1)
    paths = np.zeros((n[0], len(scores)), np.int64)
    now = ends.copy()
    cols = np.arange(len(scores))
    for t in range(n[0] - 1, -1, -1):
        live = int(np.searchsorted(-n, -t, side="left"))
        paths[t, :live] = now[:live]
        if t:
            jumped = came[t, cols[:live], now[:live]]
            now[:live] = np.where(jumped, top[t, :live], now[:live])
    return [paths[: n[j], j] for j in range(len(scores))]


def train(labelled: DataFrame) -> Model:
    """A model from all rows (text, lang) with a language and a text."""
    rows = labelled.where("lang is not null and text is not null").select("text", "lang")
    counts = materialize(rows.mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigrams")
    is_script = F.col("gram").rlike("^!.{3}")
    totals = {r.lang: r.total for r in counts.where(~is_script).groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    scripts = [(r.lang, r.gram, r.n) for r in counts.where(is_script).collect()]
    grams = counts.where(~is_script)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = [(r.lang, r.gram, r.n) for r in grams.withColumn("place", place).where(F.col("place") <= KEPT).select("lang", "gram", "n").collect()]
    held, least = Counter(lang for lang, _, _ in kept), {}
    for lang, gram, n in kept:
        if held[lang] == KEPT:
            least[lang] = max(least.get(lang, (-n, gram)), (-n, gram))
    tail = []
    if least:
        ends = counts.sparkSession.createDataFrame([(lang, -n, g) for lang, (n, g) in least.items()], "lang string, last_n long, last_gram string")
        rest = grams.join(F.broadcast(ends), "lang").where((F.col("n") < F.col("last_n")) | ((F.col("n") == F.col("last_n")) & (F.col("gram") > F.col("last_gram"))))
        rest = rest.groupBy("lang", (F.crc32(F.col("gram").cast("binary")) % TAIL).cast("int").alias("bucket")).agg(F.avg("n").alias("mean"))
        tail = [(r.lang, r.bucket, r["mean"]) for r in rest.collect()]
    return Model([(lang, gram, n, totals.get(lang, 1)) for lang, gram, n in scripts + kept], tail)


PREDICTED = {"lang_pred": "string", "score": "double", "explained": "double", "spans": "array<struct<lang:string,words:int>>"}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score, explained (the share of letters in a script of some language) and spans (runs of
    words of one language) in place of any columns of these names.

    A null text, or one without a letter, is "und" with score 0. Only the text decides. Of languages with equal shares the
    first in order wins. Repeated rows come back repeated; without training rows all texts are "und". Texts of any length are labelled whole, a
    segment at a time; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    kept = docs.drop(*PREDICTED)
    span = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.of(shared.value)
        for big in batches:
            for lo in range(0, big.num_rows, 2 * LANES):
                batch, rows = big.slice(lo, 2 * LANES), []
                for path, size, blind in own.label([x or "" for x in batch.column("text").to_pylist()]):
                    edge = np.flatnonzero(np.diff(path, prepend=-1)) if size.any() and own.langs else np.zeros(0, np.int64)
                    runs = np.diff(edge, append=len(path))
                    rows.append((*own.predict(path, size), 1 - blind / max(1, int(size.sum())), [{"lang": own.langs[path[a]], "words": int(r)} for a, r in zip(edge, runs)]))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.float64(), pa.float64(), span))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *PREDICTED])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return kept.mapInArrow(predicted, ", ".join([*fields, *[f"{k} {v}" for k, v in PREDICTED.items()]]))


def train_on_folds(docs: DataFrame) -> Model:
    return train(docs.where(key_crc() % FOLDS != HELD_OUT_FOLD).select("text", "lang"))


def keep_identified(docs: DataFrame, model: Model, min_explained: float = MIN_EXPLAINED) -> DataFrame:
    """docs without those that are undetermined or of whose letters less than min_explained are in a script of some
    language. Texts of several languages stay."""
    columns = docs.columns
    docs, moved = set_aside(docs, list(PREDICTED))
    found = identify(docs, model)
    return put_back(found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("explained") >= min_explained)), columns, moved)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a model learned from the other folds."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = train_on_folds(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (key_crc() % FOLDS == HELD_OUT_FOLD).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
