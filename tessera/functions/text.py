"""Labels, questions and plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: question types by what a question mentions, in order of precedence
QUESTION_TYPES = {
    "instrument": ["instrument", "tool", "device"],
    "phase": ["phase", "step", "stage"],
    "action": ["action", "doing", "performing", "happening"],
    "anatomy": ["anatomy", "organ", "tissue", "structure"],
    "yes_no": ["is there", "is the", "are there", "can you see"],
    "count": ["how many", "count", "number of"],
    "location": ["where", "location", "position"],
    "what": ["what is", "what are"],
}
QA_TYPES = ("phase", "step", "instrument", "position", "yes_no", "operation_note")
# fixed values: words of small numbers, and a published scale of agreement
NUMBER_WORDS = ("None", "One", "Two", "Three", "Four", "Five")
KAPPA_BANDS = [(0.0, "Poor"), (0.2, "Slight"), (0.4, "Fair"), (0.6, "Moderate"), (0.8, "Substantial")]


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normal_label(label: Column, category: Column, synonyms: dict[str, str]) -> Column:
    """Synonyms hold for anatomy only."""
    plain = F.lower(F.trim(label))
    return F.when(category == "anatomy", F.coalesce(F.element_at(literal_map(synonyms), plain), plain)).otherwise(plain) if synonyms else plain


def display_name(label: Column, names: dict[str, str]) -> Column:
    """The given name, else the label with spaces for underscores."""
    spaced = F.translate(label, "_", " ")
    return F.coalesce(F.element_at(literal_map(names), label), spaced) if names else spaced


def clean(text: Column, lower: bool = True, punctuation: bool = True) -> Column:
    """White space collapsed; lower case and no punctuation if asked for."""
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.lower(text) if lower else text
    text = text if punctuation else F.regexp_replace(text, r"(?U)[^\w\s]", "")
    return F.trim(text)


def clean_question(text: Column) -> Column:
    """Ends with a question mark unless it is empty."""
    c = clean(text)
    return F.when((c != "") & ~c.endswith("?"), F.concat(c, F.lit("?"))).otherwise(c)


def question_type(text: Column) -> Column:
    """P28."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike("|".join(words)), kind) for kind, words in QUESTION_TYPES.items()], F.lit("other"))


def label_in_text(text: Column, labels: list[str], variants: int = 3) -> Column:
    """The first label of the list that occurs as it is, with spaces or (3 variants) without separators; else unknown."""
    low = F.lower(text)

    def occurs(label: str) -> Column:
        forms = [label.replace("_", " ")] if variants == 1 else [label, label.replace("_", " "), label.replace("_", "")]
        found = F.lit(False)
        for form in forms:
            found = found | low.contains(form.lower())
        return found

    return F.coalesce(*[F.when(occurs(x), x) for x in labels], F.lit("unknown"))


def qa_type(name: Column) -> Column:
    """P20."""
    plain = F.translate(F.lower(name), " -", "__")
    return F.when(plain.isin(*QA_TYPES), plain).otherwise("unknown")


def video_of_frame(frame: Column) -> Column:
    """P23."""
    parts = F.split(frame, "_")
    return F.when(F.size(parts) >= 2, parts[0]).otherwise("unknown")


def video_for_leakage(frame: Column) -> Column:
    """Before a slash, before _frame_, or before trailing _digits; else null."""
    return (
        F.when(frame.contains("/"), F.substring_index(frame, "/", 1))
        .when(frame.contains("_frame_"), F.substring_index(frame, "_frame_", 1))
        .when(frame.rlike(r"_\d+$"), F.regexp_replace(frame, r"_\d+$", ""))
    )


def category_of(label: Column, vocabulary: dict[str, list[str]]) -> Column:
    """The first category that has the label, else null."""
    return F.coalesce(*[F.when(label.isin(*labels), c) for c, labels in vocabulary.items()])


def skill_index(label: Column, labels: list[str]) -> Column:
    """An unknown label gets the last place."""
    at = F.array_position(F.array(*map(F.lit, labels)), label)
    return F.coalesce(F.nullif(at, F.lit(0)) - 1, F.lit(len(labels) - 1)).cast("int")


def label_index(label: Column, labels: list[str]) -> Column:
    """From 1, whatever the case; 0 is unknown."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x.lower()) for x in labels]), F.lower(label)), F.lit(0)).cast("int")


def answer_index(answer: Column, answers: list[str]) -> Column:
    """The place of an answer, -1 if it isn't one of them."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, answers)), answer) - 1, F.lit(-1)).cast("int")


def first_of(df, fields: dict[str, list[str]]) -> list[Column]:  # noqa: ANN001
    """P20: for each field the first of its names that df has and that isn't null."""
    there = lambda names: [F.col(f"`{n}`") for n in names if n in df.columns]
    return [F.coalesce(*there(names), F.lit(None)).alias(field) for field, names in fields.items()]


def resolved_path(df, files, patterns: list[str], path: str = "image_path", names: tuple[str, ...] = ("video_id", "frame_id")):  # noqa: ANN001, ANN201
    """P25: df with `resolved`: its own path if it has one, else the first of patterns ({video_id}/{frame_id}.png, say) that is among files
    (path), else the first pattern. One join, with a pattern's place as priority."""
    own = F.col(path) if path in df.columns else F.lit(None).cast("string")
    of = lambda p: fill(F.lit(p), {n: F.col(n).cast("string") for n in names})
    keyed = df.withColumn("_key", F.struct(*names))
    tried = keyed.select("_key", F.posexplode(F.array(*map(of, patterns))).alias("_i", "path")).distinct()
    best = tried.join(files.select("path").distinct(), "path", "left_semi").groupBy("_key").agg(F.min_by("path", "_i").alias("_found"))
    return keyed.join(best, "_key", "left").withColumn("resolved", F.coalesce(F.nullif(own, F.lit("")), "_found", of(patterns[0]))).drop("_key", "_found")


def char_ids(text: Column, size: int = 30522, length: int = 128) -> Column:
    """Code points modulo size, filled with zeros to length."""
    ids = F.transform(F.split(F.substring(text, 1, length), ""), lambda c: F.ascii(c) % size)
    ids = F.when(F.length(text) > 0, ids).otherwise(F.array().cast("array<int>"))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, length)


def kappa_band(kappa: Column) -> Column:
    """P36."""
    out = F.when(kappa.isNull() | F.isnan(kappa), "N/A")
    for most, name in KAPPA_BANDS:
        out = out.when(kappa < most, name)
    return out.otherwise("Almost Perfect")


def confidence_band(confidence: Column) -> Column:
    """P37."""
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.7, "medium").otherwise("low")


def size_category(n: Column) -> Column:
    """Of a dataset."""
    out = None
    for most, name in ((1000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K"), (1_000_000, "100K<n<1M")):
        out = F.when(n < most, name) if out is None else out.when(n < most, name)
    return out.otherwise("n>1M")


def english_list(items: Column) -> Column:
    """P38: "a, b and c"."""
    n = F.size(items)
    most = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, "").when(n == 1, items[0]).otherwise(F.concat(most, F.lit(" and "), F.element_at(items, -1)))


def number_word(n: Column) -> Column:
    return F.when(n.between(0, 5), F.get(F.array(*map(F.lit, NUMBER_WORDS)), n.cast("int"))).otherwise(n.cast("string"))


def pick(options: list[str], key: Column, seed: str = "") -> Column:
    """One of options by a hash of key."""
    at = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("long") % len(options)
    return F.get(F.array(*map(F.lit, options)), at.cast("int"))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """The template with each {name} replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def annotation_id(video: Column, label: Column, timestamps: Column) -> Column:
    """P40."""
    return F.concat_ws("_", video, label, F.array_join(F.slice(timestamps, 1, 3), "_"))


def exact_match(a: Column, b: Column) -> Column:
    """P43."""
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""))


def keyword_score(found: Column, truth: Column) -> Column:
    """P43 on arrays of keywords: 1 for equal sets, 0.5 for an overlap; 0 if truth is empty."""
    same = (F.size(F.array_except(found, truth)) == 0) & (F.size(F.array_except(truth, found)) == 0)
    return F.when(F.size(truth) == 0, 0.0).when(same, 1.0).when(F.size(F.array_intersect(found, truth)) > 0, 0.5).otherwise(0.0)


def contains_either(a: Column, b: Column) -> Column:
    """Either contains the other; an empty text contains nothing and isn't contained."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def chat_text(messages: Column) -> Column:
    """P53: "User: .. Assistant: .." in the order given."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.initcap(m.role), F.lit(": "), m.content)), "\n")


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, all of a's places at once: bit i of `open_` says that the table's row doesn't
    rise at a's i-th word."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    open_ = whole
    for y in b:
        hit = open_ & places.get(y, 0)
        open_ = (open_ + hit | open_ - hit) & whole
    return len(a) - open_.bit_count()


def rouge_l(df, candidate: str, reference: str, name: str = "rouge_l", stem=None):  # noqa: ANN001, ANN201
    """Df with the ROUGE-L F1 of two texts: twice their longest common subsequence of words (a-z and 0-9) over the sum of their lengths,
    0 without words. stem: a function applied to each word, none by default."""
    import re

    import pyarrow as pa

    def words(text: str | None) -> list[str]:
        found = re.findall(r"[a-z0-9]+", (text or "").lower())
        return [stem(w) for w in found] if stem else found

    def score(a: list[str], b: list[str]) -> float:
        return 2 * common_length(a, b) / (len(a) + len(b)) if a and b else 0.0

    def scored(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            out = [score(words(x), words(y)) for x, y in zip(batch.column(candidate).to_pylist(), batch.column(reference).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, name])

    kept = df.drop(name)
    return kept.mapInArrow(scored, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema], f"{name} double"]))


def bleu(candidate: Column, reference: Column, n: int = 1) -> Column:
    """Sentence BLEU up to n-grams, with an epsilon of 0.1 for orders without a match; 0 without any common word. For short texts; ngram_hits()
    counts by aggregation."""

    def common(x: Column, y: Column) -> Column:
        return F.aggregate(F.array_distinct(x), F.lit(0), lambda s, g: s + F.least(F.size(F.filter(x, lambda t: t == g)), F.size(F.filter(y, lambda t: t == g))))

    a, b = blank_words(candidate), blank_words(reference)
    hits = [common(grams(a, k), grams(b, k)) for k in range(1, n + 1)]
    return bleu_of(hits, [F.size(grams(a, k)) for k in range(1, n + 1)], F.size(a), F.size(b))


def blank_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def grams(words: Column, k: int) -> Column:
    """Runs of k words, joined by spaces."""
    places = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, k), " "))


def bleu_of(hits: list[Column], sizes: list[Column], length: Column, wanted: Column) -> Column:
    """BLEU of n-gram hits and numbers of n-grams by order, and the lengths of candidate and reference."""
    logs = sum((F.log(F.greatest(h.cast("double"), F.lit(0.1)) / F.greatest(m, F.lit(1))) for h, m in zip(hits, sizes)), F.lit(0.0))
    short = F.when(length > wanted, 0.0).otherwise(1 - wanted / F.greatest(length, F.lit(1)))
    return F.when(hits[0] > 0, F.exp(logs / len(hits) + short)).otherwise(0.0)


def _gram_counts(words, ends, n: int):  # noqa: ANN001, ANN202
    """By pair of texts the counts of ngram_hits(), in its order. words: codes of the words of text after text, candidate and reference by turns;
    ends: where each text ends."""
    import numpy as np

    sizes = np.diff(ends, prepend=0)
    rows, text = len(ends) // 2, np.repeat(np.arange(len(ends)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(words))  # words to the end of the text
    span = int(words.max(initial=0)) + 1
    at, gram = np.arange(len(words)), text // 2  # places where a k-gram begins, and its number, which tells the pair too
    hits, size = np.zeros((n, rows), np.int64), np.zeros((n, rows), np.int64)
    for k in range(1, n + 1):
        inside = left[at] >= k
        at = at[inside]
        found, gram = np.unique(gram[inside] * span + words[at + k - 1], return_inverse=True)
        own = text[at] % 2 == 0
        both = np.minimum(np.bincount(gram[own], minlength=len(found)), np.bincount(gram[~own], minlength=len(found)))
        pair = np.zeros(len(found), np.int64)
        pair[gram] = text[at] // 2
        hits[k - 1] = np.bincount(pair, both, minlength=rows).astype(np.int64)
        size[k - 1] = np.maximum(sizes[::2] - (k - 1), 0)
    return [*hits, *size, sizes[1::2]]


GRAM_WORDS = 1 << 19  # words of pairs at a time; a pair is never cut


def ngram_hits(pairs, key: str, candidate: str, reference: str, n: int = 4):  # noqa: ANN001, ANN201
    """By key, for each order k up to n, hits_k (n-grams of the candidate found in the reference, each as often as it is there), size_k, and the
    lengths in words. Key is one row's own. Each row is counted where it lies, by sorting numbers of n-grams, with no shuffle; null texts have no words."""
    import numpy as np
    import pyarrow as pa

    names = [f"hits_{k}" for k in range(1, n + 1)] + [f"size_{k}" for k in range(1, n + 1)] + ["wanted"]

    def counted(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            sides = [batch.column(c) for c in ("_a", "_b")]
            upto = np.cumsum(sum(c.value_lengths().to_numpy() for c in sides).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, GRAM_WORDS + (upto[lo - 1] if lo else 0), side="right")))
                a, b = (c.slice(lo, hi - lo) for c in sides)
                turns = pa.array(np.arange(2 * (hi - lo)).reshape(2, -1).T.ravel())  # candidate and reference by turns
                texts = pa.concat_arrays([a, b]).take(turns)
                codes = texts.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
                counts = _gram_counts(codes, np.cumsum(texts.value_lengths().to_numpy().astype(np.int64)), n)
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(lo, hi - lo), *[pa.array(c, pa.int64()) for c in counts]], [key, *names])
                lo = hi

    words = [blank_words(F.coalesce(F.col(c), F.lit(""))).alias(name) for c, name in ((candidate, "_a"), (reference, "_b"))]
    kind = dict(pairs.dtypes)[key]
    return pairs.select(key, *words).mapInArrow(counted, ", ".join([f"`{key}` {kind}", *[f"{c} long" for c in names]]))


def sentence_bleu(hits, key: str, orders: tuple[int, ...] = (1, 4)):  # noqa: ANN001, ANN201
    """(key, bleu_1, bleu_4, ..) of ngram_hits(), as bleu() gives them."""
    up = lambda name, n: [F.col(f"{name}_{k}") for k in range(1, n + 1)]
    return hits.select(key, *[bleu_of(up("hits", n), up("size", n), F.col("size_1"), F.col("wanted")).alias(f"bleu_{n}") for n in orders])


def corpus_bleu(hits, orders: tuple[int, ...] = (1, 4)):  # noqa: ANN001, ANN201
    """One row: BLEU of the sums over all pairs of ngram_hits()."""
    names = [c for c in hits.columns if c.startswith(("hits_", "size_")) or c == "wanted"]
    total = hits.agg(F.count("*").alias("pairs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    return sentence_bleu(total, "pairs", orders)
