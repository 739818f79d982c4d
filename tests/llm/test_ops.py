"""Each operator against a brute-force version, and the cases every operator must bear."""

import base64
import hashlib
import json
import math
import os
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import audio, chat, chunks, decontaminate, language, lines, lm, pfor, pieces, secrets, simhash
from tessera.llm.queries import queries

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [
    (None, "a row without an id of its own here"),
    (900001, None),
    (900002, ""),
    (900003, "!!! ... 12 %%"),
    (900004, "one"),
    (900005, LONG),
    (900006, "the same words in a row again and again\nthe same words in a row again and again"),
    (900006, "the same words in a row again and again\nthe same words in a row again and again"),
    (900007, "  two  spaces ▁ mark \x00 zero 日本語 \U0001f600\r\n\tend \n"),
    (900008, "Другой язык без примеров"),
    (900006, "another text of the same id"),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables with rows of odd cases and a further column whose names clash."""
    path = tmp_path_factory.mktemp("tables")
    docs = pq.read_table(f"{SF}/documents.parquet")
    rows = docs.select(["doc_id", "text", "lang", "source", "n_chars"]).to_pylist()
    rows += [{"doc_id": i, "text": t, "lang": None, "source": None, "n_chars": None} for i, t in ODD]
    table = pa.Table.from_pylist(rows, docs.select(["doc_id", "text", "lang", "source", "n_chars"]).schema)
    for name in ("score", "ids", "fp", "row", "hit_words", "tokens"):
        table = table.append_column(name, pa.array(["x"] * len(table)))
    pq.write_table(table, path / "documents.parquet")
    for name in ("benchmark", "conversations"):
        pq.write_table(pq.read_table(f"{SF}/{name}.parquet"), path / f"{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for name in ("documents", "benchmark", "conversations", "labels", "embeddings", "pages"):
        pq.write_table(pq.read_table(f"{SF}/{name}.parquet").slice(0, 0), path / f"{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(folder):
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()]


def rows(spark, name, folder):
    return queries()[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, empty, name):
    found = rows(spark, name, empty)
    assert len(found) == (1 if name == "op9_chat" else 0)


# SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in combinations(nodes, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash(spark, folder, docs):
    found = rows(spark, "op1_simhash", folder)
    fps = [(i, brute_fingerprint(t)) for i, t in docs]
    root = brute_components(sorted({f for _, f in fps}), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    wanted = Counter((i, f"{f:016x}", least.get(root[f])) for i, f in fps)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == wanted


@pytest.mark.parametrize("cap", [2, 10_000])
def test_simhash_lists_of_any_length(spark, monkeypatch, cap):
    monkeypatch.setattr(simhash, "LIST_CAP", cap)
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 6).tolist()
    fps = {c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for c in centres for _ in range(40)}
    fps |= set(rng.integers(0, 1 << 63, 50).tolist())
    fps = sorted({simhash._signed(f) for f in fps})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r.u: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    wanted = brute_components(fps, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert {f: found.get(f, f) for f in fps} == wanted


def test_simhash_dedup_keeps_one(spark, folder, docs):
    groups = {r.doc_id: r.component_id for r in rows(spark, "op1_simhash", folder)}
    kept = simhash.simhash_dedup(spark.read.parquet(f"{folder}/documents.parquet"))
    assert "score" in kept.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert set(ids) - {None} == {i for i, c in groups.items() if i is not None and i == c}
    assert ids[900006] == 2 if groups[900006] == 900006 else True


def test_simhash_dedup_judges_rows_by_their_own_text(spark):
    a, c, d, e = "one two three four five six", "seven eight nine ten eleven twelve", "red green blue white black", "up down left right"
    data = [(1, a, "p"), (2, a, "p"), (2, d, "p"), (5, a, "p"), (5, c, "p"), (7, c, "p"), (None, a, "p"), (None, a, "p"), (None, None, "p"), (8, e, "p"), (8, e, "q"), (8, e, "q"), (9, None, "p"), (9, "", "p"), (10, " ", "p")]
    for part in (data, data[::-1]):
        found = simhash.simhash_dedup(spark.createDataFrame(part, "doc_id long, text string, _text string").repartition(3)).collect()
        kept = Counter((r.doc_id, r.text) for r in found)
        assert kept.pop((9, None), 0) + kept.pop((9, ""), 0) == 1
        assert kept == {(1, a): 1, (2, d): 1, (5, c): 1, (8, e): 1, (None, a): 2, (None, None): 1}
        assert {r["_text"] for r in found} <= {"p", "q"}


def test_simhash_hot_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SHARE", 4)
    data = [(i, "the same words in each of these") for i in range(5, 60)] + [(i, f"text {i} of its {i * i} own") for i in range(60, 90)] + [(None, "the same words in each of these")]
    found = simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter((i, 5 if i is None or i < 60 else i) for i, _ in data)


# Language model


def test_lm_base_and_counts(spark, folder, docs):
    found = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r for r in rows(spark, "op2_lm", folder)}
    split = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in docs]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, ws in split if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in split:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        r = next(r for (d, k, b), r in found.items() if d == i and k == len(ws) and abs(b - base) < 1e-4)
        assert (r.held_out, r.n_known, r.train_tokens) == (held(i), sum(c[w] > 0 for w in ws), n)
        assert r.score < 0 and math.isfinite(r.score)
    other = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in other) > sum(r.base_score for r in other)


def test_lm_rare_words_by_join(spark, folder, monkeypatch):
    whole = {(r.doc_id, r.n_tokens): r for r in rows(spark, "op2_lm", folder)}
    monkeypatch.setattr(lm, "TOP", lm.HEAD + 10)
    for r in rows(spark, "op2_lm", folder):
        o = whole[r.doc_id, r.n_tokens]
        assert r.n_known == o.n_known and r.base_score == pytest.approx(o.base_score) and r.score == pytest.approx(o.score, rel=1e-3)


def small_model():
    words = [lm.END, *[b"w%d" % i for i in range(4200)]]
    tails = np.array([0] + [lm.tail_class(w) for w in words[1:]])
    counts = np.arange(len(words), 0, -1)
    tail_tokens, tail_words = (np.bincount(tails[lm.HEAD :], x, lm.TAIL).astype(np.int64) for x in (counts[lm.HEAD :], None))
    return lm.Vocabulary(words, counts, tails, tail_tokens, tail_words, int(counts.sum()), len(words))


def test_lm_probabilities_add_up_to_one():
    v = small_model()
    w = lm.new_weights(v)
    state = np.random.default_rng(0).normal(0, 1, (1, lm.HIDDEN)).astype(np.float32)
    logs = lm.log_probs(w, np.repeat(state, lm.HEAD + lm.TAIL, axis=0), np.arange(lm.HEAD + lm.TAIL))
    assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-3)
    shares = (v.counts[lm.HEAD :] + 1) / 10 ** v.tail_norm[v.tails[lm.HEAD :]]
    for k in range(lm.TAIL):
        assert shares[v.tails[lm.HEAD :] == k].sum() + 1 / 10 ** v.tail_norm[k] == pytest.approx(1)


def test_lm_gradients():
    w = {k: a.astype(np.float64) for k, a in lm.new_weights(small_model()).items()}
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 4100, (5, 3)), rng.integers(0, 4100, (5, 3))
    h, keep = rng.normal(0, 0.5, (3, lm.HIDDEN)), np.ones((5, 3))
    keep[2, 1] = 0
    g, _, _ = lm.window_gradients(w, x, y, h, keep)
    for name, at in (("u", (3, 40)), ("u", (1, 90)), ("x", (x[1, 0], 5)), ("class", (4, 2)), ("word", (y[0, 0] // 64 % 64, 3, 7))):
        step = 1e-2
        w[name][at] += step
        up = lm.window_gradients(w, x, y, h, keep)[2]
        w[name][at] -= 2 * step
        down = lm.window_gradients(w, x, y, h, keep)[2]
        w[name][at] += step
        assert g[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_lm_state_is_carried_across_windows():
    w = lm.new_weights(small_model())
    rng = np.random.default_rng(5)
    texts = [np.append(rng.integers(1, 4100, n), 0).astype(np.int32) for n in (1, 23, 24, 25, 100, 700)]
    together = lm.score_texts(w, texts)
    for t, s in zip(texts, together):
        states, _ = lm.run_states(w, np.append(0, t[:-1])[:, None], np.zeros((1, lm.HIDDEN), np.float32))
        assert s == pytest.approx(float(lm.log_probs(w, states[:, 0], t).sum()), rel=1e-4)


def test_lm_stream_takes_every_token():
    w = lm.new_weights(small_model())
    rng = np.random.default_rng(6)
    texts = [np.append(rng.integers(1, 4100, n), 0).astype(np.int32) for n in (*rng.integers(0, 60, 400), 3000)]
    before = lm.score_texts(w, texts).sum()
    assert lm.train_stream(w, lm.Adam(w), iter(texts), 0.002) == sum(map(len, texts))
    assert lm.score_texts(w, texts).sum() > before


def test_lm_gradients_of_some_places():
    w = lm.new_weights(small_model())
    rng = np.random.default_rng(8)
    x, y = rng.integers(1, 4100, (5, 2)), rng.integers(1, 4100, (5, 2))
    h, keep, there = np.zeros((2, lm.HIDDEN), np.float32), np.ones((5, 2), np.float32), np.ones((5, 2), bool)
    there[2:, 1] = False
    both = lm.window_gradients(w, x, y, h, keep, there)[0]
    alone = [lm.window_gradients(w, x[:n, k : k + 1], y[:n, k : k + 1], h[:1], keep[:n, :1])[0] for n, k in ((5, 0), (2, 1))]
    assert all(np.allclose(both[k], (5 * alone[0][k] + 2 * alone[1][k]) / 7, atol=1e-5) for k in both)


def test_lm_windows_of_a_step_are_learned_from_together(monkeypatch):
    w = lm.new_weights(small_model())
    rng = np.random.default_rng(9)
    x, y = rng.integers(1, 4100, (60, 4)), rng.integers(1, 4100, (60, 4))
    together, last, _ = lm.window_gradients(w, x, y, np.zeros((4, lm.HIDDEN), np.float32), np.ones((60, 4), np.float32))
    h, summed = np.zeros((4, lm.HIDDEN), np.float32), {}
    for lo in range(0, 60, lm.WINDOW):
        at = slice(lo, lo + lm.WINDOW)
        g, h, _ = lm.window_gradients(w, x[at], y[at], h, np.ones(x[at].shape, np.float32))
        summed = {k: summed.get(k, 0) + a * (len(x[at]) / 60) for k, a in g.items()}
    assert np.allclose(last, h, atol=1e-5) and all(np.allclose(together[k], summed[k], atol=1e-5) for k in summed)

    calls, one = [], lm.window_gradients
    monkeypatch.setattr(lm, "window_gradients", lambda *a: calls.append(1) or one(*a))
    text = np.append(rng.integers(1, 4100, 40_000), 0).astype(np.int32)
    assert lm.train_stream(w, lm.Adam(w), iter([text]), 0.002) == len(text)
    assert len(calls) <= len(text) // lm.STEP_TOKENS + 2  # 1,667 passes over all weights before


def test_lm_words_by_arrow():
    texts = [b"", b" \t ", b"  A b\n\x0b\x0cc\x1cD \x00 e\r", "É à\u0085X The tHe".encode(), b"zq zq zqq A", b"\n"]
    words, bounds = lm._words(pa.array([b"not this", *texts], pa.binary())[1:])
    found = lm._as_binary(words).to_pylist()
    assert [found[a:b] for a, b in zip(bounds, bounds[1:])] == [t.lower().split() for t in texts]
    v = small_model()
    out = lm.encode_batch(lm.Lookup(zip([lm.END, b"a", b"the"], range(3))), v, pa.array(texts, pa.binary()))
    assert out["known"].tolist() == [1, 1, 2, 3, 2, 1]  # the end is known
    assert [dict(zip(a, b)) for a, b in zip(out["rare"].to_pylist(), out["rare_n"].to_pylist())] == [
        dict(Counter(x for x in t.lower().split() if x not in (b"a", b"the"))) for t in texts
    ]
    places = {b"a": 1, b"the": 2}
    assert [x.tolist() for x in out["ids"]] == [[places.get(x, lm.HEAD + lm.tail_class(x)) for x in t.lower().split()] + [0] for t in texts]


def test_lm_sums_by_id():
    rng = np.random.default_rng(10)
    x, rows = np.minimum(rng.zipf(1.3, 3000), 90).astype(np.int32), rng.normal(0, 1, (3, 3000, lm.HIDDEN)).astype(np.float32)
    want = np.zeros((100, 3, lm.HIDDEN))
    np.add.at(want, x, rows.transpose(1, 0, 2))
    assert np.allclose(lm._sums_by_id(x, rows, 100), want.reshape(100, -1), atol=1e-3)


def test_lm_learns_from_texts_beyond_the_sample(spark):
    text = " ".join(f"word{i % 37}" for i in range(12_000))
    assert len(text) > lm.SAMPLE_BYTES
    df = spark.createDataFrame([(i, text) for i in range(12)], "doc_id long, text string")
    v = lm.vocabulary(lm.word_counts(df.where("crc32(cast(string(doc_id) as binary)) % 7 <> 2").select(F.col("text").cast("binary").alias("text"))))
    untrained = lm.score_batch(lm.Lookup(zip(v.words, range(len(v.words)))), v, lm.new_weights(v), [text.encode()])["model"][0]
    assert all(r.score > untrained + 100 for r in lm.lm_scores(df).collect())


# Token files


def test_token_files(spark, folder, docs):
    from tokenizers import Tokenizer

    import public_tokenizers

    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, wanted = 0, []
    for i, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 2]
        wanted.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = sorted(rows(spark, "op3_token_ids", folder), key=lambda r: r.start)
    assert [tuple(r) for r in found] == wanted


@pytest.mark.parametrize("text", ["", "  a   b", "a\n b", "a\n \n b ", "x<|endoftext|> y", "it's  ok\r\n  z  q", " \t ", "a\x1c b", "é à  ü", "it's we'll don't' x've, end.\nNext a.b;c² d²e, <|endoftext|>x y<|z", "日本, ok... $$$ a%%%", "a\u3000 b\u00a0 c\u2003 d\u0085 e à ,f　 g"])
def test_encoder_cuts_like_the_library(text):
    import public_tokenizers

    tool = pfor.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for texts in ([text], ["", text, "x", text + text]):
        assert [x.tolist() for x in tool.encode([t.encode() for t in texts])] == [tool.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_chunks_are_cut_between_letters_and_digits(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(pfor, "LONG", 8)
    tool = pfor.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(tool, "table", pfor.IdTable(tool.search))
    for text in ("aB3" * 40, "it's2 x" + "can't9'll8<|endoftext|>7a" * 3, "é1à2ü3" * 9, "1234567890" * 4, "a" * 30):
        assert tool.encode([text.encode()])[0].tolist() == tool.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_take_whole_texts():
    import public_tokenizers

    tool = pfor.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Some Words  here", "", "it's 3rd"]
    assert not tool.cuts and [x.tolist() for x in tool.encode([t.encode() for t in texts])] == [tool.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("block", [8, 1 << 16])
def test_hashes_of_chunks_do_not_depend_on_place(monkeypatch, block):
    monkeypatch.setattr(chunks, "BLOCK", block)
    parts = [b"a", b" and", b"a", b"x" * 40, b" and", b"x" * 41, b"zz", b"a"]
    data, starts = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts[:-1])])
    for found in chunks.hashes(data, starts):
        assert len(set(found.tolist())) == len(set(parts)) and len(dict(zip(parts, found.tolist()))) == len(set(zip(parts, found.tolist())))


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 4000])
@pytest.mark.parametrize("most", [1, 2, 255, 1 << 16, (1 << 32) - 1])
def test_blocks_round_trip(n, most):
    ids = np.random.default_rng(n).integers(0, most, n, dtype=np.uint32)
    ids[::50] = most
    segment = pfor.Segment(pfor.write_segment([5, None], [ids[: n // 2], ids[n // 2 :]]))
    assert (segment.ids() == ids).all()
    assert (segment.ids(n // 3, n // 2) == ids[n // 3 : n // 2]).all()
    assert segment.docs["end"].tolist() == [n // 2, n] and segment.docs["there"].tolist() == [1, 0]


# Audio


def test_audio(spark, folder, docs):
    found = Counter(tuple(r) for r in rows(spark, "op4_audio", folder))
    for i, t in docs:
        raw = (t or "").encode()
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        media = audio.to_wav(raw)
        match = [r for r in found if r[:5] == (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))]
        assert match and match[0][5:7] == (len(media), hashlib.sha256(media).hexdigest())
    assert len({r[7] for r in found if r[0] == 900006}) == 2  # by text, of three rows


def test_resampling_is_the_direct_sum():
    x = np.random.default_rng(0).integers(0, 256, 500).astype(np.uint8)
    y = audio.resampled(x, 0, 300)
    assert np.allclose(y[100:200], audio.resampled(x, 100, 200), atol=1e-6)
    half = audio.TAPS * audio.UP // 2
    t = np.arange(-half, half)
    h = np.sinc(t / 8) * np.hamming(len(t)) * 5 / 8
    wave = (x.astype(float) - 128) / 128
    for m in (0, 7, 50, 123, 299):
        direct = sum(h[k] * wave[n] for n in range(500) if 0 <= (k := m * 8 + half - n * 5) < len(h))
        assert y[m] == pytest.approx(direct, abs=1e-4)


def brute_features(raw):
    """Log-mel patches and energy spans from the formulas, in double precision."""
    x = (np.frombuffer(raw + bytes(64 if not raw else -len(raw) % 64), np.uint8).astype(float) - 128) / 128
    total = max(1, -(-(len(x) * 5 // 8) // 128))
    patches = -(-total // 32)
    half = audio.TAPS * 5 // 2
    t = np.arange(-half, half)
    h = np.sinc(t / 8) * np.hamming(len(t)) * 5 / 8
    wave = np.zeros(patches * 32 * 128 + 256)
    up = np.zeros(len(x) * 5)
    up[::5] = x
    full = np.convolve(up, h)[half::8]
    n = min(len(full), len(wave))
    wave[:n] = full[:n]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 255)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(256)) / 256)
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    top = 2500.0
    edges = [700 * (10 ** (mel(top) * i / 17 / 2595) - 1) / top * 128 for i in range(18)]
    bands = np.array([[max(0, min((k - a) / (b - a), (c - k) / (c - b))) for a, b, c in zip(edges, edges[1:], edges[2:])] for k in range(129)])
    power = np.array([np.abs(turn @ (wave[i * 128 : i * 128 + 256] * window)) ** 2 for i in range(patches * 32)])
    energy, on, spans = np.log(power.sum(axis=1) + 1e-6)[:total], False, []
    high, low = energy.mean() + 0.5 * energy.std(), energy.mean() - 0.25 * energy.std()
    for i, e in enumerate([*energy, -math.inf]):
        if not on and e > high:
            on, since = True, i
        elif on and (e < low or i == total):
            on = False
            spans.append((since * 128 / 5000, i * 128 / 5000))
    return np.log(power @ bands + 1e-6).reshape(-1, 32, 16), spans


def test_stored_features(spark, folder, docs):
    stored = audio.store_features(audio.store_media(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")))
    back = {r.media_sha256: bytes(r.tensors) for r in stored.select("media_sha256", "tensors").collect()}
    feature = {r.media_sha256: r.feature for r in rows(spark, "op4_audio", folder)}
    some = sorted({t or "" for _, t in docs}, key=len)
    for text in [*some[:40], *some[60:-1:9]]:
        name = hashlib.sha256(audio.to_wav(text.encode())).hexdigest()
        tensors, times, spans = audio.from_tensor_ipc(back[name])
        wanted, marked = brute_features(text.encode())
        assert tensors.shape == wanted.shape and np.allclose(tensors, wanted, atol=0.05, rtol=0.01)
        assert np.allclose(times, [(i * 0.8192, (i + 1) * 0.8192) for i in range(len(tensors))])
        assert np.allclose(np.reshape(spans, (-1, 2)), np.reshape(marked, (-1, 2)), atol=1e-6)
        raw = tensors.astype("<f2").tobytes() + ";".join(f"{a:.6f}-{b:.6f}" for a, b in spans).encode()
        assert feature[name] == f"{len(tensors)}:{len(spans)}:{hashlib.sha256(raw).hexdigest()}"


def test_hysteresis_and_tensors():
    energy = np.array([0, 0, 5, 3, 3, 0, 3, 5, 5], float)
    assert audio.spans(energy, 1.0) == [(2.0, 5.0), (7.0, 9.0)]
    tensors, found = audio.features(np.frombuffer(audio.from_wav(audio.to_wav(b"abc" * 9000))[1], np.uint8))
    back = pa.ipc.open_stream(audio.tensor_ipc(tensors, found)).read_all()
    assert back.schema.field("mel").type.shape == [audio.PATCH, audio.MELS]
    assert (back["mel"].combine_chunks().to_numpy_ndarray() == tensors).all()


# Lines


def brute_lines(docs):
    sets = []
    for k, (i, t) in enumerate(docs):
        h = simhash._signed(xxhash.xxh64_intdigest(t.encode(), 42)) if t is not None else 42
        for n, line in enumerate((t or "").encode().lower().split(b"\n")):
            if w := line.split():
                shingles = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
                sets.append(((i is not None, i or 0, h, n), k, n, shingles))
    by_set = {}
    for at, _, _, s in sets:
        by_set[s] = min(at, by_set.get(s, at))
    gone = set()
    for at, k, n, s in sets:
        if any(o < at and 5 * min(len(s), len(r)) >= 4 * max(len(s), len(r)) and 5 * len(s & r) >= 4 * len(s | r) for r, o in by_set.items()):
            gone.add((k, n))
    return gone


def line_docs():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, 40)) for _ in range(12)]
    out = []
    for i in range(150):
        lines_ = []
        for _ in range(4):
            w = base[rng.integers(0, len(base))].split()
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(0, 40)] = f"x{rng.integers(0, 10**6)}"
            lines_.append(" ".join(w[: rng.integers(30, 41)]))
        out.append((i, "\n".join([*lines_, "short one", ""])))
    return out


@pytest.mark.parametrize("cap", [2, 1000])
def test_lines_any_list_length(spark, cap):
    data = line_docs()
    found = lines.similar_lines(spark.createDataFrame(data, "doc_id long, text string"), cap)
    assert {(r.doc_id, r.line) for r in found.collect()} == brute_lines(data)


def test_long_texts_come_in_parts(monkeypatch):
    texts = ["\n".join(f"line {i} of text {k} with some more words" for i in range(n)).encode() for k, n in enumerate((3, 0, 200, 5))]
    whole = [np.concatenate(x) for x in zip(*[lines.shingle_lines(d, o) for d, o, _, _ in lines._parts(pa.array(texts))])]
    monkeypatch.setattr(lines, "PART_BYTES", 300)
    monkeypatch.setattr(chunks, "BLOCK", 64)
    cut = [(rows_[of], at + first[of], n, s) for d, o, rows_, first in lines._parts(pa.array([b"", *texts]).slice(1)) for of, at, n, s in [lines.shingle_lines(d, o)]]
    assert all((a == np.concatenate(b)).all() for a, b in zip(whole, zip(*cut))) and len(cut) > 10


@pytest.mark.parametrize("texts", [["a b\nc d e f g h", "", "", "i j", "\n", "x\n", "\n\nZ  z\tq w e\n r"], [""], ["\n"], ["a"], [" ", "B c"]])
def test_shingles_of_lines(texts):
    raw = [t.encode() for t in texts]
    of, number, n, hashes = lines.shingle_lines(*lines._joined(raw))
    wanted = [(k, m, [w[j : j + 5] for j in range(max(1, len(w) - 4))]) for k, t in enumerate(texts) for m, x in enumerate(t.lower().split("\n")) if (w := x.split())]
    assert [(k, m, len(x)) for k, m, x in wanted] == list(zip(of.tolist(), number.tolist(), n.tolist()))
    alone = [lines.shingle_lines(*lines._joined([" ".join(s).encode()]))[3].tolist() for _, _, x in wanted for s in x]
    assert [h for x in alone for h in x] == hashes.tolist() and len(set(hashes.tolist())) == len({tuple(s) for _, _, x in wanted for s in x})


def test_lines_on_documents(spark, folder, docs):
    found = rows(spark, "op5_lines", folder)
    gone = brute_lines(docs)
    wanted = Counter((i, (t or "").count("\n") + 1, tuple(n for k, n in sorted(gone) if k == at)) for at, (i, t) in enumerate(docs))
    assert Counter((r.doc_id, r.n_lines, tuple(r.removed_lines)) for r in found) == wanted
    assert all(r.n_removed == len(r.removed_lines) for r in found) and any(len(docs[k][1].split("\n")[n].split()) < 5 for k, n in gone)


def test_short_lines_that_share_48_bits_of_a_hash(spark):
    """The first shingle hashes of these two lines agree in their upper 48 bits."""
    docs = [(1, "17716342\nend one"), (2, "18925140\nend two"), (3, "17716342\nEND one")]
    found = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {1: docs[0][1], 2: docs[1][1], 3: ""}


def test_sets_with_one_first_hash_differ_by_the_second(monkeypatch):
    texts = [b"a b", b"c d", b"A  b", b"one two three four five one two three four five", b"one two three four five one two three four five\t", b"longer-than-eight x longer-than-eight"]
    monkeypatch.setattr(lines, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    of, number, n, first, second = lines.shingle_lines(*lines._joined(texts), True)
    ids = {}
    for at, rows_, sizes, sums in lines.token_sets(n, first, second, lines.places_of(np.zeros(lines.SKETCH, np.int64))):
        ids |= dict(zip(of[at].tolist(), zip(*(x.tolist() for x in lines._set_ids(rows_, sizes, sums)))))
    assert ids[0] == ids[2] and ids[0][0] == ids[1][0] and ids[0][1] != ids[1][1]
    assert ids[3][1] == ids[4][1] and len({x[1] for x in ids.values()}) == 4


def test_second_hashes_count_a_shingle_once():
    rng = np.random.default_rng(5)
    words = [" ".join(f"w{k}" for k in rng.integers(0, 3, rng.integers(1, 60))) for _ in range(300)]
    raw = [w.encode() for w in words]
    of, _, n, first, second = lines.shingle_lines(*lines._joined(raw), True)
    sets = [{tuple(w.split()[j : j + 5]) for j in range(max(1, len(w.split()) - 4))} for w in words]
    ids = {}
    for at, rows_, sizes, sums in lines.token_sets(n, first, second, lines.places_of(np.zeros(lines.SKETCH, np.int64))):
        for k, m, pair in zip(of[at].tolist(), sizes.tolist(), zip(*(x.tolist() for x in lines._set_ids(rows_, sizes, sums)))):
            ids[k] = pair
            assert m == len(sets[k])
    by_set = {}
    for k, s in enumerate(sets):
        by_set.setdefault(frozenset(s), set()).add(ids[k])
    assert all(len(x) == 1 for x in by_set.values()) and len(set(ids.values())) == len(by_set) and len({a for a, _ in ids.values()}) == len({b for _, b in ids.values()})


def test_lines_of_a_long_document_go_in_linear_time(spark):
    import time

    text = "\n".join(["the same words in every line"] * 700_000 + ["and a last one of its own"])
    docs = spark.createDataFrame([(1, text), (2, "the same words in every line\nmore")], "doc_id long, text string")
    lines.dedup_lines(docs.where("doc_id = 2")).collect()
    began = time.perf_counter()
    found = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert time.perf_counter() - began < 20
    assert found == {1: "the same words in every line\nand a last one of its own", 2: "more"}


@pytest.mark.parametrize("buckets", [1, 64])
def test_lines_dealt_by_size(spark, monkeypatch, buckets):
    """Small buckets, a list dealt to many tasks, and lines that every part of the input has."""
    monkeypatch.setattr(lines, "BUCKET_BYTES", 1 << 20 if buckets == 1 else 1 << 12)
    monkeypatch.setattr(lines, "TASK_BYTES", 1 << 14)
    monkeypatch.setattr(lines, "SPREAD", 16)
    data = line_docs()
    found = lines.similar_lines(spark.createDataFrame(data, "doc_id long, text string").repartition(7), 4)
    assert {(r.doc_id, r.line) for r in found.collect()} == brute_lines(data)


def test_dedup_lines_keeps_rows_and_columns(spark, folder, docs):
    kept = lines.dedup_lines(spark.read.parquet(f"{folder}/documents.parquet").withColumn("_gone", F.lit(1)))
    found = kept.collect()
    assert len(found) == len(docs) and all(r["_gone"] == 1 and r.score == "x" for r in found)
    assert [r.text for r in found if r.doc_id == 900006 and r.text[0] == "t"] == ["the same words in a row again and again"] * 2
    gone = brute_lines(docs)
    wanted = Counter((i, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in gone)) for k, (i, t) in enumerate(docs))
    assert Counter((r.doc_id, r.text) for r in found) == wanted


# Pieces


def every_path(model, key):
    raw, marked = model.spaced(key)
    n = len(marked)

    def paths(end):
        if not end:
            yield 0.0, ()
        for start, score, ids in model.edges(raw, marked, end) if end else ():
            for s, p in paths(start):
                yield s + score, p + tuple(np.frombuffer(ids, "<u4").tolist())

    return sorted(paths(n), reverse=True)


@pytest.mark.parametrize("key", ["hello", "aaaaaa", "▁x", "", " two", "日本", "\x00"])
def test_n_best_of_a_chunk(key):
    model = pieces.Pieces(pieces.default_path())
    brute = every_path(model, key)
    found = model.n_best(key, 5)
    assert [s for s, _ in found] == pytest.approx([s for s, _ in brute[:5]])
    assert len({p for _, p in found}) == len(found)
    _, ids, best, loss = {x[0]: x for x in model.first_two([key, "hell", "▁y", "日", "\x00▁", "hello there"])}[key]
    assert tuple(np.frombuffer(ids, "<u4")) in {p for s, p in found if s == pytest.approx(best)}
    assert best == pytest.approx(brute[0][0]) and (len(brute) == 1 or loss == pytest.approx(brute[0][0] - brute[1][0]))


def test_n_best_of_a_long_chunk(monkeypatch):
    model, key = pieces.Pieces(pieces.default_path()), "the" * 200 + "日" + "ab" * 100
    wanted = model.encode([key.encode()])
    monkeypatch.setattr(pieces, "LONG", 50)
    again = pieces.Pieces(pieces.default_path()).encode([key.encode()])
    plain = lambda found: (found[0][0].tolist(), [(s, [(c, list(ids)) for c, ids in x]) for s, x in found[0][1]])
    assert plain(again) == plain(wanted) and len(wanted[0][1]) == 4


def test_n_best_of_a_text():
    model = pieces.Pieces(pieces.default_path())
    text = "ab cde ab"
    brute = [(sum(s for s, _ in p)) for p in __import__("itertools").product(*[every_path(model, k) for k in text.split(" ")])]
    ((ids, best),) = model.encode([text.encode()], 6)
    assert [s for s, _ in best] == pytest.approx(sorted(brute, reverse=True)[:6])


def test_kept_chunks_may_go(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_BITS", 7)
    model = pieces.Pieces(pieces.default_path())
    monkeypatch.setattr(pieces, "TABLE_BITS", 12)
    fresh = pieces.Pieces(pieces.default_path())
    plain = lambda found: [(x.tolist(), best) for x, best in found]
    for k in range(30):
        text = " ".join(f"word{i % 37} the {i * k}" for i in range(k, k + 12 + 60 * (k == 20))).encode()
        assert plain(model.encode([text, b"", text[::-1], b"  a "])) == plain(fresh.encode([text, b"", text[::-1], b"  a "]))
        fresh.table.clear()


def test_pieces_round_trip(spark, folder, docs):
    found = rows(spark, "op6_pieces", folder)
    assert len(found) == len(docs) and all(r.round_trip for r in found)
    path = pieces.default_path()
    encoded = pieces.encode_pieces(spark.read.parquet(f"{folder}/documents.parquet"), path).select("text", "ids")
    assert all(r.decoded == (r.text or "") for r in pieces.decode_pieces(encoded, path).collect())
    assert all(list(r.nbest_scores) == sorted(r.nbest_scores, reverse=True) for r in found)


# Secrets


def base_spans(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_secrets(spark, folder, docs):
    found = Counter(tuple(r)[:5] for r in rows(spark, "op7_secrets", folder))
    wanted = Counter()
    for i, t in docs:
        s = base_spans(t or "")
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in s)
        wanted[i, *[sum(k == x for _, x, _ in s) for k in range(3)], hashlib.sha256(text.encode()).hexdigest()] += 1
    assert found == wanted


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


KEY = der(0x30, der(0x02, b"\0") + der(0x30, der(0x06, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + der(0x05, b"")) + der(0x04, der(0x30, der(0x02, bytes(range(1, 200))))))
URL64 = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
JWT = f"{URL64(json.dumps({'alg': 'HS256'}).encode())}.{URL64(json.dumps({'sub': 1}).encode())}.{URL64(b'x' * 32)}"
SSH = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(32)))


@pytest.mark.parametrize(
    ("kind", "token"),
    [("jwt", JWT), ("der", base64.b64encode(KEY).decode()), ("der", KEY.hex()), ("der", base64.b64encode(KEY.hex().encode()).decode()), ("ssh", base64.b64encode(SSH).decode()), ("ssh", base64.b64encode(b"openssh-key-v1\0" + bytes(40)).decode())],
)
def test_structures_are_confirmed(kind, token):
    text = f"é before {token} after"
    assert (9, secrets.KINDS.index(kind), 9 + len(token)) in secrets.structural_spans(text)


def test_wrapped_key():
    body = base64.encodebytes(KEY * 1).decode()
    wrapped = "\n".join(base64.b64encode(KEY).decode()[i : i + 64] for i in range(0, len(base64.b64encode(KEY)), 64))
    assert [k for _, k, _ in secrets.structural_spans(f"-----BEGIN PRIVATE KEY-----\n{wrapped}\n-----END PRIVATE KEY-----")] == [4]
    assert body


@pytest.mark.parametrize("more", range(48))
@pytest.mark.parametrize("after", ["\n-----END PRIVATE KEY-----", "\nof it\n"])
def test_wrapped_keys_of_any_length(more, after):
    key = der(0x30, der(0x02, b"\0") + der(0x04, bytes(range(140 + more))))
    body = base64.b64encode(key).decode()
    wrapped = "\n".join(body[i : i + 64] for i in range(0, len(body), 64))
    assert secrets.structural_spans(f"here\n{wrapped}{after}") == [(5, secrets.KINDS.index("der"), 5 + len(wrapped))]


@pytest.mark.parametrize("before", ["session_token.", "a.session_token.", "one.session_token.two_segments."])
def test_jwt_after_other_segments(before):
    assert (len(before), secrets.KINDS.index("jwt"), len(before) + len(JWT)) in secrets.structural_spans(f"{before}{JWT} {JWT}")
    assert len(secrets.structural_spans(f"{before}{JWT} {JWT}")) == 2


@pytest.mark.parametrize("token", [base64.b64encode(KEY[:-3]).decode(), base64.b64encode(bytes(range(60))).decode(), "ab" * 40, "a.b.c", "x" * 80, "eyJhbGciOiJI.eyJ.x"])
def test_no_structure_no_report(token):
    assert secrets.structural_spans(f"see {token} here") == []


# Decontamination


def brute_hits(text, items):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = norm(text), set(), set()
    places = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    for item, t in items:
        bw = norm(t)
        size = min(13, len(bw))
        for j in range(len(bw) - size + 1 if bw else 0):
            for at in places.get(bw[j], ()):
                if words[at : at + size] == bw[j : j + size]:
                    hit.update(range(at, at + size))
                    found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block", [1, decontaminate.BLOCK_WINDOWS])
def test_decontamination(spark, folder, docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist()]
    found = Counter(tuple(r) for r in rows(spark, "op8_decontaminate", folder))
    assert found == Counter((i, *brute_hits(t, items)) for i, t in docs)
    assert any(r[5] for r in found)


def test_blocks_hold_all_windows(spark, monkeypatch):
    """A long item in pieces, and what a block takes: tasks hold one, the driver builds one at a time."""
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 50)
    long = [b"w%d" % (i % 400) for i in range(700)]
    items = [(1, b" ".join(long).decode()), (2, "a b c"), (None, None), (3, " ".join(f"v{i}" for i in range(62)))]
    blocks = list(decontaminate._blocks(spark.createDataFrame(items, "item_id long, text string"), 13))
    assert max(sum(len(x) for x in b.windows.values()) for b in blocks) <= 50 and len(blocks) > 10
    held = lambda b, size: {tuple(names[i] for i in w) for names in [{v: k for k, v in b.vocabulary.items()}] for x in b.windows.get(size, {}).values() for w, _ in x}
    assert set().union(*(held(b, 13) for b in blocks)) >= {tuple(long[i : i + 13]) for i in range(688)}
    docs = [(1, " ".join(f"w{i % 400}" for i in range(90, 300)), "x"), (2, "A b, c", "y"), (2, "A b, c", "y"), (3, None, "z"), (4, " ".join(f"v{i}" for i in range(30, 50)) + " other" * 500, "u")]
    found = decontaminate.benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string, _check string"), spark.createDataFrame(items, "item_id long, text string"))
    got = Counter((r.doc_id, r["_check"], r.n_words, len(r.hit_words), tuple(r.hit_items)) for r in found.collect())
    assert got == {(1, "x", 210, 210, (1,)): 1, (2, "y", 3, 3, (2,)): 2, (3, "z", 0, 0, ()): 1, (4, "u", 520, 20, (3,)): 1}


def test_empty_benchmark(spark, folder, tmp_path):
    for name in ("documents", "benchmark"):
        t = pq.read_table(f"{folder}/{name}.parquet")
        pq.write_table(t if name == "documents" else t.slice(0, 0), tmp_path / f"{name}.parquet")
    found = rows(spark, "op8_decontaminate", str(tmp_path))
    assert len(found) == pq.read_metadata(f"{folder}/documents.parquet").num_rows and not any(r.contaminated or r.n_hit for r in found)


def test_short_items_and_spans(spark):
    docs = spark.createDataFrame([(1, "Say Hello, World! to me", 5), (2, "hello", 6), (3, None, 7)], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(1, "hello world"), (2, "..."), (None, "to me"), (4, None)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [2, 3]
    cut = {r.doc_id: (r.text, r.n_words) for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert cut == {1: ("Say , !  ", 5), 2: ("hello", 6), 3: (None, 7)}


# Chat


def test_chat_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    wanted = Counter(con.sql(chat.SQL).fetchall())
    assert Counter(tuple(r) for r in rows(spark, "op9_chat", SF)) == wanted


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a</turn>\n### assistant: b\\s<sep/>"), (1, 1, "user", ""), (1, 2, "assistant", "x\\"), (1, 2, "assistant", "y: #"), (1, 3, "a:b\\c", None), (None, None, None, "n"), (2, 1, "assistant", None)]
    back = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    found = {r.conv_id: r for r in back.select("conv_id", "formatted", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [tuple(t) for t in found[1].turns] == [(r, t or "") for _, _, r, t in turns[:5]]
    assert (found[1].loss, found[2].loss) == ("x\\y: #", "")
    assert [tuple(t) for t in found[None].turns] == [("", "n")] and [tuple(t) for t in found[2].turns] == [("assistant", "")]


# Language


def test_language(spark, folder, docs):
    found = rows(spark, "op10_language", "/root/testdata/sf0.01")
    truth = {r["doc_id"]: r["lang"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    odd = {r.doc_id: r for r in rows(spark, "op10_language", folder) if r.doc_id and r.doc_id > 900000}
    assert [odd[i].lang_pred for i in (900001, 900002, 900003)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in found)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    texts = sorted([rng.normal(0, 5, (n, 3)).astype(np.float32) for n in (6, 5, 1, 6)], key=len, reverse=True)
    for s, path in zip(texts, language.viterbi(texts)):
        value = lambda p, s=s: sum(s[t, p[t]] for t in range(len(s))) - language.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
        best = max(value(p) for p in __import__("itertools").product(range(3), repeat=len(s)))
        assert value(path.tolist()) == pytest.approx(best, rel=1e-5)


def test_spans_of_mixed_text(spark):
    english, german = "the that with from have this which", "und nicht auch werden haben eine schon"
    rows_ = [(f"{english} {i}", "en") for i in range(20)] + [(f"{german} {i}", "de") for i in range(20)]
    model = language.train(spark.createDataFrame(rows_, "text string, lang string"))
    docs = spark.createDataFrame([(f"{english} {german} {german}",), ("Привет мир",)], "text string")
    first, second = language.identify(docs, model).collect()
    assert [s.lang for s in first.spans] == ["en", "de"] and first.lang_pred == "de" and 0.5 < first.score < 1
    assert second.lang_pred in ("de", "en")


def brute_word_scores(counts, totals, scripts, word):
    grams = [f"^{word}$"[i : i + 3] for i in range(len(word))]
    fit = {x for x in totals if scripts[x].get(language.script_of(word), 0) > language.SCRIPT_SHARE * sum(scripts[x].values())}
    all_ = {x: sum(math.log((counts[x][g] + 1) / (totals[x] + language.KEPT)) for g in grams) for x in totals}
    least = min(all_.values()) - 10
    found = {x: all_[x] if x in fit else least for x in totals}
    return {x: s - max(found.values()) if fit else 0 for x, s in found.items()}


@pytest.mark.parametrize("grams", [language.GRAMS, 5])
def test_word_scores(spark, monkeypatch, grams):
    monkeypatch.setattr(language, "GRAMS", grams)
    data = [("The cat's hat, the bat", "en"), ("die Katze und der Hut", "de"), ("кот и шляпа", "ru"), ("that was then", "en")]
    model = language.train(spark.createDataFrame(data, "text string, lang string"))
    counts, scripts = {x: Counter() for x in ("de", "en", "ru")}, {x: Counter() for x in ("de", "en", "ru")}
    for t, lang in data:
        for token in t.lower().split():
            w = "".join(c for c in token if c.isalpha())
            scripts[lang][language.script_of(w)] += len(w)
            counts[lang].update(f"^{w}$"[i : i + 3] for i in range(len(w)))
    totals = {x: sum(c.values()) for x, c in counts.items()}
    words = ["the", "katze", "кот", "zzz", "日本", "thatthecat" * 50]
    found, blind = model.word_scores(words)
    assert blind.tolist() == [False, False, False, False, True, False]
    for w, s in zip(words, found):
        assert s.tolist() == pytest.approx([brute_word_scores(counts, totals, scripts, w)[x] for x in model.langs])


def test_rare_trigrams_share_buckets(spark, monkeypatch):
    monkeypatch.setattr(language, "KEPT", 3)
    model = language.train(spark.createDataFrame([("aa aa aa ab xy", "en"), ("qq", "de")], "text string, lang string"))
    en = model.langs.index("en")
    floor = -math.log(10 + 3)
    assert model.tail and model.grams[model._rows("^aa$", 0, 2), en].tolist() == pytest.approx([math.log(4) + floor] * 2)
    # of ab and xy one trigram is kept, each other one has the mean of its bucket, 1
    assert model.grams[model._rows("^ab$", 0, 2) + model._rows("^xy$", 0, 2), en].tolist() == pytest.approx([math.log(2) + floor] * 4)


def test_long_texts_have_the_best_path(spark, monkeypatch):
    rng = np.random.default_rng(9)
    model = language.train(spark.createDataFrame([("the that with from have", "en"), ("und nicht auch werden", "de"), ("avec dans pour une", "fr")], "text string, lang string"))
    words = "the that und auch avec une 12 日本 from werden pour".split()
    text = " ".join(words[(i // 40 + rng.integers(0, 3)) % len(words)] for i in range(5000))
    ((whole, sizes, blind),) = model.label([text])
    monkeypatch.setattr(language, "LONG", 1500)
    monkeypatch.setattr(language, "SEGMENT", 16)
    ((path, again, unseen),) = model.label([text])
    assert (again == sizes).all() and unseen == blind > 0
    (ids,) = model.ids([text])
    value = lambda p: float(model.scores[ids, p].astype(float).sum()) - language.SWITCH * (np.diff(p) != 0).sum()
    assert value(path) == pytest.approx(value(whole), rel=1e-6)


def test_letters_without_a_language(spark):
    model = language.train(spark.createDataFrame([("the that with", "en"), ("und nicht auch", "de"), ("avec dans pour", "fr")], "text string, lang string"))
    docs = spark.createDataFrame([("the that with und nicht auch avec dans pour", 1), ("Другой язык без примеров", 2), ("123", 3), (None, 4)], "text string, explained int")
    assert [r.explained for r in language.keep_identified(docs, model).collect()] == [1]


# Long texts: an unbroken run, a single line, and many words


def peak_of(script):
    import subprocess
    import sys

    code = f"import sys, time, resource\nsys.path.insert(0, {os.getcwd()!r})\n{script}\nprint(time.perf_counter() - began, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) / 1024)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert not out.returncode, out.stderr
    return map(float, out.stdout.split()[-2:])


TEXTS = {"run": "'aB3' * 1_700_000", "line": "' '.join(f'word{i % 9973}' for i in range(700_000))", "words": "'\\n'.join(' '.join(f'w{i % 977}' for i in range(k, k + 20)) for k in range(100_000))"}
TOOLS = {
    "secrets": "from tessera.llm import secrets; f = lambda: (secrets.base_spans(text), secrets.structural_spans(text))",
    "lines": "import numpy as np; from tessera.llm import lines; f = lambda: [lines._postings((raw, np.array([0, len(raw)]), np.array([0]), np.array([0])), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(lines.SKETCH, np.uint64), 8)]",
    "language": "from tessera.llm import language as l; m = l.Model([(x, '!latin', 9, 99) for x in 'abcd'] + [(x, g, 3, 99) for x, g in zip('abcd', ('^wo', 'ord', 'aB3', 'w1$'))]); f = lambda: m.label([text])",
    "tokens": "import public_tokenizers; from tessera.llm import pfor; e = pfor.encoder(public_tokenizers.path('byte_bpe_50k.json')); f = lambda: e.encode([text.encode()])",
    "pieces": "from tessera.llm import pieces; m = pieces.Pieces(pieces.default_path()); f = lambda: m.encode([text.encode()])",
    "simhash": "from tessera.llm import simhash; f = lambda: simhash.fingerprint(text.encode())",
    "decontaminate": "from tessera.llm import decontaminate as d; b = d.Block([(1, b'word1 word2 word3 word4 word5')]); f = lambda: b.hits(d.words(text.encode()))",
}


@pytest.mark.parametrize("kind", TEXTS)
@pytest.mark.parametrize("tool", TOOLS)
def test_very_long_texts(kind, tool):
    seconds, mb = peak_of(f"import numpy as np\ntext = {TEXTS[kind]}\nraw = np.frombuffer(text.encode(), np.uint8)\n{TOOLS[tool]}\nbase = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nbegan = time.perf_counter()\nf()")
    assert seconds < (25 if tool == "pieces" else 10) and mb < 500  # its lattice is walked character by character


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(lm.train_rounds, "__defaults__", (20_000,))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = [{r.doc_id: r.score for r in lm.lm_scores(docs.repartition(n)).collect()} for n in (1, 7)]
    assert found[0] == pytest.approx(found[1], rel=1e-6)


def test_a_long_conversation(spark):
    import time

    rows = [(1, k, "user" if k % 5 else "assistant", f"text {k} # <") for k in range(20_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chat.format_chats(turns.limit(10)).collect()
    began = time.perf_counter()
    (r,) = chat.format_chats(turns).select("formatted", chat.loss_text(F.col("segments")).alias("loss"), F.size(chat.parse_turns(F.col("formatted"))).alias("n")).collect()
    assert time.perf_counter() - began < 30
    assert r.n == 20_000 and r.loss == "".join(f"text {k} # <" for k in range(0, 20_000, 5))


# Pipeline


def test_pipeline(spark, folder, docs):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, folder).collect()
    model = language.train_on_folds(spark.read.parquet(f"{folder}/documents.parquet"))
    passed = language.keep_identified(spark.read.parquet(f"{folder}/documents.parquet"), model)
    rest = [(r.doc_id, r.text) for r in passed.collect()]
    assert not {900001, 900002, 900003, 900008} & {i for i, _ in rest} and {None, 900005, 900006} <= {i for i, _ in rest}
    gone = brute_lines(rest)
    rest = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in gone)) for k, (i, t) in enumerate(rest)]
    fps = [(i, brute_fingerprint(t)) for i, t in rest]
    root = brute_components(sorted({f for _, f in fps}), lambda a, b: (a ^ b).bit_count() <= 3)
    least, chosen = {}, {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    for (i, t), (_, f) in zip(rest, fps):
        if i is not None and least[root[f]] == i:
            chosen[root[f]] = min((simhash._signed(xxhash.xxh64_intdigest(t.encode(), 42)), i, t), chosen.get(root[f], (1 << 63, 0, "")))
    rest = [(i, t) for _, i, t in chosen.values()] + [(i, t) for i, t in rest if i is None]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist()]
    assert Counter((r.doc_id, r.text) for r in found) == Counter((i, t) for i, t in rest if not brute_hits(t, items)[4])
    assert all(len(r.ids) == 4 * r.n_tokens for r in found)


def test_pipeline_of_empty_tables(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0
