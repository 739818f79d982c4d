"""Filter audit, hard negatives and WARC archives: brute force over odd rows, SQL over a whole table."""

import base64
import gzip
import hashlib
import io
import os
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import audit, negatives, warc
from tessera.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_audit", "op12_negatives", "op13_warc"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries()[name](spark, SF)
    wanted = con.sql(oracle_sql()[name])
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR"}
    assert {c: kinds[t] for c, t in found.dtypes} == dict(zip(wanted.columns, map(str, wanted.types)))
    assert Counter(map(tuple, found.select(*wanted.columns).collect())) == Counter(wanted.fetchall())


# Filter audit

WORDY = " ".join(f"w{i}" for i in range(150))
ODD_DOCS = [
    (None, WORDY, "en"),
    (None, WORDY, None),
    (None, None, ""),
    (1, None, "en"),
    (2, "", None),
    (3, "A B\x0bC\tD e#f", "en"),
    (4, WORDY, "de"),
    (5, WORDY, "en"),
    (5, WORDY, "en"),  # a repeated row
    (6, "same " * 120, "de"),
    (6, "another text of one id", ""),
    (7, "é" * 99 + "   日本 \U0001f600 " + "Ab " * 101, "fr"),
    (8, "x" * 700_000 + " y " + "Z" * 300 + " " + "Z" * 300 + " " + "Z" * 299, "fr"),
    (9, " ".join(f"Word{i % 500}" for i in range(200_000)), "fr"),
    (10, "&", None),
]
ODD_LABELS = [(4, 1, 0), (4, 0, 1), (5, 1, None), (6, None, 1), (7, None, None), (None, 1, 1), (99, 1, 1)]


def brute_audit(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t]]
        fails.append((i, lang or "", {x for x, f in zip("ABCDE", tests) if f}))
    out = {}
    for part in {p for _, p, _ in fails}:
        own = [(i, f) for i, p, f in fails if p == part]
        removed_in = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                here = [(i, f) for i, f in left if x in f]
                gone_before = len([1 for _, f in own if x in f]) - len(here)
                left = [(i, f) for i, f in left if x not in f]
                removed_in[x] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), gone_before, sum(f == {x} for _, f in own), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)]
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                out[part, "".join(order), step].append(removed_in[x])
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark, tmp_path):
    docs = spark.createDataFrame([(*d, "x", "y", 3) for d in ODD_DOCS], "doc_id long, text string, lang string, mask string, n_words string, n int")
    labels = spark.createDataFrame([(*x, 1) for x in ODD_LABELS], "doc_id long, quality int, toxic int, good int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in queries()["op11_audit"](spark, str(tmp_path)).collect()}
    assert found == brute_audit(ODD_DOCS, ODD_LABELS)


def test_audit_counts_in_parts_and_with_colliding_hashes(monkeypatch):
    texts = [t or "" for _, t, _ in ODD_DOCS] + ["a b a c abcdefgh abcdefghi abcdefgh " + "q" * 300 + " " + "q" * 300]
    wanted = [(len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall("[#$%&*|]", t))) for t in texts for w in [re.findall(r"[^\x20\x09-\x0D]+", t)]]
    column = pa.array(["skipped", *texts]).slice(1)
    for size in (1, 1000, 1 << 22):
        monkeypatch.setattr(audit, "PART_BYTES", size)
        batches = list(audit._scan(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), column], ["k", "_text"])])))
        table = pa.Table.from_batches(batches)
        assert list(zip(*(table[c].to_pylist() for c in audit.COUNTS))) == wanted and table["k"].to_pylist() == [*range(len(texts))]
        assert table["digest"].to_pylist() == [hashlib.sha256(t.encode()).digest() for t in texts]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    monkeypatch.setattr(audit.distinct_words, "__defaults__", (lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(7),))
    assert audit.counts_of(data, offsets)["n_distinct"].tolist() == [w[1] for w in wanted]


# Hard negatives


def brute_mined(rows, positives=5, negatives=10):
    """rows: (id, label, vector), those that take part."""
    kept = {(i, label, tuple(np.trim_zeros([int(np.floor(256 * x)) for x in v], "b"))) for i, label, v in rows if None not in (i, label, v) and None not in v and np.isfinite(np.array(v, float)).all()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = Counter()
    for i, label, v in kept:
        if i % 100:
            continue
        own = sorted((-dot(v, w), j) for j, m, w in kept if m == label and j != i)[:positives]
        other = sorted((-dot(v, w), j) for j, m, w in kept if m != label)
        for p, j in own:
            fits = [(s, k) for s, k in other if 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out.update((i, j, r, k, -p, -s) for r, (s, k) in enumerate(fits, 1))
    return out


def vectors(n, labels, dims=5, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(0, labels)), rng.normal(size=dims).round(1).tolist()) for i in rng.permutation(n)]
    rows += [(None, 1, [1.0] * dims), (100, None, [1.0] * dims), (200, 1, None), (300, 1, [1.0, None]), (301, 1, [1.0, float("nan")]), (302, 1, [float("inf")])]
    rows += rows[:40] + [(900, 1, []), (1000, 2, [0.5]), (1001, 2, [0.5, 0.25]), (100, 1, [0.7] * dims), (-100, 1, [0.3] * dims), (1 << 40, 1, [1.5] * (dims + 4))]
    return rows


@pytest.mark.parametrize(("labels", "sizes"), [(3, {}), (200, {"anchor_block": 2, "row_block": 30, "least_chunk": 2}), (1, {}), (3, {"positives": 2, "negatives": 3, "row_block": 100, "least_chunk": 1})])
def test_negatives(spark, labels, sizes):
    rows = vectors(900, labels)
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, label int, vector array<double>, score int").repartition(5)
    found = negatives.mine_negatives(df, **sizes).collect()
    wanted = brute_mined(rows, sizes.get("positives", 5), sizes.get("negatives", 10))
    assert Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found) == wanted and (wanted or labels == 1)


def test_negatives_query(spark, tmp_path):
    rows = vectors(500, 10)
    spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, rank string").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries()["op12_negatives"](spark, str(tmp_path)).collect()
    moved = [(i, (m + 1) % 10 if i is not None and m is not None and i % 7 == 0 else m, v and [x if x is None else float(np.float32(x)) for x in v]) for i, m, v in rows]
    assert Counter(map(tuple, found)) == brute_mined(moved)


def test_scores_of_large_components(spark):
    big = [(100 * k, k % 2, [float(2 ** (15 + k)), 3.0]) for k in range(4)]
    df = spark.createDataFrame(big, "id long, label int, vector array<double>")
    assert Counter(map(tuple, negatives.mine_negatives(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == brute_mined(big)
    with pytest.raises(OverflowError):
        negatives.mine_negatives(spark.createDataFrame([(100, 1, [1e30])], "id long, label int, vector array<double>"))


# WARC

PAGES = [
    (1, "http://a.example/ x\r\ny", "<p>one</p>"),
    (2, None, None),
    (3, "http://é.example/%20", ""),
    (4, "http://a.example/", "<p>one</p>"),
    (None, "http://b.example/", "<p>one</p>"),
    (None, None, "no id"),
    (None, None, "no id"),
    (5, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\x1f\x00 é 日本"),
    (6, "u", "".join(chr(33 + (i * i) % 90) for i in range(700_000))),
    (7, "v", "twice"),
    (7, "v", "twice"),
    (8, "w", "twice"),
]


def brute_pages(pages):
    least = {}
    for i, _, h in pages:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    out = Counter()
    for i, _, h in pages:
        raw, first = (h or "").encode(), least.get(h or "")
        again = first is not None and (i is None or i > first)
        out[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None] += 1
    return out


@pytest.mark.parametrize("hot", [1, 1024])
def test_warc(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT_SHARE", hot)
    rows = PAGES + [(100 + k, "c", "common") for k in range(60)]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, key int, refers_to string").write.parquet(f"{tmp_path}/pages.parquet")
    for split in (100, 5000, 1 << 23):
        found = warc.op13_warc(spark, str(tmp_path), split).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == brute_pages(rows)


def test_archives_are_gzip_and_hold_the_texts(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    files = warc.write_pages(warc.with_revisits(pages, min_bytes=7), file_bytes=300)
    assert files.count() > 3
    held = []
    for f in files.collect():
        raw = open(f.path.removeprefix("file://"), "rb").read()
        assert len(raw) == f.bytes and gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type") >= f.records
        at = 0
        while at < len(raw):
            part = zlib.decompressobj(31)
            part.decompress(raw[at:])
            held.append((f.path, at, len(raw) - at - len(part.unused_data)))
            at = len(raw) - len(part.unused_data)
    found = warc.read_archives(files, 64).collect()
    assert sorted((r.path, r.offset, r["length"]) for r in found) == sorted(held) and {r.error for r in found} == {None}
    texts = Counter((r.record_id.split(":")[2], bytes(r.payload).decode()) for r in found if r.record_type == "response")
    first = {"<p>one</p>": 1}
    assert texts == Counter((str(i if i is not None else ""), h or "") for i, _, h in PAGES if len((h or "").encode()) < 7 or first.get(h, i) == i)
    assert {r.target_uri for r in found} >= {"http://a.example/%20x%0D%0Ay", "http://é.example/%20", None}


def test_foreign_archives(spark, tmp_path):
    """Members of another writer: header names and comments, a record in a record, broken data, uncompressed members, no extra field."""
    record = lambda k, body, kind="resource": warc.record([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{k}>")], body)

    def packed(data, level=6, name=None):
        out = io.BytesIO()
        with gzip.GzipFile(name or "", "wb", level, out) as f:
            f.write(data)
        return out.getvalue()

    inner = packed(record("inner", b"inside"))
    whole = [packed(record(1, b"one")), packed(record(2, os.urandom(3000)), 0, "a name"), packed(record(3, b"x" + inner + b"y" * 50), 0), packed(b"no record"), packed(record(4, b"last", "conversion"))]
    broken = bytearray(packed(record(5, b"broken " * 400)))
    broken[-5] ^= 1
    data = b"".join([*whole[:4], bytes(broken), whole[4], b"\0" * 20])
    path = tmp_path / "foreign.warc.gz"
    path.write_bytes(data)
    files = spark.createDataFrame([(f"file://{path}", len(data))], "path string, bytes long")
    for split in (50, 1000, 1 << 20):
        found = sorted(warc.read_archives(files, split).collect(), key=lambda r: r.offset)
        assert [(r.record_id, r.error) for r in found] == [("<urn:1>", None), ("<urn:2>", None), ("<urn:3>", None), ("<urn:5>", "broken data"), ("<urn:4>", None)]
        assert bytes(found[2].payload) == b"x" + inner + b"y" * 50 and found[4].record_type == "conversion"


def test_magic_across_reads(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 7)
    data = b"abc" * 5 + warc.MAGIC + b"d" * 4 + warc.MAGIC
    f = warc._File(pa.BufferReader(data))
    assert [f.find(0, len(data)), f.find(16, len(data)), f.find(0, 15), f.find(0, 16), f.find(23, 99)] == [15, 22, -1, 15, -1]


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_pages(warc.with_revisits(pages))).count() == 0
    assert negatives.mine_negatives(spark.createDataFrame([], "id long, label int, vector array<float>")).count() == 0
    docs, labels = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.masked(docs, labels)).agg(F.count("*"), F.sum("removed")).first()[0] == 600


def test_parts_come_from_any_column(spark):
    docs = spark.createDataFrame([(1, "a", 5), (2, "b", 7)], "doc_id long, text string, source int")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    found = defaultdict(int)
    for r in audit.masked(docs, labels, "source").collect():
        found[r.part] += r.good
    assert found == {"5": 1, "7": 0}
