"""Queries without SQL against plain Python versions over the whole tables."""

import math
import re
from collections import defaultdict

import duckdb
import pytest

from tessera import catalog
from tessera.functions import rewards as RW
from tessera.plans.queries import POINTS_SQL, TAGS_SQL

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return c


@pytest.fixture(scope="module")
def frames(con):
    out = defaultdict(lambda: {"click": [], "view": [], "purchase": []})
    for source, user, day, label, x, y in con.sql(f"WITH {POINTS_SQL} SELECT source, user_id, day, label, x, y FROM points ORDER BY ord").fetchall():
        of = out[user, day]
        if source in of:
            of[source].append((x, y, label, 0.95))
    return out


def greedy(left, right, reach):
    used, out = set(), []
    for i, p in enumerate(left):
        best = None
        for j, q in enumerate(right):
            d = math.dist(p[:2], q[:2])
            if j not in used and d < reach and (best is None or d < best[0]):
                best = (d, j)
        if best:
            used.add(best[1])
            out.append((i, best[1], min(1.0, 1 - best[0] / reach + 0.2 * (p[2].lower() == right[best[1]][2].lower()))))
    return out


def test_greedy_match(spark, frames):
    found = {(r.user_id, r.day, r.place): (r.l, r.r, r.score) for r in catalog.queries()["greedy_match"](spark, SF).collect()}
    wanted = {(u, d, k): p for (u, d), f in frames.items() for k, p in enumerate(greedy(f["click"], f["view"], 20.0))}
    assert found.keys() == wanted.keys() and wanted
    assert all(found[k][:2] == p[:2] and found[k][2] == pytest.approx(p[2], abs=1e-6) for k, p in wanted.items())


def test_consensus(spark, frames):
    found = {(r.user_id, r.day): (r.n_pairs, r.needs_tiebreak, r.n_points, r.method) for r in catalog.queries()["consensus"](spark, SF).collect()}
    wanted = {}
    for key, f in frames.items():
        left, right, third = f["click"], f["view"], f["purchase"]
        pairs, points, method = greedy(left, right, 20.0), [], "unanimous"
        for i, j, score in pairs:
            x, y = (left[i][0] + right[j][0]) / 2, (left[i][1] + right[j][1]) / 2
            if score >= 0.8:
                points.append((x, y, left[i][2], score))
            elif left[i][2].lower() != right[j][2].lower():
                near = [t for t in third if math.dist(t[:2], (x, y)) < 20.0]
                if near:
                    points.append(near[0])
                    method = "tiebreaker"
        for p in left + right:
            if p[3] > 0.9 and all(math.dist(p[:2], q[:2]) >= 20.0 for q in points):
                points.append(p)
        wanted[key] = (len(pairs), any(s < 0.8 for _, _, s in pairs), len(points), method)
    assert found == wanted and {m for *_, m in wanted.values()} == {"unanimous", "tiebreaker"}


def test_nms_dedup(spark, con):
    groups = defaultdict(list)
    for user, label, ord_, x, y, value in con.sql(f"WITH {POINTS_SQL} SELECT user_id, label, ord, x, y, value FROM points").fetchall():
        groups[user, label].append((-value / 100, ord_, x, y))
    wanted = set()
    for key, points in groups.items():
        last = None
        for c, ord_, x, y in sorted(points):
            if -c >= 0.1 and (last is None or math.dist(last, (x, y)) >= 10.0):
                last = (x, y)
                wanted.add((*key, ord_))
    assert {tuple(r) for r in catalog.queries()["nms_dedup"](spark, SF).collect()} == wanted


def test_rewards(spark, con):
    found = {r.ord: r for r in catalog.queries()["rewards"](spark, SF).collect()}
    for ord_, source, x, y, tag, label in con.sql(f"WITH {TAGS_SQL} SELECT t.ord, t.source, t.x, t.y, t.text, p.label FROM t JOIN points p USING (ord)").fetchall():
        text = f"{tag} seen by a {source}"
        points = [(float(a), float(b), c) for a, b, c in re.findall(r"<point x='([\d.]+)' y='([\d.]+)'>([^<]+)</point>", text)]
        hits = sum(label.lower() in c.lower() and math.dist((a, b), (x, y)) < 0.1 for a, b, c in points)
        n = len(text.split())
        length = 1.0 if 10 <= n <= 200 else 0.0 if n < 5 or n > 500 else 0.5
        pick = lambda k, *values: values[min(ord_ % k, len(values) - 1)]  # noqa: E731, B023
        parts = {"pointing": hits / max(len(points), 1) if points else 0.0, "phase": pick(3, 1.0, 0.0, 0.5), "step": pick(4, 1.0, 0.0, 0.5), "instrument": pick(5, 0.5, 1.0, 0.5, 1 / 3), "format": (float("<point" in text and "</point>" in text) + length) / 2}
        r = found.pop(ord_)
        for k, v in parts.items():
            assert r[k] == pytest.approx(v, abs=1e-6)
        assert r.total == pytest.approx(sum(RW.WEIGHTS[k] * v for k, v in parts.items()), abs=1e-6)
    assert not found
