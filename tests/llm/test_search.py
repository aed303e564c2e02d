"""Ranked search, clustering and SimHash against brute force on small frames, and on rows that are odd in every way."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from .frames import SCHEMA, frame, odd_rows, planted, words
from .test_operators import SPACE, low

FRAMES = {"odd": (odd_rows(), SCHEMA), "planted": (planted(), "doc_id long, text string"), "empty": ([], SCHEMA)}
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@pytest.fixture(params=list(FRAMES))
def docs(request, spark):
    rows, schema = FRAMES[request.param]
    return frame(spark, rows, schema), [(r[0], r[1]) for r in rows]


def ranked(docs, items, best):
    """The rule as it stands, over all documents of each item."""
    held = [(i, Counter(re.findall(TERM, low(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        asked = Counter(re.findall(TERM, low(text)))
        scores = []
        for i, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in asked.items() if t in c)
            if s > 0:
                scores.append((-s, -(2**63) if i is None else i))
        out.update((item, r + 1, None if i == -(2**63) else i, -s) for r, (s, i) in enumerate(sorted(scores)[:best]))
    return out


def asked_items():
    rng = random.Random(8)
    texts = [" ".join(words(rng, 25)) for _ in range(12)] + ["A b, c; a", "", None, "nowhere to_be found", "don't stop 12345", "w1 " * 40, "é ß w3", planted()[7][1], planted()[7][1]]
    return [(i, t, "x", i) for i, t in enumerate(texts)] + [(3, "w5 w6", "y", 1), (None, "w7 w8 w9", None, None)]


@pytest.mark.parametrize(("first_tier", "block_items", "best"), [(4096, 4096, 10), (1, 4096, 3), (30, 5, 10)])
def test_op11(spark, docs, first_tier, block_items, best):
    from lumenary.llm.ranking import best_documents

    df, rows = docs
    items = asked_items()
    out = best_documents(df, frame(spark, items, "item_id long, text string, doc_id string, score long"), best, first_tier, block_items)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in out.collect()) == ranked(rows, [(i[0], i[1]) for i in items], best)


def test_op11_no_items(spark):
    from lumenary.llm.ranking import best_documents

    assert best_documents(frame(spark, planted(10)), frame(spark, [], "item_id long, text string")).count() == 0


def test_op11_limits_accumulators():
    """Common terms create no accumulators once they cannot matter, and the result does not change."""
    from lumenary.llm.ranking import Search

    class Asked:
        ids, item, term, times = [0], np.zeros(3, np.int64), np.arange(3), np.ones(3, np.int64)

    n = 4000  # two rare terms in 20 documents, one term in all
    doc = np.concatenate([np.repeat(np.arange(20), 2), np.arange(n)])
    term = np.concatenate([np.tile([0, 1], 20), np.full(n, 2)])
    impact = np.full(len(doc), 500_000)
    search = Search(Asked, np.array([20, 20, n]), np.array([500_000] * 3), n, 10 * n, 10, 50)
    assert search.n_tiers > 1
    upto, made = 0, []
    while True:
        keys, score = search.accumulators(doc, term, impact, upto)
        made.append(len(keys))
        if not search.raise_bars(upto, np.array([np.sort(score)[-10]])):
            break
        upto += 1
    keys, score = search.accumulators(doc, term, impact, search.n_tiers - 1)
    assert max(made) == len(keys) == 20 and len(set(score.tolist())) == 1
    assert score[0] == sum(500_000 * math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in (20, 20, n))


def lloyd(rows, k, rounds):
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    c = [r[1] for r in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, *near(v)[::-1]) for i, v in kept], c


def vectors(n, seed=4, wide=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, wide) for _ in range(64)] for _ in range(6)]
    return [(i, [float(np.float32(x + rng.gauss(0, wide / 3))) for x in centres[rng.randrange(6)]]) for i in range(n)]


def odd_vectors():
    some = vectors(30)
    v = some[0][1]
    return some + [(100, None), (101, []), (102, v[:63]), (103, v + [0.0]), (104, v[:63] + [None]), (105, v[:63] + [float("nan")]), (106, v[:63] + [float("inf")]), (107, v), (107, v), (107, some[1][1]), (None, v), (None, some[2][1]), (108, [0.0] * 64), (109, [-0.001] * 64)]


@pytest.mark.parametrize(("rows", "k"), [(vectors(300), 8), (odd_vectors(), 7), (odd_vectors(), 60), ([], 5), (vectors(40, wide=1e6), 4), (vectors(30, wide=1e12), 4)])
def test_op12(spark, rows, k):
    from lumenary.llm.clusters import cluster_vectors

    df = frame(spark, [(i, v, 1, "x", 2, 0.5) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string, distance long, lower double")
    state, centroids, inertia = cluster_vectors(df, k)
    want, c = lloyd(rows, k, 5)
    assert centroids == c
    assert Counter((r.vec_id, r.cluster, r.distance) for r in state.collect()) == Counter((i, j, min(d, 2**63 - 1)) for i, j, d in want)
    if max((d for *_, d in want), default=0) < 2**62:
        assert inertia == {j: sum(d for _, a, d in want if a == j) for j in {a for _, a, _ in want}}


def test_op12_bounds_spare_scans(spark):
    from lumenary.llm.clusters import cluster_vectors

    state, _, _ = cluster_vectors(frame(spark, vectors(2000), "vec_id long, embedding array<double>"), 6)
    assert state.where("scanned").count() < 400


def test_op12_loosening():
    """No vector of a sphere comes nearer to a moved centroid by more than its bound, which is often under the move."""
    from lumenary.llm.clusters import loosening

    rng = np.random.default_rng(2)
    less = 0
    for _ in range(200):
        before = rng.normal(size=(2, 3)) * 4
        after = before + rng.normal(size=(2, 3)) * rng.choice([0.1, 1, 5])
        radius = np.array([rng.uniform(0, 3), 0.1])
        bound = loosening(before, after, radius)[0]
        x = rng.normal(size=(3000, 3))
        x = before[0] + x / np.linalg.norm(x, axis=1)[:, None] * radius[0] * rng.uniform(0, 1, (3000, 1)) ** 0.2
        nearer = np.linalg.norm(x - before[1], axis=1) - np.linalg.norm(x - after[1], axis=1)
        assert nearer.max() <= bound + 1e-9
        less += bound < 0.9 * np.linalg.norm(after[1] - before[1])
    assert less > 60


def fingerprint(text):
    w = re.findall(SPACE, low(text))
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reached(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for u, v in links:
            m = min(label[u], label[v])
            if label[u] != m or label[v] != m:
                label[u] = label[v] = m
                changed = True
    return label


@pytest.mark.parametrize("most", [4096, 4])
def test_op13(docs, most):
    from lumenary.llm.simhash import simhash_components

    df, rows = docs
    key = lambda i: -(2**63) if i is None else i
    fps = [(i, fingerprint(t)) for i, t in rows]
    links = [(key(i), key(j)) for n, (i, f) in enumerate(fps) for j, g in fps[:n] if (f ^ g).bit_count() <= 3]
    label = reached({key(i) for i, _ in fps}, links)
    want = Counter((i, f, None if label[key(i)] == -(2**63) else label[key(i)]) for i, f in fps)
    out = simhash_components(df, most=most)
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in out.collect()) == want


@pytest.mark.parametrize("most", [4096, 60, 12])
def test_op13_grids_lose_no_link(spark, most):
    """Families of fingerprints 1 to 4 bits apart, dense ones too, in cells that are divided once, twice or dealt in pairs."""
    from lumenary.llm.components import components
    from lumenary.llm.simhash import near_links

    rng = random.Random(11)
    fps = {rng.getrandbits(64) for _ in range(150)} | {0, 2**64 - 1, 2**63}
    for f in sorted(fps)[:40]:
        for _ in range(rng.randrange(8)):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                f ^= 1 << b
            fps.add(f)
    fps |= {(1 << a) | (1 << b) for a in range(12) for b in range(12)}
    fps = sorted(fps)
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    links = [(signed(f), signed(g)) for n, f in enumerate(fps) for g in fps[:n] if (f ^ g).bit_count() <= 3]
    want = reached([signed(f) for f in fps], links)
    found = near_links(frame(spark, [(signed(f),) for f in fps], "fp long"), most=most)
    rows = [tuple(r) for r in found.collect()]
    assert all(((u ^ v) % 2**64).bit_count() <= 3 for u, v in rows)
    label = {r.u: r.v for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert {f: label.get(f, f) for f in want} == want


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_centroid_clustering"])
def test_queries_against_sql(spark, data, name):
    import duckdb
    from lumenary.llm.entries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, data).select(*want.columns)
    assert Counter(tuple(r) for r in got.collect()) == Counter(want.fetchall())


def test_op13_query(spark, data):
    from lumenary.llm.entries import QUERIES

    out = QUERIES["op13_simhash"](spark, data)
    assert [t for _, t in out.dtypes] == ["bigint", "string", "bigint"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert {r.doc_id: r.fingerprint for r in out.collect()} == {i: f"{fingerprint(t):016x}" for i, t in texts.items()}
    assert out.where(F.col("component_id") < F.col("doc_id")).count() > 0
