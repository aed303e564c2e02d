"""Names in texts: the trie against regular expressions over all texts and names."""

import random
import re

import pytest


def spans(text, names):
    """Longest names first; each takes its first place that is still free."""
    taken, out = [], []
    for name in sorted({n.strip().lower() for n in names}, key=lambda n: (-len(n), n)):
        parts = [re.escape(p) for p in re.split(r"[\s\-,']+", name) if p]
        if not parts:
            continue
        for m in re.finditer(r"(?<![A-Za-z0-9])" + r"[\s\-]*".join(parts) + r"s?(?![A-Za-z0-9])", text, re.I):
            if not any(m.start() < b and a < m.end() for a, b in taken):
                taken.append(m.span())
                out.append((name, *m.span()))
                break
    return out


NAMES = ["ethyl acetate", "acetate", "Acetates", "cooked meat", "2-methyl-3-furanthiol", "furan", "furanthiol", "(E)-2-nonenal", "nonenal", "alpha-pinene", "pinene", "don't know", "a", "ethyl", "ethyl acetate s", "C6H12O", "2,3-butanedione", " gamma-nonalactone ", "β-carotene", "foo)", "x+y", "[z]"]


def texts(n=150):
    rng = random.Random(6)
    bits = [w for name in NAMES for w in re.split(r"[\s\-,']", name.strip())] + ["s", "the", "meat", "-", "(", ")", "E", "  ", "\n", "furans", "acetates", "ethylacetate", "ethyl-acetate", "Cooked  Meats", "(e)-2-nonenal", "(E)2 nonenals", "foo)s", "foo)x", "x+ys", "İx", "2, 3-butanedione"]
    return [(i, "".join(rng.choice(bits) + rng.choice([" ", " ", "-", "", ", ", "'"]) for _ in range(rng.randrange(1, 25)))) for i in range(n)] + [(1000, None), (1001, ""), (1002, " " * 20_000 + "cooked meat" + "-" * 20_000), (1003, "word " * 30_000 + "Ethyl Acetate")]


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_mentions(spark, monkeypatch, most):
    from lumenary import session
    from lumenary.operators.graph import mine_mentions

    monkeypatch.setattr(session.counted, "__defaults__", (most,))
    rows = texts()
    got = mine_mentions(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(n,) for n in NAMES], "name string"))
    want = sorted((i, *s) for i, t in rows for s in spans(t or "", NAMES))
    assert len(want) > 100 and sorted(tuple(r) for r in got.collect()) == want


def test_simple_mentions(spark):
    from lumenary.operators.graph import mine_mentions_simple, searched_text

    rows = texts()
    got = mine_mentions_simple(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(n,) for n in [*NAMES, "123456"]], "name string"), spark.createDataFrame([(3, "acetate")], "id long, name string"))
    low = {n.strip().lower() for n in NAMES if len(n.strip()) >= 6}
    want = {(i, n) for i, t in rows for n in low if re.search(r"(?<![a-z0-9])" + re.escape(n) + r"(?![a-z0-9])", (t or "").lower())} - {(3, "acetate")}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20
    paper = spark.createDataFrame([(1, "T", None, "", ["a", "b"], None)], "id long, name string, main_claim string, abstract string, compound_class array<string>, sensory array<string>")
    assert searched_text(paper).first().text == "T a b"


def test_entry_nodes(spark):
    from lumenary.operators.graph import entry_nodes

    labels = [(1, "Cooked meat"), (2, "meat"), (3, "egg"), (4, "roast"), (5, "2-nonenal"), (6, "1234"), (7, "meat"), (8, "a.b.c"), (9, "fatty acid")]
    asked = [(1, "What gives COOKED MEATS their aroma?"), (2, "meaty roasts, cooked  meat"), (3, "x12-nonenals 01234"), (4, "a.b.c fatty acids."), (5, None), (6, "")]
    want = {(q, i) for q, t in asked for i, n in labels if len(n) >= 4 and re.search(r"(?<![a-z])" + re.escape(n.lower()) + r"s?(?![a-z])", (t or "").lower())}
    got = entry_nodes(spark.createDataFrame(asked, "qid long, text string"), spark.createDataFrame(labels, "id long, label string"))
    assert {tuple(r) for r in got.collect()} == want and (1, 1) in want


def test_places_of_an_empty_dictionary(spark):
    from lumenary.operators.graph import mine_mentions

    assert mine_mentions(spark.createDataFrame(texts(5), "id long, text string"), spark.createDataFrame([], "name string")).count() == 0


@pytest.mark.parametrize(("top", "counted"), [(5, 0), (60, 0), (10_000, 0), (60, 256)])
def test_similar_pairs(spark, top, counted, monkeypatch):
    """Against all pairs: a hot attribute that nearly every item holds, large sets and small ones."""
    from lumenary.operators import graph
    from lumenary.operators.graph import jaccard_pairs

    monkeypatch.setattr(graph, "COUNTED_PAIRS", counted)
    rng = random.Random(top)
    held = {i: {rng.randrange(60) for _ in range(rng.choice([1, 2, 3, 6, 14]))} | ({100} if rng.random() < 0.9 else set()) | ({101} if i % 2 else set()) for i in range(160)}
    held[200] = held[201] = set(range(30))
    rows = [(i, x) for i, xs in held.items() for x in xs] * 2
    want = []
    for a in held:
        for b in held:
            inter, union = len(held[a] & held[b]), len(held[a] | held[b])
            if a < b and inter >= 2 and (inter / union >= 0.34 or inter >= 4):
                want.append((a, b, inter, round(inter / union + 1e-12, 3)))
    want.sort(key=lambda p: (-p[2], -p[3], p[0], p[1]))
    edges = spark.createDataFrame(rows, "m long, o long")
    assert [tuple(r) for r in jaccard_pairs(edges, "m", "o", top=top).collect()] == want[:top]
    if top == 5:
        assert sorted(tuple(r) for r in jaccard_pairs(edges, "m", "o", top=None).collect()) == sorted(want)
        seeds = spark.createDataFrame([(3,), (200,)], "m long")
        assert sorted(tuple(r) for r in jaccard_pairs(edges, "m", "o", top=None, around=seeds).collect()) == sorted(p for p in want if {3, 200} & set(p[:2]))


def test_mining_writes_no_places(spark):
    """A common word costs nothing outside of the text's own task: no shuffle or checkpoint holds the places."""
    from lumenary.operators.graph import mine_mentions, mine_mentions_simple

    docs = spark.createDataFrame([("a", "roast acetal " * 5000), ("b", "acetals")], "id string, text string")
    names = spark.createDataFrame([("acetal",), ("roast acetal",)], "name string")
    for mine, want in ((mine_mentions, {("a", "roast acetal", 0, 12), ("a", "acetal", 19, 25), ("b", "acetal", 0, 7)}), (mine_mentions_simple, {("a", "acetal"), ("a", "roast acetal")})):
        got = mine(docs, names)
        assert {tuple(r) for r in got.collect()} == want
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_pairs_carry_no_sizes(spark):
    """What is shuffled by pair is the pair alone: sizes are joined to the few pairs that share enough."""
    from lumenary.operators.graph import jaccard_pairs

    edges = spark.createDataFrame([(i, j) for i in range(30) for j in range(6) if (i * 7 + j * j) % 3], "m int, o int")
    sets = {}
    for i, j in edges.collect():
        sets.setdefault(i, set()).add(j)
    want = {(a, b, len(x & y), round(len(x & y) / len(x | y), 3)) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= 2 and (len(x & y) / len(x | y) >= 0.34 or len(x & y) >= 4)}
    got = jaccard_pairs(edges, "m", "o", top=None)
    assert {tuple(r) for r in got.collect()} == want != set()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "first(n" not in plan and "Aggregate [a" in plan


def test_stats_over_graphs(spark):
    from lumenary.operators.graph import kg_stats

    edges = spark.createDataFrame([("k", "g", "a", "b"), ("k", "g", "a", "a"), ("k", "h", "b", "c"), ("l", "g", "a", "c")], "kind string, graph string, src string, dst string")
    got = kg_stats(edges)
    assert {tuple(r) for r in got.select("kind", "graph", "edges", "sources", "targets", "nodes").collect()} == {("k", "g", 2, 1, 2, 3), ("k", "h", 1, 1, 1, 3), ("l", "g", 1, 1, 1, 2)}
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()


def alike(held):
    """All pairs of sets that share enough, by brute force; None counts in a set's size and is shared with none."""
    out = set()
    for a, x in held.items():
        for b, y in held.items():
            inter = len((x & y) - {None})
            if a < b and min(len(x), len(y)) >= 2 and inter >= 2 and (inter / (len(x) + len(y) - inter) >= 0.34 or inter >= 4):
                out.add((a, b, inter, round(inter / (len(x) + len(y) - inter) + 1e-12, 3)))
    return out


def test_all_pairs_beside_a_hot_attribute(spark, monkeypatch):
    """All pairs are found, and an attribute that every item holds brings no pairs together."""
    from lumenary.operators import graph

    rng = random.Random(4)
    held = {i: {-1, *(rng.randrange(150) for _ in range(rng.choice([0, 1, 2, 4, 7, 11])))} | ({None} if i % 5 == 0 else set()) for i in range(600)}
    met, pairs_of = [], graph._pairs_of
    monkeypatch.setattr(graph, "_pairs_of", lambda some, *rest: met.append(some) or pairs_of(some, *rest))
    monkeypatch.setattr(graph, "COUNTED_PAIRS", 32)
    edges = spark.createDataFrame([(i, x) for i, xs in held.items() for x in xs], "m long, o long")
    got = [tuple(r) for r in graph.jaccard_pairs(edges, "m", "o", top=None).collect()]
    want = alike(held)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    assert len(met) == 1 and met[0].where("attr = -1").count() == 0


def whole(spark, data):
    from lumenary.adapters import adapter
    from lumenary.plans.graph import edges_of

    return edges_of(*(adapter(spark, data, n) for n in ("molecule_odours", "paper_topics", "paper_molecules", "molecules", "odours")), top=None)


def test_whole_graph(spark, data):
    """all edges of the graph, where more pairs are alike than the query lists."""
    from lumenary import catalog
    from lumenary.adapters import adapter

    held = {}
    for m, o in adapter(spark, data, "molecule_odours").collect():
        held.setdefault(m, set()).add(o)
    got = [tuple(r) for r in whole(spark, data).collect()]
    first = [tuple(r) for r in catalog.queries()["d10_assemble_edges"](spark, data).collect()]
    pairs = [r for r in got if r[2] == "aroma_similar"]
    assert sorted(pairs) == sorted((f"m{a}", f"m{b}", "aroma_similar", "molecule", j, n, None) for a, b, n, j in alike(held)) and len(pairs) > 6000
    assert set(first) <= set(got) and len(got) - len(first) == len(pairs) - 6000


def test_stats_of_the_whole_graph(spark, data):
    """the counts are those of all edges."""
    from lumenary.operators.graph import kg_stats

    edges = whole(spark, data).select("kind", "graph", "src", "dst").collect()
    want = {(k, g): (len(at), len({s for s, _ in at}), len({d for _, d in at}), len({n for e in at for n in e})) for k, g in {(e.kind, e.graph) for e in edges} for at in [[(e.src, e.dst) for e in edges if e.kind == k]]}
    assert {(r["kind"], r["graph"]): (r["edges"], r["sources"], r["targets"], r["nodes"]) for r in kg_stats(whole(spark, data)).collect()} == want
    assert want["aroma_similar", "molecule"][0] > 6000
