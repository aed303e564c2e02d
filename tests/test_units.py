"""Operators that SQL does not check, on small frames, and streams against their batch twins."""

import json
import random

import pytest
from pyspark.sql import functions as F


def test_name_list(spark, tmp_path):
    from lumenary.sources.files import read_name_list

    p = tmp_path / "names.csv"
    p.write_text("﻿name,cas\n Hexanal ,66-25-1\n\n ,x\nFuraneol,1\n", encoding="utf-8")
    assert [r.name for r in read_name_list(spark, str(p)).collect()] == ["Hexanal", "Furaneol"]
    assert [r.name for r in read_name_list(spark, str(p), "cas").collect()] == ["66-25-1", "x", "1"]
    with pytest.raises(ValueError):
        read_name_list(spark, str(p), "none")


def test_taxonomy(spark, tmp_path):
    from lumenary.sources.files import load_taxonomy

    rows = [("b", "taste", "MED", 1), ("a", "taste", "HIGH", 2), ("c", "odd", "HIGH", 0), ("B2", "aroma", "MED", 1), ("A2", "aroma", "MED", 1)]
    p = tmp_path / "t.json"
    p.write_text(json.dumps([{"keyword": k, "branch": b, "priority": q, "topic_slug": k, "topic_name": k, "topic_level": n} for k, b, q, n in rows]))
    assert [r.keyword for r in load_taxonomy(spark, str(p), ["aroma", "taste"]).collect()] == ["A2", "B2", "a", "b", "c"]
    assert load_taxonomy(spark, str(p), ["aroma"], branch="taste", priority="HIGH").count() == 1


def test_graph_xml(spark, tmp_path):
    from lumenary.sources.files import read_graph_xml

    head = '<graphml><key id="d0" for="node" attr.name="kind" attr.type="string"/><key id="d1" for="edge" attr.name="w" attr.type="double"/><graph edgedefault="undirected">'
    body = '<node id="n2"><data key="d0">x</data></node><node id="n1"></node><edge source="n2" target="n1"><data key="d1">0.5</data></edge>'
    p = tmp_path / "g.graphml"
    p.write_text(head + body + "</graph></graphml>")
    nodes, edges = read_graph_xml(spark, str(p))
    assert {r.id: r.attrs for r in nodes.collect()} == {"n1": {}, "n2": {"kind": "x"}}
    assert [(r.src, r.dst, r.attrs) for r in edges.collect()] == [("n1", "n2", {"w": "0.5"})]
    p.write_text(head + body + '<edge source="n1" target="n2"/></graph></graphml>')
    with pytest.raises(ValueError):
        read_graph_xml(spark, str(p))


def test_body(spark):
    from lumenary.sources.files import extract_body

    pages = [(1, "<html><script>var t='<p>no</p>'</script><nav><p>menu</p></nav><h1>A &amp; B</h1><p>one <b>two</b>\n three</p><p> </p></html>"), (2, "<div>bare</div>"), (3, None)]
    got = extract_body(spark.createDataFrame(pages, "page_id long, html string")).collect()
    assert [(r.page_id, r.body, r.paragraphs, r.characters) for r in got] == [(1, "A & B\n\none two three", 2, 20)]


def test_exports(spark, tmp_path):
    from lumenary.sources.files import backup, export_csv, export_jsonl

    df = spark.createDataFrame([(1, "=x", True, ["a", "b"], "10.1/z"), (2, None, None, None, None)], "id long, name string, flag boolean, tags array<string>, doi string")
    export_csv(df.coalesce(1), str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("*.csv")).read_bytes()
    assert text.split(b"\r\n")[1] == b"1,'=x,true,a; b,10.1/z,https://doi.org/10.1/z" and text.count(b"\r\n") == 3
    got = {r.table: r.rows for r in backup({"x": df, "y": df.limit(1)}, str(tmp_path / "b")).collect()}
    assert got == {"x": 2, "y": 1}
    with pytest.raises(ValueError):
        export_jsonl({}, "2024-01-01", "2024-06-01", "2024-07-01")


def test_mentions_longest_first(spark):
    from lumenary.operators.graph import mine_mentions

    names = ["2-methyl furan", "furan", "methyl", "hexanal"]
    text = "2 methylfurans and furan; hexanals, xhexanal methyl-x"
    want = {("2-methyl furan", 0, 14), ("furan", 19, 24), ("hexanal", 26, 34), ("methyl", 45, 51)}
    docs = spark.createDataFrame([(1, text.upper()), (2, None), (3, "nothing")], "id long, text string")
    got = mine_mentions(docs, spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert {(r.name, r.start, r.end) for r in got} == want and {r.id for r in got} == {1}


def test_names(spark):
    from lumenary.operators.identity import around_parenthesis, display_name, match_key, name_variants, norm_synonym, normalise_names, query_keys, without_stereo

    assert norm_synonym("  “Hexanal” ") == "hexanal" and norm_synonym("ﬁsh  Oil") == "fish oil" and norm_synonym(" '' ") == "" and norm_synonym("STRASSE") == norm_synonym("straße")
    assert norm_synonym("“Foo»") == "foo" and norm_synonym("«Foo") == "foo" and display_name(" ‘ﬁsh   Oil` ") == "fish Oil" and display_name(None) == ""
    got = normalise_names(spark.createDataFrame([("A  b",), (None,), (" ",)], "name string")).collect()
    assert [(r.key, r.display) for r in got] == [("a b", "A b"), ("", ""), ("", "")]
    assert without_stereo("(E)-(Z)-cis-dl-trans-x") == "trans-x" and without_stereo("gamma-nonalactone") == "gamma-nonalactone" and without_stereo("(2E,4Z)-decadienal") == "decadienal" and without_stereo("tert-butanol") == "tert-butanol"
    assert match_key("(E)–2–Hexenal [FG]") == match_key("trans-2-hexenal") == "2hexenal" and match_key("2,4-heptadienal, (e,e)-") == "24heptadienal" and match_key(None) == ""
    assert around_parenthesis("3-methylindole (skatole)") == ("3-methylindole", "skatole") and around_parenthesis("2-(methylthio)furan") == (None, None)
    assert around_parenthesis("a, (b (c))") == ("a", "b (c)") and around_parenthesis("(x)") == (None, None) and around_parenthesis("a ()") == (None, None) and around_parenthesis("a) b)") == (None, None)
    assert name_variants("(E)-2-Hexenal (leaf aldehyde)") == [
        ("(E)-2-Hexenal", "strip_parenthetical"), ("leaf aldehyde", "parenthetical_synonym"), ("2-Hexenal (leaf aldehyde)", "strip_stereo"), ("2-Hexenal", "strip_stereo+head"),
        ("(E)-2-Hexenal(leafaldehyde)", "drop_spaces"), ("leafaldehyde", "drop_spaces"), ("2-Hexenal(leafaldehyde)", "drop_spaces")]
    assert name_variants("2 - methyl, x.") == [("2 - methyl, x", "base_clean"), ("2 - methyl,x", "tighten_commas"), ("2-methyl, x", "tighten_hyphens"), ("2-methyl,x", "drop_spaces")]
    assert name_variants(None) == [] and query_keys("cis-3-hexenol (leaf alcohol)") == ["3hexenol", "3hexenolleafalcohol", "leafalcohol"]


def test_inverted_file(spark):
    """On vectors in clusters a tenth of all pairs gives the stated recall; on any, what is measured is kept."""
    import numpy as np
    from lumenary.operators.retrieval import vector_search
    from lumenary.operators.vectors import build_inverted_file, inverted_search, recall_by_probes

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=16) * 0.15]) for i in range(1600)] + [(5000, [0.0] * 16), (5001, None)]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = items.where("vec_id % 20 = 0 AND vec_id < 1600")
    index = build_inverted_file(items)
    table = {r.probes: r for r in recall_by_probes(index, asked).collect()}
    probes = min(p for p, r in table.items() if r.recall >= 0.93)
    assert table[probes].share < 0.1 and max(r.recall for r in table.values()) == 1.0 and index.items.count() == 1600
    got = {(r.qid, r.vec_id) for r in inverted_search(index, asked).collect()}
    want = {(r.qid, r.vec_id) for r in vector_search(items.where("vec_id < 5000"), asked).collect()}
    assert len(got & want) >= 0.9 * len(want)
    every = {(r.qid, r.vec_id, r.nth) for r in inverted_search(index, asked, probes=index.n_lists).collect()}
    assert {(q, v) for q, v, _ in every} == want


def test_pack_evidence(spark):
    """Each source of an item takes its content while it fits; an item over what is left ends the packing, one that no longer fits its next source does not."""
    from lumenary.operators.retrieval import pack_evidence

    rng = random.Random(1)
    rows = [(q, p, [rng.randrange(9) for _ in range(rng.randrange(4))], "x" * rng.randrange(0, 60)) for q in range(20) for p in range(12)] + [(50, 0, [1, 2], "y" * 30), (50, 1, [3], "z" * 9), (50, 2, [4], "w" * 12), (50, 3, [5], "")]
    for budget in (150, 40):
        want = []
        for q in {r[0] for r in rows}:
            left = budget
            for _, p, sources, text in sorted(r for r in rows if r[0] == q):
                content = text[:40]
                if len(content) > left:
                    break
                for s in sources:
                    if len(content) <= left:
                        want.append((q, p, s, content))
                        left -= len(content)
        got = pack_evidence(spark.createDataFrame(rows, "qid long, pos int, source_ids array<long>, content string").repartition(3), budget, 40)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert (50, 1, 3, "z" * 9) in want and (50, 0, 2, "y" * 30) not in want and (50, 2, 4, "w" * 12) not in want


def test_turns_against_the_fold(spark):
    from lumenary.streaming.telemetry import fold_turns, latest_turn

    rng = random.Random(2)
    rows = [(f"t{rng.randrange(30)}", n, rng.choice("aaab"), rng.randrange(6), rng.choice(["submitted", "submitted", "completed", "failed"]), f"c{n}") for n in range(300)]
    got = {r.turn_id: (r.owner, r.revision, r.status, r.content) for r in latest_turn(spark.createDataFrame(rows, "turn_id string, arrival long, owner string, revision long, status string, content string")).collect()}
    assert got == {t: fold_turns([r[2:] for r in rows if r[0] == t]) for t in {r[0] for r in rows}}


def test_streams_equal_batches(spark, data):
    from lumenary import catalog

    q = catalog.queries()
    last = {}
    for r in q["j3_latest_turn_stream"](spark, data).collect():
        last.setdefault(r.turn_id, []).append((r.revision, r.status, r.content))
    want = {r.turn_id: (r.revision, r.status, r.content) for r in q["j3_latest_turn"](spark, data).collect()}
    assert set(last) == set(want) and all(want[t] in rows for t, rows in last.items())
    events = spark.read.parquet(f"{data}/events.parquet")
    assert q["j2_dedupe_stream"](spark, data).count() == events.select("event_id").distinct().count()


def test_lsh_recall(spark, data):
    from lumenary import catalog

    q = catalog.queries()
    pairs = lambda df: {(r.qid, r.vec_id) for r in df.where("nth <= 5").collect()}
    exact, near = pairs(q["r6_vector_search"](spark, data)), pairs(q["r6_lsh_search"](spark, data))
    assert len(exact & near) >= 0.9 * len(exact)


def test_search_by_blocks(spark):
    """Copies, ties, a vector without length, null components and other sizes against every pair; products choose pairs, and no pair is joined."""
    import numpy as np
    from lumenary.operators.retrieval import lsh_search, vector_search

    rng = np.random.default_rng(5)
    base = rng.integers(-3, 4, size=(30, 8)).astype(float)
    rows = [(i, [float(x) for x in base[i % 30]]) for i in range(400)] + [(400 + i, [float(x) for x in base[3]]) for i in range(200)]
    rows += [(700, [0.0] * 8), (701, [1.0, None] + [2.0] * 6), (702, [1.0, 2.0, 3.0]), (703, [3.0, 2.0, 1.0]), (704, None)]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = items.where("vec_id IN (0, 3, 17, 55, 450, 701, 702)")

    def cosine(a, b):
        if None in a or None in b:
            return None
        dot = lambda x, y: sum((float(p) * q for p, q in zip(x, y, strict=True)), 0.0)
        length = dot(a, a) ** 0.5 * dot(b, b) ** 0.5
        return round(dot(a, b) / length, 6) if length else float("inf")

    vectors = {i: v for i, v in rows if v}
    want = []
    for q in (0, 3, 17, 55, 450, 701, 702):
        scored = [(cosine(vectors[q], v), i) for i, v in vectors.items() if len(v) == len(vectors[q])]
        scored.sort(key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
        want += [(q, i, s, n + 1) for n, (s, i) in enumerate(scored[:20])]
    plain = lambda s: None if s is None else float("inf") if s != s else s
    got = lambda df: sorted((r.qid, r.vec_id, plain(r.similarity), r.nth) for r in df.collect())
    found = vector_search(items, asked)
    assert got(found) == sorted(want) and got(vector_search(items, asked, block=2)) == sorted(want)
    assert got(vector_search(items.repartition(7), asked)) == sorted(want)
    near = lsh_search(items.where("vec_id < 700"), asked.where("vec_id < 700"), bits=1)
    assert got(near) == [x for x in got(vector_search(items.where("vec_id < 700"), asked.where("vec_id < 700")))]
    for df in (found, near):
        assert "zip_with" not in df._jdf.queryExecution().toString()


def test_inversion_without_shuffles(spark):
    """Rows are inverted where they lie; texts of one id are one document of the term index, and one row each of the abstracts."""
    from lumenary.operators.retrieval import build_term_index
    from lumenary.sources.files import abstract_from_inverted_index, invert

    texts = {1: "b a  b c b", 2: "", 3: None, 4: " ", 5: "the x", 6: "z" * 9 + " \u00e9 z"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    back = abstract_from_inverted_index(invert(docs, "text"), "index")
    assert {r.id: r.abstract for r in back.collect()} == {i: t for i, t in texts.items() if t}
    index = build_term_index(docs)
    entries = lambda df: {(r.id, r.term): (r.tf, r.places) for r in df.collect()}
    want = {(1, "b"): (3, [0, 2, 4]), (1, "c"): (1, [3]), (5, "x"): (1, [1]), (6, "z" * 9): (1, [0]), (6, "\u00e9"): (1, [1]), (6, "z"): (1, [2])}
    assert entries(index) == want
    for df in (back, index):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert entries(build_term_index(docs, terms=spark.createDataFrame([("b",), ("x",)], "term string"))) == {k: v for k, v in want.items() if k[1] in "bx"}
    twice = docs.unionByName(spark.createDataFrame([(1, "q b")], docs.schema))
    assert entries(build_term_index(twice)) == want | {(1, "q"): (1, [0]), (1, "b"): (4, [0, 1, 2, 4])}


def test_probed_lists_only(spark):
    """With one list probed, a query's best are the best of that list; pairs are not joined row by row."""
    import numpy as np
    from lumenary.operators.retrieval import vector_search
    from lumenary.operators.vectors import build_inverted_file, inverted_search, probe_order

    rng = np.random.default_rng(8)
    items = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)], "vec_id long, embedding array<float>")
    asked = items.where("vec_id < 9")
    index = build_inverted_file(items, n_lists=11)
    lists = {r.vec_id: r.list for r in index.items.collect()}
    first = {r.qid: r.list for r in probe_order(index, asked).where("nth = 1").collect()}
    got = inverted_search(index, asked, probes=1)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    want = []
    for q, of in first.items():
        inside = [i for i, at in lists.items() if at == of]
        best = vector_search(items.where(f"vec_id IN ({','.join(map(str, inside))})"), asked.where(f"vec_id = {q}"))
        want += [tuple(r) for r in best.select("qid", "vec_id", "similarity", "nth").collect()]
    assert sorted(tuple(r) for r in got.select("qid", "vec_id", "similarity", "nth").collect()) == sorted(want)


def test_graph_files_are_bounded(spark, data, monkeypatch):
    """Elements go to files of a bounded number, so that no task reads more as the graph grows."""
    from lumenary import catalog
    from lumenary.plans import sources

    whole = catalog.queries()["a8_graph_edges"](spark, data).collect()
    monkeypatch.setattr(sources, "XML_ROWS", 1000)
    seen = []
    monkeypatch.setattr(sources, "folder", lambda df, name, f=sources.folder: seen.append(f(df, name)) or seen[-1])
    assert sorted(map(str, catalog.queries()["a8_graph_edges"](spark, data).collect())) == sorted(map(str, whole))
    assert max(r.n for r in spark.read.text(seen[0]).where("value LIKE '%<edge %'").groupBy("_metadata.file_path").count().toDF("f", "n").collect()) <= 1000


def test_topic_tree_against_walks(spark):
    """A long chain, two parents, a cycle and an unknown parent: the shortest way to each ancestor."""
    from lumenary.operators.curation import topic_tree

    edges = [(i, i - 1) for i in range(1, 14)] + [(0, None), (20, 21), (21, 22), (22, 20), (30, 13), (30, 5), (40, 99)]
    want = set()
    for i in {i for i, _ in edges}:
        depth, last = {i: 0}, [i]
        while last:
            last = list({p for x in last for c, p in edges if c == x and p is not None and p not in depth})
            depth |= {p: max(depth.values()) + 1 for p in last}
        want |= {(i, a, d) for a, d in depth.items()}
    assert {tuple(r) for r in topic_tree(spark.createDataFrame(edges, "id long, parent long")).collect()} == want


def test_bridge_edges_partitions(spark):
    """Repeated links, links without an end, and partitions that grow with the counted links."""
    from lumenary.operators.graph import bridge_edges

    cols = "source_id long, molecule_id long"
    curated = spark.createDataFrame([(1, 2), (1, 2), (None, 5), (3, None)] + [(i, i) for i in range(10, 60)], cols)
    mined = spark.createDataFrame([(1, 2), (2, 2), (2, 2), (None, 5), (3, None), (10, 10)], cols)
    out = bridge_edges(curated, mined, each=2)
    want = [(1, 2, "curated"), (None, 5, "curated"), (3, None, "curated"), (2, 2, "mined"), (None, 5, "mined"), (3, None, "mined")] + [(i, i, "curated") for i in range(10, 60)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want)) and out.rdd.getNumPartitions() == 27


def test_withdrawals_hold_events_in_one_call():
    from pyspark.sql import Row

    from lumenary.streaming.state import Withdrawals

    class Held(list):
        calls = 0

        def appendList(self, rows):  # noqa: N802
            self.calls += 1
            self.extend(rows)

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return type("Value", (), {"exists": lambda self: False})()

        def getListState(self, *_):  # noqa: N802
            return Held()

    w = Withdrawals()
    w.init(Handle())
    out = list(w.handleInputRows((7,), iter([Row(session_id=7, at=i, event_id=i) for i in range(50)]), None))
    assert [r.event_id for r in out] == list(range(50)) and w.held == [(i,) for i in range(50)] and w.held.calls == 1


def test_results_do_not_depend_on_the_partitions(spark, data):
    from lumenary.operators.claims import claim_weights
    from lumenary.operators.graph import jaccard_pairs
    from lumenary.adapters import adapter

    from lumenary.plans.claims import named

    claims, edges = named(adapter(spark, data, "claims")), adapter(spark, data, "molecule_odours")
    rows = lambda df: sorted(map(str, df.collect()))
    a = claim_weights(claims).select("claim_id", F.round("weight", 9))
    assert rows(a) == rows(claim_weights(claims.repartition(13, F.rand(3))).select("claim_id", F.round("weight", 9)))
    assert rows(jaccard_pairs(edges, "molecule_id", "odour_id")) == rows(jaccard_pairs(edges.repartition(5, F.rand(1)), "molecule_id", "odour_id"))


def test_sample_claims(spark):
    """A polarity conflict, divergences by matrix and temperature, interval conflicts of one unit only, a single-source floor."""
    from lumenary.operators.claims import claim_weights, conflict_pairs, edge_consensus

    cols = ("claim_id string, subject long, axis string, object long, polarity string, evidence_tier string, method string, directness string, source_id long, source_group long, matrix string, temp_c double, ph double, "
            "low double, high double, quantity string, unit string")
    strong, none = ("T1_experimental", "gco_aeda_quant", "target_matrix"), (None,) * 4
    rows = [("c1", 1, "aroma", 1, "+", *strong, 1, 1, "beef", 60.0, 5.5, *none), ("c2", 1, "aroma", 1, "+", "T1_experimental", "sensory_trained", "target_matrix", 2, 2, "beef", 62.0, 5.5, *none),
            ("c3", 1, "aroma", 1, "-", "T2_review", "gcms_identification", "analogous_matrix", 3, 3, "beef", 65.0, 5.6, *none), ("c4", 1, "aroma", 1, "-", "T2_review", "gcms_identification", "analogous_matrix", 4, 4, "pork", 60.0, 5.5, *none),
            ("c5", 2, "level", 1, "+", *strong, 5, 5, None, 60.0, 5.5, 1.0, 2.0, "OAV", None), ("c6", 2, "level", 1, "+", *strong, 6, 6, None, 61.0, 5.5, 5.0, 6.0, "OAV", None), ("c7", 2, "level", 1, "+", *strong, 7, 7, None, 120.0, 5.5, 5.0, 6.0, "OAV", None),
            ("c8", 3, "aroma", 9, "+", "hearsay", "dream", None, 8, 8, None, 20.0, 7.0, *none), ("c9", 2, "level", 1, "+", *strong, 9, 9, None, 60.0, 5.5, 50.0, 60.0, "OAV", "ug/kg")]
    claims = spark.createDataFrame(rows, cols)
    pairs = {(r.claim_a, r.claim_b): r.kind for r in conflict_pairs(claims).collect()}
    assert pairs == {("c1", "c3"): "contradiction", ("c2", "c3"): "contradiction", ("c1", "c4"): "divergence", ("c2", "c4"): "divergence", ("c5", "c6"): "contradiction", ("c5", "c7"): "divergence"}
    weights = claim_weights(claims)
    w = {r.claim_id: r.weight for r in weights.collect()}
    assert w["c8"] == pytest.approx(0.45 * 0.5 * 0.55 / (1 + 2.302585092994046))
    assert w["c4"] > w["c3"] >= 0 and w["c7"] > w["c6"]
    assert edge_consensus(weights).where("subject = 3").first().consensus == pytest.approx(w["c8"])


def test_containing_against_brute_force(spark):
    from lumenary.operators.substring import containing

    texts = [(1, "abcabcabd"), (2, "ab"), (3, ""), (4, None), (5, "xyz.b\u00e9ta*"), (6, "aaaaaaa" * 50), (6, "zb"), (7, "abcabcabd")]
    keys = ["a", "ab", "abd", "abcd", "cabd", "aaaaaaaaa", "b\u00e9ta*", ".b", "", None, "zz", "cabcab", "cabcab"]
    t, k = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(x,) for x in keys], "key string")
    for shortest, longest in ((1, 3), (1, 4), (4, 4)):
        want = sorted((i, key) for i, text in texts for key in set(keys) if text and key and len(key) >= shortest and key in text)
        assert sorted((r.id, r.key) for r in containing(t, k, shortest, longest).collect()) == want
    assert containing(t.limit(0), k).count() == containing(t, k.limit(0)).count() == 0


def test_topics_by_either_join(spark, data):
    from lumenary.adapters import adapter
    from lumenary.operators.curation import classify_topics

    papers, terms = adapter(spark, data, "papers"), adapter(spark, data, "terms")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(classify_topics(papers, terms)) == rows(classify_topics(papers, terms, most=0)) != []


def test_pairs_around_some_items(spark, data):
    from lumenary.adapters import adapter
    from lumenary.operators.graph import jaccard_pairs

    edges = adapter(spark, data, "molecule_odours")
    some = {r.molecule_id for r in edges.where("molecule_id % 7 = 0").collect()}
    every = jaccard_pairs(edges, "molecule_id", "odour_id", top=None).collect()
    near = jaccard_pairs(edges, "molecule_id", "odour_id", top=None, around=edges.where("molecule_id % 7 = 0")).collect()
    assert sorted(map(str, near)) == sorted(str(r) for r in every if r.a in some or r.b in some) != []


def test_priority_halves(spark):
    """Rounded as exact numbers are: a half is rounded up whatever a double makes of it."""
    from decimal import ROUND_HALF_UP, Decimal
    from fractions import Fraction

    from lumenary.operators.curation import priority_score

    rows = [(c, y, r) for c in range(0, 400, 7) for y in range(2001, 2027) for r in (None, 57)]
    got = priority_score(spark.createDataFrame(rows, "citation_count int, year int, relevance_llm int").selectExpr("*", "'x' AS name", "'y' AS abstract", "'z' AS journal")).collect()
    tenth = lambda x: float((Decimal(x.numerator) / Decimal(x.denominator)).quantize(Decimal("0.1"), ROUND_HALF_UP))
    for g in got:
        base = tenth(8 + min(Fraction(20), Fraction(3 * g.citation_count, max(1, 2026 - g.year))) + (10 if g.year >= 2021 else 5 if g.year >= 2015 else 0))
        assert g.base == base
        assert g.priority == (base if g.relevance_llm is None else tenth(Fraction(6, 10) * g.relevance_llm + Fraction(4, 10) * Fraction(str(base))))
