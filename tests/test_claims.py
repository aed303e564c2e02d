"""Claims: oppositions by sweep against all pairs."""

import random

import pytest


def claim(rng, i, wide, coarse=False):
    if coarse:  # few conditions, so that claims are sorted by them
        low = rng.choice([None, rng.uniform(0, wide)])
        return (f"c{i}", 0, "axis", 0, rng.choice("+-"), rng.choice(["m1", "m2"]), 20.0, rng.choice([4.0, 6.5]), low, None if low is None else low + rng.uniform(0, wide / 5), "OAV", None, rng.choice([0.2, 0.5, 1.0]))
    low = rng.choice([None, rng.uniform(0, wide)])
    return (f"c{i}", rng.randrange(2), "axis", rng.randrange(2), rng.choice("+-"), rng.choice([None, "", "m1", "m2"]), rng.choice([None, 20.0, 40.0, 41.0, 90.0]), rng.choice([None, 4.0, 5.0, 6.5]),
            low, None if low is None else low + rng.uniform(0, wide / 5), rng.choice([None, "OAV", "concentration"]), rng.choice([None, "ug/kg"]), rng.choice([0.2, 0.5, 1.0]))


def contradicts(a, b):
    (i, *_, p, m, t, h, low, high, q, u, _), (j, *_, p2, m2, t2, h2, low2, high2, q2, u2, _) = a, b
    if i == j or (m and m2 and m != m2) or (t is not None and t2 is not None and abs(t - t2) > 20) or (h is not None and h2 is not None and abs(h - h2) > 1):
        return False
    apart = (q, u) == (q2, u2) and None not in (low, low2) and (high * 1.1 < low2 * 0.9 or high2 * 1.1 < low * 0.9)
    return p != p2 or apart


@pytest.mark.parametrize(("wide", "coarse"), [(1.0, False), (1000.0, False), (100.0, True)])
def test_oppositions_equal_pairs(spark, wide, coarse):
    from lumenary.operators.claims import conflict_pairs, oppositions

    rng = random.Random(int(wide))
    rows = [claim(rng, i, wide, coarse) for i in range(140 if coarse else 240)]
    rows += [(rows[0][0], *rows[0][1:4], "+" if rows[0][4] == "-" else "-", *rows[0][5:])]  # an id that repeats
    df = spark.createDataFrame(rows, "claim_id string, subject int, axis string, object int, polarity string, matrix string, temp_c double, ph double, low double, high double, quantity string, unit string, base double")
    want = {}
    for a in rows:
        s = sum(b[-1] for b in rows if b[1:4] == a[1:4] and contradicts(a, b))
        if s:
            want[a[0]] = s
    got = {r.claim_id: r.opposition for r in oppositions(df).collect()}
    unique = {i for i, *_ in rows} - {rows[0][0]}
    assert {i: pytest.approx(got[i]) for i in unique if i in got} == {i: want[i] for i in unique if i in want}
    pairs = {(r.claim_a, r.claim_b) for r in conflict_pairs(df).where("kind = 'contradiction'").collect()}
    assert pairs == {(a[0], b[0]) for a in rows for b in rows if a[1:4] == b[1:4] and a[0] < b[0] and contradicts(a, b)}
    assert oppositions(df, guard=10).count() == 0


def test_pathway_claims_keep_repeats_apart(spark):
    """Entries listed twice or under several numbers claim once; claims of the others are neither shuffled nor aggregated."""
    from lumenary.operators.claims import pathway_claims

    entry = "entry_no long, cas_number string, likely_process string, cooked_meats_reported string, odor_threshold string"
    known = spark.createDataFrame([(1, "1-1"), (1, "2-2"), (2, "1-1"), (2, "1-1"), (3, None)], "id long, cas string")
    plain = spark.createDataFrame([(7, " 1-1", "Both", None, "1"), (7, "1-1", "Both", None, "1"), (8, "2-2", "Maillard", "", "")], entry)
    got = pathway_claims(plain, known)
    ids = ["C-mvl-7-1-lipid oxidation", "C-mvl-7-1-maillard reaction", "C-mvl-7-2-lipid oxidation", "C-mvl-7-2-maillard reaction", "C-mvl-8-1-maillard reaction"]
    assert sorted(r.claim_id for r in got.collect()) == ids
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    moved = spark.createDataFrame([(7, "1-1", "Maillard", None, "1"), (7, "2-2", "Maillard", None, "1"), (8, "2-2", "Maillard", "", "")], entry)
    assert sorted(r.claim_id for r in pathway_claims(moved, known).collect()) == ["C-mvl-7-1-maillard reaction", "C-mvl-7-2-maillard reaction", "C-mvl-8-1-maillard reaction"]


def test_or_join_holds_no_pairs(spark):
    from lumenary.operators.browse import or_join

    ref = spark.createDataFrame([(1, "A", "1-1"), (2, None, "1-1"), (3, "b", None), (4, None, None)], "entry_no long, compound string, cas_number string")
    got = or_join(ref, spark.createDataFrame([(10, "a", "1-1"), (11, "B", "1-1"), (12, None, "1-1"), (13, "b", None)], "id long, name string, cas string"))
    assert sorted(map(tuple, got.collect())) == [(1, 10, "exact_name"), (1, 11, "cas_match"), (1, 12, "cas_match"), (2, 10, "cas_match"), (2, 11, "cas_match"), (2, 12, "cas_match"), (3, 11, "exact_name"), (3, 13, "exact_name")]
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_reported_claims_partitions_grow(spark):
    from lumenary.operators.claims import reported_claims

    links = lambda *x: spark.createDataFrame(x, "source_id long, molecule_id long")
    got = reported_claims(links((3, 4), *[(1, 2)] * 39), links((1, 2), (5, 6), (5, 6)), each=1)
    assert sorted((r.claim_id, r.provenance) for r in got.collect()) == [("B-1-2", "curated"), ("B-3-4", "curated"), ("B-5-6", "mined")]
    assert got.rdd.getNumPartitions() == 40
