"""Ingest in batch order against the loop over rows."""

import random

import pytest


def accepted(batch, existing):
    """Each row in turn: kept unless one of its keys is known or was kept before."""
    seen = [{r[k] for r in existing if r[k]} for k in (1, 2)]
    out = set()
    for row in sorted(batch):
        if any(row[k] and row[k] in seen[k - 1] for k in (1, 2)):
            continue
        for k in (1, 2):
            if row[k]:
                seen[k - 1].add(row[k])
        out.add(row[0])
    return out


def test_ingest_keeps_what_a_fallen_row_does_not_block(spark):
    from lumenary.sources.files import ingest_new

    batch = spark.createDataFrame([(1, None, "e1"), (2, "d1", "e1"), (3, "d1", None)], "pos int, doi string, ext string")
    assert {r.pos for r in ingest_new(batch, batch.limit(0), ["doi", "ext"]).collect()} == {1, 3}


@pytest.mark.parametrize("seed", range(2))
def test_ingest_in_batch_order(spark, seed):
    from lumenary.sources.files import ingest_new

    rng = random.Random(seed)
    key = lambda p, n: rng.choice([None, ""]) if rng.random() < 0.2 else f"{p}{rng.randrange(n)}"
    rows = [(i, key("d", 40), key("e", 60), i) for i in range(120)] + [(500 + i, f"x{i // 2}", f"y{(i + 1) // 2}", i) for i in range(8)]  # a chain that blocks in turn
    known = [(-1, f"d{i}", f"e{i}", 0) for i in range(5)]
    schema = "pos int, doi string, ext string, other int"
    got = ingest_new(spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(known, schema), ["doi", "ext"])
    assert {r.pos for r in got.collect()} == accepted(rows, known) and got.columns == ["pos", "doi", "ext", "other"]


def test_publish(spark, tmp_path):
    """Of writers at one time one wins; equal rows are the same version, others and older versions are refused."""
    from concurrent.futures import ThreadPoolExecutor

    from lumenary.sources.files import VersionConflict, current, publish, published

    path = str(tmp_path / "p")
    df = lambda i: spark.createDataFrame([(i, "x")], "a int, b string")

    def write(i):
        try:
            return publish(df(i), path, 1)
        except VersionConflict:
            return "conflict"
    with ThreadPoolExecutor(4) as pool:
        told = list(pool.map(write, [1, 2, 1, 2]))
    assert told.count("published") == 1 and sorted(told) == ["conflict", "conflict", "published", "same"]
    won = current(spark, path).first().a
    assert publish(df(won), path, 1) == "same" and published(spark, path) == [1]
    assert publish(df(7), path, 3) == "published" and current(spark, path).first().a == 7
    with pytest.raises(VersionConflict):
        publish(df(9), path, 2)
    assert not [f for f in (tmp_path / "p").iterdir() if f.name.startswith("_new")]
    with pytest.raises(FileNotFoundError):
        current(spark, str(tmp_path / "none"))
