"""The pipeline over the smallest tables and over odd rows."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from .frames import SCHEMA, frame, odd_rows
from .test_operators import ALNUM, SPACE, low


def test_stages(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "bpe"]
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema)
        assert docs.columns == columns, name
        assert docs.count() <= before
        before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert {"doc_id", "n_tokens", "ids"} <= set(last.columns) and last.count() == before
    joined = last.join(docs, "doc_id").where(F.sha2("text", 256) != F.col("decoded_sha256"))
    assert joined.count() == 0


def test_odd_rows(spark, data):
    import corpus_pipeline

    docs = frame(spark, odd_rows(), SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == docs.count() > 0
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0


def test_near_copies_of_five_words(spark, data):
    import corpus_pipeline

    # Two separate words of a hundred are others: similarity 86/106 of five-word shingles, 92/104 of three-word ones.
    text = [f"w{i}" for i in range(100)]
    near = [f"x{i}" if i in (30, 70) else w for i, w in enumerate(text)]
    far = [f"x{i}" if i in (20, 50, 80) else w for i, w in enumerate(text)]
    docs = frame(spark, [(1, " ".join(text)), (2, " ".join(near)), (3, " ".join(far))])
    assert sorted(r.doc_id for r in corpus_pipeline.jaccard_join(spark, docs, data).collect()) == [1, 3]


def chain(spark, docs, data):
    """What each stage gets and gives."""
    import corpus_pipeline

    out = []
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = stage(spark, docs, data)
        if name != "bpe":
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append((name, given, docs))
    return out


def test_stages_against_brute_force(spark, data):
    """The run gives what its stages give one after the other, and each stage what its rule says of its own input."""
    import corpus_pipeline
    import public_tokenizers
    from lumenary.llm.bpe import _encoder
    from lumenary.llm.toxicity import THRESHOLD, fit, score_toxicity

    docs = spark.read.parquet(f"{data}/documents.parquet")
    copies = docs.where("doc_id % 10 = 3").withColumn("doc_id", F.col("doc_id") + 5000).withColumn("text", F.concat("text", F.lit(" end")))
    item = spark.read.parquet(f"{data}/benchmark.parquet").where("length(text) > 150").orderBy("item_id").first().text
    lines = docs.where("doc_id < 6").withColumn("doc_id", F.col("doc_id") + 7000).withColumn("text", F.concat(F.lit("A line that very many documents share\n"), "text"))
    planted = docs.where("doc_id = 1").withColumn("doc_id", F.lit(8000).cast("long")).withColumn("text", F.lit(f"before {item} after"))
    steps = {name: (given.collect(), out.collect()) for name, given, out in chain(spark, docs.unionByName(copies).unionByName(lines).unionByName(planted), data)}
    ids = lambda rows: sorted(r.doc_id for r in rows)

    given, out = steps["toxicity"]
    frame_ = spark.createDataFrame(given, docs.schema)
    model = fit(frame_, spark.read.parquet(f"{data}/labels.parquet"))
    assert ids(out) == sorted(r.doc_id for r in score_toxicity(frame_, model).collect() if r.score < THRESHOLD)

    given, out = steps["line_dedup"]
    key = lambda line: low(line.strip(" \t\n\r\x0b\x0c"))
    held = defaultdict(set)
    for r in given:
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(r.doc_id)
    gone = lambda line, i: len(held[key(line)]) >= 3 and max(held[key(line)]) != i
    assert {r.doc_id: r.text for r in out} == {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if not gone(x, r.doc_id)) for r in given}
    assert any(gone(x, r.doc_id) for r in given for x in (r.text or "").split("\n"))

    given, out = steps["jaccard_join"]
    sets = {}
    for r in given:
        w = re.findall(SPACE, low(r.text))
        sets[r.doc_id] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in links:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert ids(out) == sorted(i for i in sets if label[i] == i) and links

    given, out = steps["decontamination"]
    words_of = lambda t: re.findall(ALNUM, low(t))
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = words_of(r.text)
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[n].add(tuple(w[a : a + n]))
    clean = []
    for r in given:
        w = words_of(r.text)
        hit = {b for n, known in windows.items() for a in range(len(w) - n + 1) if tuple(w[a : a + n]) in known for b in range(a, a + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(r.doc_id)
    assert ids(out) == sorted(clean) and len(clean) < len(given)

    given, out = steps["bpe"]
    encode = _encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary
    assert {r.doc_id: (r.n_tokens, r.ids, r.decoded_sha256) for r in out} == {r.doc_id: (len(encode(r.text or "")), encode(r.text or ""), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in given}

    run = corpus_pipeline.run(spark, data).collect()
    last = chain(spark, docs, data)[-1][2].collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids, r.decoded_sha256) for r in run) == sorted((r.doc_id, r.n_tokens, r.ids, r.decoded_sha256) for r in last)
