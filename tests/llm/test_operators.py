"""Operators against brute force on small frames, and on rows that are odd in every way."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from .frames import SCHEMA, frame, odd_rows, planted, words

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(t):
    return hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


FRAMES = {"odd": (odd_rows(), SCHEMA), "planted": (planted(), "doc_id long, text string"), "empty": ([], SCHEMA)}


@pytest.fixture(params=list(FRAMES))
def docs(request, spark):
    rows, schema = FRAMES[request.param]
    return frame(spark, rows, schema), [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("group_bytes", [4 << 20, 3000, 300])
def test_op1(docs, group_bytes):
    from lumenary.llm.substrings import remove_repeats

    df, rows = docs
    key = lambda i: -(2**63) if i is None else i
    first = {}
    split = [(key(i), re.findall(SPACE, t or "")) for i, t in rows]
    for i, w in split:
        for a in range(len(w) - 19):
            s = tuple(w[a : a + 20])
            first[s] = min(first.get(s, (i, a)), (i, a))
    want = Counter()
    for (i, w), (doc_id, _) in zip(split, rows, strict=True):
        gone = set()
        for a in range(len(w) - 19):
            if first[tuple(w[a : a + 20])] < (i, a):
                gone |= set(range(a, a + 20))
        want[doc_id, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    assert rows_of(remove_repeats(df, digests=True, group_bytes=group_bytes)) == want
    for n in (1, 4):
        assert rows_of(remove_repeats(df.repartition(n), digests=True, group_bytes=group_bytes)) == want
    full = remove_repeats(df, group_bytes=group_bytes).withColumn("sha", F.sha2("text", 256))
    assert rows_of(full.select("doc_id", "n_words", "n_removed", "sha")) == want
    assert all(sum(e - s for s, e in r.removed) == r.n_removed for r in full.collect())


def test_op1_suffix_array():
    import numpy as np
    from lumenary.llm.substrings import equal_windows, suffix_array

    rng = random.Random(13)
    for vocabulary in (1, 2, 5, 3_000_000):
        codes = [rng.randrange(vocabulary) for _ in range(400)]
        codes[200:260] = codes[20:80]
        at = sorted(rng.sample(range(375), 200))
        order, common = suffix_array(np.array(codes), np.array(at), 25, (np.array(at),))
        suffixes = [codes[i : i + 25] for i in at]
        assert order.tolist() == sorted(range(len(at)), key=lambda k: (suffixes[k], at[k]))
        for x, y, n in zip(order, order[1:], common[1:], strict=False):
            assert n == next((j for j in range(25) if suffixes[x][j] != suffixes[y][j]), 25)
        # Hashes that are all equal bring everything together; words decide.
        groups = equal_windows(np.array(codes), np.array(at), np.zeros(len(at), np.uint64), 25)
        assert all((groups[i] == groups[j]) == (suffixes[i] == suffixes[j]) for i in range(200) for j in range(200))


def test_op2(docs):
    from lumenary.llm.lines import dedup_lines

    df, rows = docs
    strip = " \t\n\r\x0b\x0c"
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = low(line.strip(strip))
            if len(k) >= 20:
                held[k].add(i)
    keep = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= 3}
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if low(x.strip(strip)) not in keep or keep[low(x.strip(strip))] == i]
        want[i, len(lines), len(lines) - len(left), sha("\n".join(left))] += 1
    out = dedup_lines(df)
    assert set(df.columns) <= set(out.columns)
    assert rows_of(out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256))) == want


def test_op2_drops_common_lines(spark):
    from lumenary.llm.lines import dedup_lines

    common = "This line stands in very many texts"
    out = {r.doc_id: r.text for r in dedup_lines(frame(spark, [(i, f"own {i}\n  {common.upper() if i % 2 else common}\t\nshort") for i in range(5)])).collect()}
    assert out[4] == f"own 4\n  {common}\t\nshort" and all(out[i] == f"own {i}\nshort" for i in range(4))


def test_op4(docs):
    import public_tokenizers as P
    from lumenary.llm.bpe import _encoder, encode_documents

    df, rows = docs
    path = P.path("byte_bpe_50k.tiktoken")
    encode = _encoder(path, P.PATTERN).encode_ordinary
    want = Counter()
    for i, t in rows:
        ids = encode(t or "")
        want[i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t or "")] += 1
    assert rows_of(encode_documents(df, path, P.PATTERN, digests=True)) == want
    full = encode_documents(df, path, P.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in full) == Counter((i, (t or "").encode()) for i, t in rows)


@pytest.mark.parametrize("text", ["  two  spaces\n\n\tand tabs ", "it's we'll I'M don’t", "日本語 Ελλάδα 😀😀 ½ ²", "a b c\u0085d\x1ce\x1df", "x" * 3000, "'s 's''ve"])
def test_op4_splits_like_the_library(spark, text):
    import public_tokenizers as P
    from lumenary.llm.bpe import _encoder, encode_documents

    path = P.path("byte_bpe_50k.tiktoken")
    assert encode_documents(frame(spark, [(1, text)]), path, P.PATTERN).first().ids == _encoder(path, P.PATTERN).encode_ordinary(text)


BASE = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")]


def base_spans(t):
    out = []
    for k, (kind, rx) in enumerate(BASE):
        for m in re.finditer(rx, t or ""):
            if (len(m[2]) >= 6) if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                out.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


SECRETS = [(1, "PassWord = 'abcdefgh' token:abc secret: token: abcdefgh AKIA" + "Q" * 16 + "!"), (2, "é😀 token=" + "f" * 40 + " " + "0123456789abcdef" * 2), (3, "client_id: bob7 then Zz9" + "a1B2" * 8 + " at https://db.example.com:5432/x"),
           (4, "alone Zz9" + "a1B2" * 8), (5, "api_key=xyz api-key=abcdefgh apikey=\"q1w2e3r4\""), (5, "api_key=xyz api-key=abcdefgh apikey=\"q1w2e3r4\""), (6, None), (7, ""), (None, "secret=topsecret1"), (8, "login: carl " + "pad " * 100 + "postgres://h.example.org")]


def test_op5(spark, docs):
    from lumenary.llm.secrets import scan_secrets

    for df, rows in (docs, (frame(spark, SECRETS), SECRETS)):
        got = scan_secrets(df).collect()
        assert Counter((r.doc_id, r.base) for r in got) == Counter((i, ",".join(base_spans(t))) for i, t in rows)
        for r in got:
            spans = r.spans.split(",") if r.spans else []
            assert set(filter(None, r.base.split(","))) <= set(spans)
            assert r.n_assign == sum(s.startswith("assign") for s in spans)


def brute_credentials(t, reach=200):
    """All spans of a text: strong ones, and weak ones with what completes them near by."""
    from lumenary.llm.secrets import KINDS

    parts = []
    for kind, order, role, rx, group, least, strong in KINDS:
        parts += [(m.start(), order, m.end(), kind, role, strong) for m in re.finditer(rx, t or "") if len(m[group]) >= least]
    near = lambda p, role: any(q[4] == role and max(p[0], q[0]) - min(p[2], q[2]) <= reach for q in parts)
    needs = {"identity": ("secret",), "secret": ("identity",), "endpoint": ("identity", "secret")}
    return ",".join(f"{p[3]}:{p[0]}:{p[2]}" for p in sorted(parts) if p[5] or all(near(p, role) for role in needs[p[4]]))


def test_op5_spans_against_brute_force(spark):
    from lumenary.llm.secrets import link_credentials, scan_secrets

    rng = random.Random(17)
    pieces = ["client_id: bob{n}", "AKIA" + "Q" * 16, "password = hunter{n}xx", "Zz{n}" + "a1B2" * 8, "https://db.example.com:5432/x", "postgres://h{n}.example.org", "f" * 30, "login=carl", "user_name: x", "plain words here", "é😀"]
    rows = [(i, " ".join(rng.choice(pieces).replace("{n}", str(rng.randrange(9))) + " " + "pad " * rng.choice([0, 1, 30, 60]) for _ in range(rng.randrange(1, 9)))) for i in range(150)]
    df = frame(spark, rows)
    assert {r.doc_id: r.spans for r in scan_secrets(df).collect()} == {i: brute_credentials(t) for i, t in rows}
    # Each secret's credential: its nearest identity within reach, and the nearest endpoint of the pair if there is one.
    for r in link_credentials(df).collect():
        assert r.identity is not None and r.secret is not None
        assert max(r.identity.start, r.secret.start) - min(r.identity.end, r.secret.end) <= 200


def test_op5_a_web_address_completes_nothing(spark):
    from lumenary.llm.secrets import scan_secrets

    got = scan_secrets(frame(spark, [(1, "see https://example.com/ Zz9" + "a1B2" * 8)])).first()
    assert got.spans == ""


def test_op5_weak_parts_need_a_complement(spark):
    from lumenary.llm.secrets import scan_secrets

    got = {r.doc_id: r.spans for r in scan_secrets(frame(spark, [r for r in SECRETS if r[0] in (3, 4, 8)])).collect()}
    assert {s.split(":")[0] for s in got[3].split(",")} == {"ident", "opaque", "endpoint"}
    assert got[4] == "" and got[8] == ""


def test_op6(docs):
    from lumenary.llm.licenses import PHRASES, scan_licenses

    df, rows = docs
    want = Counter()
    for i, t in rows:
        w = re.findall(ALNUM, low(t))
        hits = [(a, label) for phrase, label in PHRASES.items() for a in range(len(w)) if w[a : a + len(phrase.split())] == phrase.split()]
        want[i, len(w), len(hits), min((a for a, _ in hits), default=None), max((a for a, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))] += 1
    assert rows_of(scan_licenses(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == want


def test_op6_labels_and_spans(spark):
    from lumenary.llm.licenses import TEMPLATES, scan_licenses

    rows = [(i, f"some words before {text} and after it") for i, text in enumerate(t for label in sorted(TEMPLATES) for t in TEMPLATES[label])]
    labels = [label for label in sorted(TEMPLATES) for _ in TEMPLATES[label]]
    rows += [(100, "All Rights\nreserved, under CC-BY!"), (101, "free of charge to any one of the people in the software house"), (102, "Permission is hereby granted, free of charge, to any human person obtaining a copy of this software")]
    got = {r.doc_id: r for r in scan_licenses(frame(spark, rows)).collect()}
    for i, label in enumerate(labels):
        assert label in got[i].labels.split(","), (label, got[i].labels)
        assert got[i].score >= 0.8
    assert got[100].base_labels == "cc-by,reserved" and got[101].labels == "" and got[102].labels == "mit"


def test_op6_notices_with_foreign_words(spark):
    from lumenary.llm.licenses import GAP, TEMPLATES, scan_licenses

    short = "This work is licensed under a {} Creative Commons Attribution 4.0 International License"
    long = {label: max(TEMPLATES[label], key=len).split() for label in ("apache-2.0", "bsd", "mit", "gpl")}
    rows = [(0, short.format("qqq")), (1, short.format("qqq " * GAP)), (2, short.format("qqq " * (GAP + 1)))]
    rows += [(10 + i, "before " + " ".join(f"{w} zz{j}" if j % 7 == 6 else w for j, w in enumerate(words_))) for i, words_ in enumerate(long.values())]
    # Two texts side by side are two texts.
    rows += [(20, "This work is licensed under a"), (21, "Creative Commons Attribution 4.0 International License")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert [got[i].labels for i in (0, 1, 2, 20, 21)] == ["cc-by", "cc-by", "", "", ""]
    assert got[0].score == 1 and [(s.start, s.end) for s in got[0].spans] == [(0, 14)]
    for i, label in enumerate(long):
        assert label in got[10 + i].labels.split(",") and got[10 + i].score >= 0.8, (label, got[10 + i].score)
        assert max((s.share for s in got[10 + i].spans if s.label == label)) >= 0.8


def test_op6_automaton():
    from lumenary.llm.licenses import SuffixAutomaton

    rng = random.Random(1)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(3)]
        a = SuffixAutomaton()
        for t in texts:
            a.add(t)
        known = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        query = [rng.randrange(4) for _ in range(30)]
        longest = [max((k for k in range(0, i + 2) if not k or tuple(query[i + 1 - k : i + 1]) in known), default=0) for i in range(len(query))]
        want = [(i + 1 - n, n) for i, n in enumerate(longest) if n >= 2 and (i + 1 == len(query) or longest[i + 1] <= n)]
        assert a.matches(query, 2) == want


def brute_contamination(rows, items):
    windows = defaultdict(set)
    for item, t in items:
        w = re.findall(ALNUM, low(t))
        m = min(13, len(w))
        for a in range(len(w) - m + 1) if w else ():
            windows[tuple(w[a : a + m])].add(item)
    out = Counter()
    for i, t in rows:
        w = re.findall(ALNUM, low(t))
        hit, found = set(), set()
        for m in {len(x) for x in windows}:
            for a in range(len(w) - m + 1):
                own = windows.get(tuple(w[a : a + m]))
                if own:
                    found |= own
                    hit |= set(range(a, a + m))
        out[i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


@pytest.mark.parametrize("partitions", [1, 5])
def test_op7(spark, docs, partitions):
    from lumenary.llm.decontaminate import contamination, drop_contaminated

    df, rows = docs
    long = [t for _, t in rows if t and len(t.split()) > 40]
    items = [(1, " ".join(long[0].split()[3:40])), (2, " ".join(long[1].split()[5:19])), (2, long[0][:90])] if long else []
    items += [(10, None), (11, ""), (12, "a b"), (13, "stop now"), (14, " ".join(f"w{i}" for i in range(40)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    bench = bench.repartition(partitions)
    got = contamination(df, bench)
    want = brute_contamination(rows, [(str(i), t) for i, t in items])
    assert rows_of(got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want
    kept = drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(n for r, n in want.items() if not r[-1])


def brute_quality(t):
    w = re.findall(SPACE, t or "")
    lines = [x for x in (t or "").split("\n") if re.search(SPACE, x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_op8_statistics(docs):
    from lumenary.llm.quality import text_statistics

    df, rows = docs
    got = text_statistics(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert rows_of(got) == Counter((i, *brute_quality(t)) for i, t in rows)


def test_op8_learns_rules(spark):
    from lumenary.llm.quality import quality_rules

    rng = random.Random(2)
    docs = [(i, " ".join(f"w{rng.randrange(900)}" + ("##" if i % 4 == 0 and rng.random() < 0.6 else "") for _ in range(120))) for i in range(400)] + [(None, "x"), (900, None)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), None) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality_rules(frame(spark, docs), labels).collect()}
    assert len(out) == 402
    assert all(out[i].kept == (i % 4 > 0) for i in range(300, 400))
    none = quality_rules(frame(spark, docs), labels.limit(0))
    assert none.where("rule > 0").count() == 0 and none.count() == 402
    assert quality_rules(frame(spark, []), labels).count() == 0


def test_op9(docs):
    from lumenary.llm.sharding import shard_documents

    df, rows = docs
    got = shard_documents(df).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for shard in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))


def test_op9_map_is_edited(spark, tmp_path):
    from lumenary.llm.sharding import first_map, load_map, rebalance, shard_documents

    sizes = {s: (s * 37) % 101 + 1 for s in range(512)}
    one = first_map(sizes, 512, 8)
    load = lambda rows, sizes: [sum(sizes[s] for _, s, x, _ in rows if x == shard) for shard in sorted({r[2] for r in rows})]
    assert max(load(one, sizes)) - min(load(one, sizes)) <= max(sizes.values())
    grown = {s: n * (3 if s % 50 == 0 else 1) for s, n in sizes.items()}
    two = rebalance(one, grown, 9)
    moved = sum(a[2] != b[2] for a, b in zip(one, two, strict=True))
    assert two[0][0] == 2 and 0 < moved < 512 / 4 and max(load(two, grown)) <= sum(grown.values()) / 9 * 1.02
    path = str(tmp_path / "map")
    df = frame(spark, planted())
    first = shard_documents(df, n_slots=64, map_path=path).collect()
    assert load_map(spark, path)[0][0] == 2 and len(load_map(spark, path, 1)) == 64
    assert [r[2] for r in load_map(spark, path, 1)] == [s % 16 for s in range(64)]
    # The stored number of slots holds, whatever is asked for, and all rows come out.
    again = shard_documents(df, n_slots=4096, map_path=path).collect()
    assert load_map(spark, path)[0][0] == 3 and len(load_map(spark, path)) == 64
    assert len(first) == len(again) == 120 and {r.doc_id: r.virtual_slot for r in first} == {r.doc_id: r.virtual_slot for r in again}
    version = {slot: shard for _, slot, shard, _ in load_map(spark, path)}
    assert all(r.shard == version[r.virtual_slot] and r.map_version == 3 for r in again)


def test_op9_version_is_stored_once(spark, tmp_path):
    from lumenary.llm.sharding import load_map, shard_documents, store_map

    path = str(tmp_path / "map")
    rows = [(1, s, s % 4, 0) for s in range(8)]
    store_map(spark, rows, path)
    with pytest.raises(FileExistsError):
        store_map(spark, [(1, s, 3, 0) for s in range(8)], path)
    assert load_map(spark, path) == rows
    got = shard_documents(frame(spark, planted(40)), n_shards=4, map_path=path).collect()
    assert sorted(r.doc_id for r in got) == list(range(40))
    store_map(spark, [(9, s, 0, 0) for s in (0, 1, 1, 3)], path)
    with pytest.raises(ValueError, match="one owner"):
        load_map(spark, path)


@pytest.mark.parametrize("parts", [1, 7])
def test_op9_equal_rows_spread(spark, parts):
    """Half of all rows equal: sizes within a hundredth, places gapless, slots of other rows as without them."""
    from lumenary.llm.sharding import shard_documents

    rows = [(i, "x" * 9) for i in range(3000)] + [(None, "same text")] * 3000
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    assert len(load) == 16 and max(load.values()) <= 1.01 * sum(load.values()) / 16
    for shard in load:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    alone = shard_documents(spark.createDataFrame(rows[:3000], "doc_id long, text string")).collect()
    assert {r.doc_id: r.virtual_slot for r in alone} == {r.doc_id: r.virtual_slot for r in got if r.doc_id is not None}


def test_op9_sizes_are_near_equal(spark):
    from lumenary.llm.sharding import op9_sharding

    got = op9_sharding(spark, "/root/testdata/sf0.01").collect()
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    mean = sum(load.values()) / 16
    assert len(load) == 16 and max(load.values()) <= mean * 1.01 + max(r["size"] for r in got) and min(load.values()) >= mean * 0.95 - max(r["size"] for r in got)
    assert {r.map_version for r in got} == {2}


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = re.findall(SPACE, low(t))
        sets.append((i, {tuple(w[a : a + 3]) for a in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 90 * len(s | t):
                x, y = sorted((find(i), find(j)), key=lambda v: (v is not None, v))
                parent[y] = x
    return Counter((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize("bound", [1 << 19, 1500])
def test_op10(docs, bound, monkeypatch):
    from lumenary.llm import jaccard

    monkeypatch.setattr(jaccard, "PART_SHINGLES", bound)
    df, rows = docs
    assert rows_of(jaccard.jaccard_components(df)) == brute_components(rows)


def test_op10_rows_with_equal_ids_are_one_node(spark):
    from lumenary.llm.jaccard import jaccard_components

    rng = random.Random(21)
    a, b = words(rng, 90, 5000), words(rng, 90, 5000)
    near = [*b[:40], "changed", *b[41:]]
    rows = [(3, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (9, " ".join(near)), (11, "else where it is"), (11, None)]
    got = rows_of(jaccard_components(frame(spark, rows)))
    assert got == brute_components(rows) and {c for i, _, c in got if i < 10} == {3}


def test_op10_near_copies(spark):
    from lumenary.llm.jaccard import jaccard_components, keep_one

    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w[: rng.randrange(330, 401)])))
    rows += [(1000 + i, " ".join(f"s{rng.randrange(30)}" for _ in range(rng.randrange(8, 14)))) for i in range(150)]
    want = brute_components(rows)
    df = frame(spark, rows)
    assert rows_of(jaccard_components(df)) == want
    assert {r.doc_id for r in keep_one(df).collect()} == {r[2] for r in want}


def brute_five_words(rows):
    sets = {i: {tuple(w[a : a + 5]) for a in range(max(len(w) - 4, 1))} for i, w in ((i, t.split()) for i, t in rows)}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = {i: x if g == y else g for i, g in group.items()}
    return Counter((i, len(s), group[i]) for i, s in sets.items())


@pytest.mark.parametrize("bound", [1 << 19, 3000])
def test_op10_with_other_shingles_and_similarity(spark, bound, monkeypatch):
    from lumenary.llm import jaccard

    monkeypatch.setattr(jaccard, "PART_SHINGLES", bound)
    rng = random.Random(12)
    rows = []
    for size in (4, 5, 6, 7, 9, 12, 20, 40, 90, 300):
        for _ in range(4):
            base = words(rng, size, 3000)
            for _ in range(6):
                w = base[: len(base) - rng.randrange(max(1, size // 8) + 1)]
                for _ in range(rng.randrange(max(1, size // 30) + 1)):
                    w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
                rows.append((len(rows), " ".join(w)))
    want = brute_five_words(rows)
    assert rows_of(jaccard.jaccard_components(frame(spark, rows), 5, 80, 100)) == want
    assert len({r[2] for r in want}) < len({r[2] for r in brute_components(rows)})


def families(rng, bases, members, size, edits):
    """Texts of near copies: `members` of each base, with up to `edits` words changed."""
    out = []
    for _ in range(bases):
        base = words(rng, size, 5000)
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("rule", [(3, 90, 100), (5, 80, 100)])
def test_op10_regions_hold_all_links_and_little_else(spark, rule):
    from lumenary.llm.jaccard import NEAR, SAME, coarse_links, regions

    rng = random.Random(10)
    common = words(rng, 120, 5000)
    rows = families(rng, 20, 6, 60, 3) + families(rng, 10, 4, 240, 9) + [(0, " ".join(common + words(rng, 80, 5000))) for _ in range(150)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    found = coarse_links(frame(spark, rows), *rule).cache()
    region = {r.node: r.region for r in regions(found).collect()}
    same = {r.u: r.v for r in found.where(found.kind == SAME).collect()}
    assert found.where(found.kind == NEAR).count()
    k, per, of = rule
    sets = {i: {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} for i, w in ((i, t.split()) for i, t in rows)}
    for i in sets:
        for j in range(i):
            if of * len(sets[i] & sets[j]) >= per * len(sets[i] | sets[j]):
                x, y = same.get(i, i), same.get(j, j)
                assert x == y or region[x] == region[y]
    # Texts that share most of their words, but not enough, stay apart.
    assert not any(i in region for i in range(160, len(rows)))


@pytest.mark.parametrize("kind", ["unrelated", "copies", "families"])
def test_op10_regions_are_divided_until_they_fit(spark, kind, monkeypatch):
    from lumenary.llm import jaccard

    bound = 40 * (198 + jaccard.DOC_SHINGLES)
    monkeypatch.setattr(jaccard, "PART_SHINGLES", bound)
    rng = random.Random(11)
    base = [words(rng, 200, 5000) for _ in range({"unrelated": 300, "copies": 1, "families": 12}[kind])]
    rows = []
    for i in range(300):
        w = list(base[i % len(base)])
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    held = frame(spark, [(i, t, 198, 7, True) for i, t in rows], "doc_id long, text string, size long, region long, home boolean")
    dealt, links = jaccard.bounded_regions(held)
    dealt = dealt.cache()
    most = dealt.groupBy("region", "part").count().agg(F.max("count")).first()[0]
    assert most is None or most <= 2 * 40
    group = {i: i for i, _ in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x
    known = {(r.u, r.v) for df in [*links, dealt.groupBy("region", "part").applyInArrow(jaccard._join_region(3, 90, 100), "u long, v long")] for r in df.collect()}
    for u, v in known:
        group[find(u)] = find(v)
    sets = {i: {tuple(w[a : a + 3]) for a in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in rows)}
    linked = {(a, b) for a in range(300) for b in range(300) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])}
    assert known <= linked
    assert all(find(a) == find(b) for a, b in linked)


def test_op3(spark):
    from lumenary.llm.toxicity import drop_toxic, fit, score_toxicity

    rng = random.Random(4)
    stems = ["grumb", "vilno"]
    docs, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 200))]
        if bad:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(stems) + f"{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad), 1))
    docs += [(None, None), (1001, ""), (1002, "clean"), (1003, "grumbzz vilnozz grumbqq"), (1003, "grumbzz vilnozz grumbqq")]
    known = spark.createDataFrame(labels + [(None, 1, 1), (7, None, 0)], "doc_id long, toxic int, quality int")
    df = frame(spark, docs)
    model = fit(df, known)
    out = score_toxicity(df, model).collect()
    assert len(out) == 605 and all(0 <= r.score <= 1 for r in out)
    held = [(r.score >= 0.3, r.doc_id % 6 == 0) for r in out if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(r.score >= 0.3 and r.passages for r in out if r.doc_id == 1003)
    kept = drop_toxic(frame(spark, odd_rows(), SCHEMA), known)
    assert kept.columns == frame(spark, [], SCHEMA).columns and kept.count() == len(odd_rows())
    assert score_toxicity(frame(spark, []), model).count() == 0
    none = fit(df, known.limit(0))
    assert score_toxicity(df, none).where("score >= 0.3").count() == 0


def test_op3_labels_of_the_held_out_rows_do_not_matter(spark):
    from lumenary.llm.toxicity import held_out, training_rows

    docs = frame(spark, [(i, f"t{i}") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    taken = {int(r.text[1:]) for r in training_rows(docs, labels).collect()}
    assert taken == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert docs.where(held_out(F.col("doc_id"))).count() == 200 - len(taken)


@pytest.mark.parametrize("scale", [0.01, 1.0, 500.0])
def test_op3_curve_of_sides_that_hardly_overlap(scale):
    import numpy as np
    from lumenary.llm.toxicity import logistic

    rng = np.random.default_rng(1)
    y = np.arange(3000) % 9 == 0
    for low in (0.0, 0.7):
        x = np.where(y, rng.uniform(low, 5, 3000), 0.2 * rng.uniform(0, 1, 3000)) * scale
        a, b = logistic(x, y)
        right = ((1 / (1 + np.exp(-(a + b * x))) >= 0.3) == y).mean()
        assert b > 0 and right >= 0.95
    assert logistic(np.zeros(10), np.zeros(10, bool))[1] == 0 and logistic(np.ones(10), np.ones(10, bool))[1] == 0


def test_op3_segments_are_maximal():
    from lumenary.llm.toxicity import maximal_segments

    rng = random.Random(6)

    def brute(x):  # cut out the best segment, then what is left on both sides
        best = max(((sum(x[i:j]), -(j - i), i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0,))
        if best[0] <= 1e-12:
            return []
        _, _, i, j = best
        return brute(x[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute(x[j:])]
    for _ in range(80):
        x = [rng.choice([2.0, 3.5, -1.0, -1.0, -1.0]) for _ in range(14)]
        places = [i for i, v in enumerate(x) if v > 0]
        got = [(a, b) for a, b, _ in maximal_segments(places, [x[i] for i in places], -1.0)]
        assert sum(sum(x[a:b]) for a, b in got) == pytest.approx(sum(sum(x[a:b]) for a, b in brute(x)))
