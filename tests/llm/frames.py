"""Small frames: odd rows that every operator must take, and texts with planted copies."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, block string, others int, region string, start int, kept string, `a.b` int, n_lines int, n_dropped string, dropped int, whole int, row_hash int, gone int, bad_id long, bad_hash long, node int, size int, hits int, items int, line_key int, keeper int, toxic int, score int, part int, contaminated int, n_words int, found int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_rows():
    """Null ids and texts, empty and blank texts, repeated rows, equal ids, a very long text, odd characters, clashing columns."""
    rng = random.Random(5)
    long = " ".join(words(rng, 30_000))
    copied = " ".join(words(rng, 60))
    other = " ".join(words(rng, 30, 10**6))
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, copied), (6, copied), (6, copied), (7, copied.upper()), (8, f"é ß {copied} ñ x"), (9, "a"), (10, "a b"), (11, "A B"), (12, "a b c"),
             (13, f"first\n{copied}\nlast"), (13, "another text of the same id"), (None, copied), (None, None), (14, "\n\n"), (15, "x" * 50_000), (16, "don't  stop\r\nnow\x0b\x0c 12345"), (17, "the\n" * 300), (18, "a b a b a b a b a b " * 30),
             (19, f"q r s {other}"), (19, f"z {other}"), (19, f"y {other}")]
    return [(i, t, None if n % 3 == 0 else "en", f"src{n}", len(t or ""), n, "b", n, None, n, "kept", n, n, "x", *[n] * 18) for n, (i, t) in enumerate(texts)]


def planted(n=120, seed=3):
    """Documents that share passages, near copies of some, exact copies of others."""
    rng = random.Random(seed)
    passages = [words(rng, 45) for _ in range(4)]
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.25 and out:
            w = out[rng.randrange(len(out))].split(" ")
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(w))
        elif kind < 0.5:
            w = words(rng, rng.randrange(5, 90))
            at = rng.randrange(len(w))
            out.append(" ".join(w[:at] + passages[rng.randrange(4)] + w[at:]))
        else:
            out.append(" ".join(words(rng, rng.randrange(1, 150))))
    return [(i, t) for i, t in enumerate(out)]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)
