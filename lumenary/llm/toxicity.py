"""Toxicity by maximum-scoring segments.

Each word stands for itself and for its beginnings of 3 to 8 characters, so that inflected forms share their stem. These
keys are counted by document and class over labelled rows; log-odds with a Dirichlet prior (the pooled counts) give each key
a weight and a standard error, and keys well above zero form a lexicon. A text is scanned once: a word scores its best
key's log-odds, any other word a small negative constant, and the linear-time search for all maximal scoring segments finds
every passage that stands out. Extreme-value statistics turn a segment's score S in n words into an expected number of
chance segments E = K n exp(-lambda S); the evidence of a text is the sum of -log E over its significant segments, and a
logistic curve fitted on the labelled rows makes it a probability.

The fit is bounded: at most about `FIT_ROWS` labelled rows, picked by hash; the lexicon is as large as they make it. Texts, languages, sources
and ids are not looked up in anything but the text. The scan covers whole texts, without a shuffle.

Defined results: a null or empty text has no evidence and gets the base score; a null doc_id gets a score and counts as
not held out; rows that repeat keep a row each, labels that repeat count once (toxic if any says so); with no labels, or
one class only, every text gets the smoothed share of toxic labels; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrays import BYTE_CODES, U64, alnum_words, blocks, fold, hash_spans, mix, pieces, powers, string_parts
from .runtime import NULL_ID, checkpointed, quoted, small_batches, table

FIT_ROWS = 20_000
#: Lengths in characters of the beginnings of words that count as keys; whole words of any length are keys too.
STEM = (3, 8)
#: Weight of the prior in documents, least z and least log-odds of a key (neither depends on how many rows are toxic), and
#: least number of toxic documents that hold it, also as a share of all toxic ones.
PRIOR_DOCS, LEAST_Z, LEAST_DELTA, LEAST_DOCS, LEAST_SHARE = 10.0, 2.5, 3.6, 6, 0.01
THRESHOLD = 0.3
BATCH_BYTES = 2 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Lexicon keys in order with their scores, the score of any other word, lambda and K, and the logistic curve."""

    keys: np.ndarray
    scores: np.ndarray
    other: float
    lam: float
    k: float
    intercept: float
    slope: float

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        return sum(max(0.0, self.lam * s - math.log(self.k * max(n, 1))) for _, _, s in segments)

    def probability(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * x))))


def maximal_segments(places: list[int], scores: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a text whose words at `places` score `scores`, all others `other`."""
    held: list[tuple[float, float, int, int]] = []
    total, last = 0.0, -1
    for place, score in zip(places, scores, strict=True):
        total += other * (place - last - 1)
        left, right, start = total, total + score, place
        total, last = right, place
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= left:
                j -= 1
            if j < 0 or held[j][1] >= right:
                held.append((left, right, start, place + 1))
                break
            left, start = held[j][0], held[j][2]
            del held[j:]
    return [(start, end, right - left) for left, right, start, end in held]


def word_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, keys): beginnings of STEM characters that end on a character, by length in bytes, and all whole words."""
    size = end - start
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    if len(start):
        # Characters begin with any byte but a continuation.
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        whole = np.flatnonzero(chars[end] - chars[start] >= 2)
        yield whole, mix(hash_spans(data, start, end)[whole] ^ U64(1000))
    word = np.arange(len(start))
    total, chars = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64)
    for j in range(1, 4 * STEM[1] + 1):
        alive = (size[word] >= j) & (chars <= STEM[1])
        if not alive.all():
            word, total, chars = word[alive], total[alive], chars[alive]
        if not len(word):
            return
        byte = padded[start[word] + j - 1]
        total = total + BYTE_CODES[byte] * powers(4 * STEM[1] + 1)[j]
        chars = chars + ((byte & 0xC0) != 0x80)
        ends = (size[word] == j) | ((padded[np.minimum(start[word] + j, len(data))] & 0xC0) != 0x80)
        stem = (chars >= STEM[0]) & (chars <= STEM[1]) & ends
        yield word[stem], mix(total[stem] + U64(j))


def scan_batch(model: Model, texts: pa.Array) -> list[tuple[int, list[tuple[int, int, float]]]]:
    """Number of words and maximal segments of each text."""
    data, offsets = string_parts(texts)
    start, end, first = alnum_words(data, offsets)
    counts = np.diff(first).tolist()
    found: list[list[tuple[int, int, float]]] = [[] for _ in counts]
    if len(model.keys) and len(start):
        best = np.zeros(len(start))
        for word, key in word_keys(fold(data), start, end):
            at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
            same = model.keys[at] == key
            word = word[same]
            best[word] = np.maximum(best[word], model.scores[at[same]])
        hit = np.flatnonzero(best)
        border = np.searchsorted(hit, first)
        for i in np.flatnonzero(np.diff(border)).tolist():
            own = hit[border[i] : border[i + 1]]
            found[i] = maximal_segments((own - first[i]).tolist(), best[own].tolist(), model.other)
    return list(zip(counts, found, strict=True))


def _key_counts(only_toxic: bool, known: np.ndarray | None):
    """(key, toxic, clean): documents of each batch that hold a key, of all keys of toxic texts or of the known ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if only_toxic:
                batch = batch.filter(pc.equal(batch.column("toxic"), 1))
            for piece in pieces(batch, BATCH_BYTES // 2):
                texts = piece.column("text").fill_null("")
                toxic = piece.column("toxic").to_numpy(zero_copy_only=False) == 1
                data, offsets = string_parts(texts)
                start, end, first = alnum_words(data, offsets)
                text = np.repeat(np.arange(len(texts)), np.diff(first))
                own, keys = [], []
                for word, key in word_keys(fold(data), start, end):
                    if known is not None:
                        held = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                        word, key = word[held], key[held]
                    own.append(text[word])
                    keys.append(key)
                if not keys or not sum(map(len, keys)):
                    continue
                own, keys = np.concatenate(own), np.concatenate(keys)
                order = np.lexsort((own, keys))
                own, keys = own[order], keys[order]
                once = np.concatenate([[True], (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])])
                own, keys = own[once], keys[once]
                at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                bad = np.add.reduceat(toxic[own].astype(np.int64), at)
                every = np.diff(np.concatenate([at, [len(keys)]]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(bad), pa.array(every - bad)], names=["key", "toxic", "clean"])
    return run


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text and toxic of a bounded, hash-chosen sample of the rows from which labels may be learned."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, rows / max(1, known.count()))
    # A hash of 62 bits, so that the share is met however many labels there are.
    picked = checkpointed(known.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 2) < F.lit(int(share * 2**62))))
    # About FIT_ROWS rows of 16 bytes: a bound that does not move with the data.
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")


def log_odds(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """delta and z of each key: log-odds ratio under a Dirichlet prior in proportion to the pooled counts."""
    alpha = (F.col("toxic") + F.col("clean")) * (PRIOR_DOCS / max(1, n_toxic + n_clean))
    side = lambda y, n: F.log((F.col(y) + alpha) / (n + PRIOR_DOCS - F.col(y) - alpha))
    scored = counts.withColumn("delta", side("toxic", n_toxic) - side("clean", n_clean))
    return scored.withColumn("z", F.col("delta") / F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("clean") + alpha)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    train = checkpointed(training_rows(small_batches(docs), labels, rows))
    size = {r["toxic"] == 1: r["count"] for r in train.groupBy((F.col("toxic") == 1).alias("toxic")).count().collect()}
    n_toxic, n_clean = size.get(True, 0), size.get(False, 0)
    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * n_toxic))
    counts = "key long, toxic long, clean long"
    known = []
    if n_toxic and n_clean:
        # Keys that enough toxic texts hold, then their counts in all training texts: both bounded by the sample.
        often = train.mapInArrow(_key_counts(True, None), counts).groupBy("key").agg(F.sum("toxic").alias("toxic")).where(F.col("toxic") >= least)
        keys = np.sort(often.select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64))
        if len(keys):
            both = train.mapInArrow(_key_counts(False, keys), counts).groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            known = log_odds(both, n_toxic, n_clean).where((F.col("z") >= LEAST_Z) & (F.col("delta") >= LEAST_DELTA)).select("key", "delta").collect()
    keys = np.array([r["key"] for r in known], np.int64).view(np.uint64)
    order = np.argsort(keys)
    scores = np.array([r["delta"] for r in known], float)
    return _calibrate(Model(keys[order], scores[order], -1e-3, 1.0, 1.0, 0.0, 1.0), train)


def _lambda(score: float, chance: float, other: float) -> float:
    """The positive root of sum p exp(lambda s) = 1 over the words of clean texts."""
    low, high = 1e-3, 4.0
    for _ in range(60):
        mid = (low + high) / 2
        value = chance * math.exp(mid * score) + (1 - chance) * math.exp(mid * other) - 1
        low, high = (mid, high) if value < 0 else (low, mid)
    return low


def _segments(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, BATCH_BYTES)):
            rows = scan_batch(model, batch.column("text").fill_null(""))
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array([n for n, _ in rows], pa.int64()), pa.array([[s[2] for s in found] for _, found in rows], pa.list_(pa.float64()))], names=["toxic", "n", "scores"])
    return run


def _calibrate(model: Model, train: DataFrame) -> Model:
    """The score of other words, lambda and K from what clean texts hold by chance; then the logistic curve over the evidence."""
    look = lambda m: train.mapInArrow(_segments(m), "toxic int, n long, scores array<double>").toPandas()  # noqa: E731  the bounded sample
    # With other words at 0 a segment's score is the sum of its words, which gives the share of lexicon words by class.
    rows = look(Model(model.keys, model.scores, 0.0, 1.0, 1.0, 0.0, 1.0))
    if not len(rows):
        return Model(model.keys, model.scores, model.other, model.lam, model.k, math.log(0.05 / 0.95), 0.0)
    toxic = rows["toxic"].to_numpy() == 1
    score = float(model.scores.mean()) if len(model.scores) else 1.0
    hits = rows["scores"].map(lambda found: sum(found) / score).to_numpy(float)
    words = rows["n"].to_numpy(float)
    share = lambda side: min(0.5, (hits[side].sum() + 0.5) / (words[side].sum() + 1))
    other = min(-1e-3, math.log((1 - share(toxic)) / (1 - share(~toxic))))
    lam = _lambda(score, share(~toxic), other)
    model = Model(model.keys, model.scores, other, lam, 1.0, 0.0, 1.0)
    rows = look(model)
    toxic = rows["toxic"].to_numpy() == 1
    least = float(model.scores.min()) if len(model.scores) else 1.0
    chance = sum(sum(s >= least for s in found) for found in rows["scores"][~toxic])
    k = (chance + 0.5) * math.exp(lam * least) / max(1, int(rows["n"][~toxic].sum()))
    model = Model(model.keys, model.scores, other, lam, k, 0.0, 1.0)
    x = np.array([model.evidence(n, [(0, 0, s) for s in found]) for n, found in zip(rows["n"], rows["scores"], strict=True)])
    a, b = logistic(x, toxic)
    return Model(model.keys, model.scores, other, lam, k, a, b)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Intercept and slope (0 at least) of a logistic curve with a small ridge.

    x is measured in its mean over the positive rows, and Newton steps are halved until they lower the loss, so the fit ends
    well where the two sides hardly overlap, however large x is. With one side only the curve is its smoothed share.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    a, b = math.log(share / (1 - share)), 0.0
    scale = float(x[y].mean()) if y.any() else 0.0
    if y.all() or scale <= 0:
        return a, b
    z = x / scale

    def loss(a: float, b: float) -> float:
        t = a + b * z
        return float((np.logaddexp(0, t) - y * t).sum() + ridge * b * b / 2)

    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a + b * z, -500, 500)))
        w = np.maximum(p * (1 - p), 1e-12)
        g = np.array([(y - p).sum(), ((y - p) * z).sum() - ridge * b])
        step = np.linalg.solve(np.array([[w.sum() + 1e-6, (w * z).sum()], [(w * z).sum(), (w * z * z).sum() + ridge]]), g)
        rate, now = 1.0, loss(a, b)
        while rate > 1e-6 and loss(a + rate * step[0], b + rate * step[1]) > now:
            rate /= 2
        a, b = a + rate * step[0], b + rate * step[1]
        if rate * abs(step).max() < 1e-6:
            break
    return float(a), max(0.0, float(b) / scale)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts in blocks(batches, BATCH_BYTES):
            rows = scan_batch(model, texts)
            spans = [[{"start": s, "end": e, "score": v} for s, e, v in found] for _, found in rows]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, mask=ids == NULL_ID), pa.array([model.probability(model.evidence(n, found)) for n, found in rows], pa.float64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))], names=["doc_id", "score", "passages"])
    return run


def _clean(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, BATCH_BYTES)):
            rows = scan_batch(model, batch.column("text").fill_null(""))
            clean = pa.array([model.probability(model.evidence(n, found)) < threshold for n, found in rows], pa.bool_())
            yield batch.select(["whole"]).filter(clean)
    return run


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the toxic passages (in words) of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), "doc_id long, score double, passages array<struct<start:bigint,end:bigint,score:double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score below the threshold, with all their columns."""
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("whole"), F.col("text").cast("string").alias("text"))
    clean = whole.mapInArrow(_clean(fit(docs, labels), threshold), StructType([whole.schema["whole"]]))
    return clean.select(*[F.col(f"whole.{quoted(c)}").alias(c) for c in docs.columns])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
