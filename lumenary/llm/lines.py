"""Line dedup: normalised lines are exploded and hashed, documents counted per hash, common lines dropped, texts reassembled.

Only hashes and positions are shuffled for the count (with partial aggregation, so a line that a third of all documents
share is one row per task); hashes over the threshold are written and meet the line rows in a merge join of two plain sorted
shuffles, whose skewed partitions Spark splits; positions to drop are gathered per document and the text is rebuilt by position.

Defined results: a null or empty text is one empty line; a null doc_id is a document of its own that sorts before all
others; rows with equal doc_id are one document in the count, and each keeps a row; a key is kept in all rows of the
largest doc_id; an empty table gives an empty result; other columns come through untouched, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .arrays import from_parts, pieces, ragged, starts_of, string_parts
from .runtime import checkpointed, quoted, small_batches, table

LEAST_CHARS, LEAST_DOCS = 20, 3
PIECE_BYTES = 4 << 20
_LINE = "doc_id long, row_hash long, place int, line_key binary"


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, row_hash, place, 128-bit hash of the key) of each line whose key is long enough."""
        for batch in (piece for whole in batches for piece in pieces(whole, PIECE_BYTES)):
            split = pc.split_pattern(batch.column("text").fill_null(""), "\n")
            keys = pc.ascii_lower(pc.ascii_trim_whitespace(split.flatten()))
            first = split.offsets.to_numpy().astype(np.int64)
            first = first - first[0]
            counts = np.diff(first)
            long_enough = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), least).to_numpy(zero_copy_only=False))
            text = np.repeat(np.arange(len(counts)), counts)[long_enough]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()).take(pa.array(text)), batch.column("row_hash").take(pa.array(text)), pa.array((long_enough - first[text]).astype(np.int32)),
                pa.array([xxhash.xxh3_128_digest(k) for k in keys.take(pa.array(long_enough)).cast(pa.large_binary()).to_pylist()], pa.binary())], names=["doc_id", "row_hash", "place", "line_key"])
    return run


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines at `dropped`."""
    for batch in (piece for whole in batches for piece in pieces(whole, PIECE_BYTES)):
        split = pc.split_pattern(batch.column("text").fill_null(""), "\n")
        data, offsets = string_parts(split.flatten())
        first = split.offsets.to_numpy().astype(np.int64)
        first = first - first[0]
        places = batch.column("dropped")
        counts = pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        keep = np.ones(len(offsets) - 1, bool)
        keep[np.repeat(first[:-1], counts) + places.flatten().to_numpy(zero_copy_only=False)] = False
        # Every kept line takes its bytes and a line feed; the last feed of each text is cut again.
        lengths = np.where(keep, np.diff(offsets) + 1, 0)
        out = np.full(int(lengths.sum()), 10, np.uint8)
        at = starts_of(lengths)
        out[ragged(at[:-1][keep], lengths[keep] - 1)] = data[ragged(offsets[:-1][keep], lengths[keep] - 1)]
        ends = at[first]
        some = np.diff(ends) > 0
        left = np.ones(len(out), bool)
        left[ends[1:][some] - 1] = False
        cols = {n: batch.column(n) for n in batch.schema.names if n not in ("text", "dropped")}
        cols["text"] = from_parts(out[left], starts_of(np.diff(ends) - some)).cast(pa.string())
        cols["n_lines"], cols["n_dropped"] = pa.array(np.diff(first)), pa.array(counts)
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def common_lines(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """line_key and keeper (the largest doc_id, null only if no other) of keys in at least `least_docs` documents."""
    per_doc = lines.select("line_key", "doc_id").distinct()
    return per_doc.groupBy("line_key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= least_docs).drop("n_docs")


def _deduplicated(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """whole (all columns of a row as they came), text, n_lines and n_dropped; no name of the input is in the way of another."""
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("whole")
    kept = small_batches(docs).select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("row_hash"))
    lines = kept.select("doc_id", "row_hash", "text").mapInArrow(_lines(least_chars), _LINE)
    common = checkpointed(common_lines(lines, least_docs))
    dropped = (lines.join(common.hint("merge"), "line_key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
               .select("doc_id", "row_hash", "place").distinct()
               .groupBy("doc_id", "row_hash").agg(F.collect_list("place").alias("dropped")))
    l, r = kept.withColumn("whole", F.col("whole").dropFields("text")) if len(docs.columns) > 1 else kept, dropped
    l, r = l.alias("l"), r.alias("r")
    joined = l.join(r.hint("merge"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.row_hash") == F.col("r.row_hash")), "left").select("whole", "text", "dropped")
    return joined.mapInArrow(_rebuild, StructType([joined.schema["whole"], joined.schema["text"], StructField("n_lines", LongType()), StructField("n_dropped", LongType())]))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The columns of `docs` with common lines taken out of `text`, and n_lines and n_dropped; columns of these two names give way."""
    out = _deduplicated(docs, least_chars, least_docs)
    columns = [F.col("text") if c == "text" else F.col(f"whole.{quoted(c)}").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*columns, "n_lines", "n_dropped")


def drop_common_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The columns of `docs` with common lines taken out of `text`; a column n_chars follows the text."""
    length = F.length("text")
    column = {"text": F.col("text")} | ({"n_chars": length.cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return _deduplicated(docs, least_chars, least_docs).select(*[column.get(c, F.col(f"whole.{quoted(c)}")).alias(c) for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT d.doc_id, d.place, d.line, c.k IS NOT NULL AND d.doc_id <> c.keeper AS gone FROM keyed d LEFT JOIN common c ON d.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
