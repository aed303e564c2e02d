"""The corpus pipeline: toxic documents out, common lines out, near copies out, benchmark passages out, then token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again by the next one.
All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from lumenary.llm.bpe import encode_documents
from lumenary.llm.decontaminate import drop_contaminated
from lumenary.llm.jaccard import keep_one
from lumenary.llm.lines import drop_common_lines
from lumenary.llm.runtime import checkpointed, table
from lumenary.llm.toxicity import drop_toxic
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, all columns as they came.

    A null or empty text has no evidence and gets the base score, as does everything where no labels are known; texts of any
    length are scanned whole; a score that ties with the threshold is toxic; equal rows get equal scores and keep a row
    each; an empty table stays empty; other columns, whatever their names, come through.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that several share; n_chars follows the text.

    A null text comes out empty; an empty text, and one of any length, is split whole; among documents that share a line the
    largest doc_id keeps it, in all rows that have this id; a null doc_id is a document that sorts before all others; equal
    rows keep a row each; an empty table stays empty; other columns, whatever their names, come through.
    """
    return drop_common_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies: sets of five-word shingles with a similarity of 0.8 or more.

    Null and empty texts are linked with nothing and stay; texts of any length are compared whole, those under five words as
    one sequence; a similarity of exactly 0.8 links; rows with equal doc_id are one document with the links of all its texts,
    and stay or go together; a null doc_id sorts before all others; an empty table stays empty; other columns, whatever
    their names, come through.
    """
    return keep_one(docs, shingle=5, per=80, of=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark passage makes up a twentieth of.

    Null and empty texts hit nothing and stay; texts of any length are searched whole; a twentieth exactly is contaminated;
    equal rows go or stay together, rows that share a doc_id are judged each by its text; a null doc_id is judged like any
    other; an empty table stays empty; other columns, whatever their names, come through.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and a digest of what they decode to, a row for each document.

    A null text is empty; an empty text has no tokens; texts of any length are encoded whole; a null doc_id stays null; equal
    rows and rows with equal doc_id keep a row each; an empty table gives an empty result; other columns end here.
    """
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("bpe", bpe)]

#: The scores of the first stage come from a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
