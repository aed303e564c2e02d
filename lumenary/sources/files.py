"""Scans and sinks: name lists, taxonomies, provider records, GraphML, mark-up bodies, exports, backups, versioned publishing."""

from __future__ import annotations

import html
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.positions import positions
from ..session import checkpointed

#: Canonical order of priorities.
PRIORITIES = ["HIGH", "MED", "LOW"]
UNKNOWN_BRANCH = 99


def read_name_list(spark: SparkSession, path: str, column: str | None = None, header: bool = True) -> DataFrame:
    """One trimmed, non-blank name per row: the column asked for, else `name`, else the first. A byte order mark is no part of a name."""
    df = spark.read.option("header", header).option("multiLine", True).option("escape", '"').csv(path)
    clean = {c.lstrip("﻿").strip(): c for c in df.columns}
    pick = clean.get(column) if column else clean.get("name", df.columns[0])
    if pick is None:
        raise ValueError(f"no column {column}")
    return df.select(F.trim(F.regexp_replace(F.col(f"`{pick}`"), "^﻿", "")).alias("name")).where(F.col("name") != "")


TAXONOMY = T.StructType([T.StructField(n, T.StringType()) for n in ("keyword", "branch", "priority", "topic_slug", "topic_name")] + [T.StructField("topic_level", T.IntegerType())])


def load_taxonomy(spark: SparkSession, path: str, branches: list[str], branch: str | None = None, priority: str | None = None, lines: bool = False) -> DataFrame:
    """Keyword records with their canonical place: branch list, then priority, level and keyword; unknown branches last.

    Files hold one JSON array each, or with `lines` a record on each line.
    """
    df = spark.read.schema(TAXONOMY).option("multiLine", not lines).json(path)
    at = lambda values, c: F.array_position(F.array(*map(F.lit, values)), F.col(c))
    rank = F.when(at(branches, "branch") > 0, at(branches, "branch")).otherwise(UNKNOWN_BRANCH)
    out = df.withColumn("branch_rank", rank).withColumn("priority_rank", F.when(at(PRIORITIES, "priority") > 0, at(PRIORITIES, "priority")).otherwise(len(PRIORITIES) + 1))
    if branch:
        out = out.where(F.col("branch") == branch)
    if priority:
        out = out.where(F.col("priority") == priority)
    return out.orderBy("branch_rank", "priority_rank", "topic_level", F.lower("keyword"))


def abstract_from_inverted_index(df: DataFrame, col: str) -> DataFrame:
    """Text from a map of word to positions, by position, then word; rows without any word drop out."""
    pairs = F.flatten(F.transform(F.map_entries(col), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    text = F.array_join(F.transform(F.sort_array(pairs), lambda x: x["w"]), " ")
    # A filter on the text would be moved before it and build it twice.
    some = F.explode(F.filter(F.array(text), lambda t: t != "")).alias("abstract")
    return df.select(*[c for c in df.columns if c != col], some)


def invert(df: DataFrame, col: str) -> DataFrame:
    """The map of word to positions of each text, split at blanks; the way back of `abstract_from_inverted_index`. A row's words stay in its task."""
    return df.where(F.col(col).isNotNull()).select("id", F.map_from_entries(positions(F.split(col, " "))).alias("index"))


PUBLICATION = "struct<id:string,doi:string,title:string,year:int,journal:struct<title:string>,authors:array<struct<name:string>>,concepts:array<string>,times_cited:int,linkout:string,abstract:string,type:string>"


def normalise_doi(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", ""), F.lit(""))


def flatten_publications(df: DataFrame, col: str, provider: str) -> DataFrame:
    """Nested provider records as twelve plain columns."""
    r = df.withColumn("r", F.from_json(col, PUBLICATION))
    doi = normalise_doi(F.col("r.doi"))
    url = F.coalesce(F.col("r.linkout"), F.concat(F.lit("https://doi.org/"), F.col("doi")))
    return r.withColumn("doi", doi).select(
        F.col("r.id").alias("external_id"), F.lit(provider).alias("provider"), "doi", F.coalesce(F.nullif(F.trim("r.title"), F.lit("")), F.lit("(untitled)")).alias("name"), F.col("r.year").alias("year"), F.col("r.journal.title").alias("journal"),
        F.array_join(F.transform("r.authors", lambda a: a["name"]), "; ").alias("authors"), F.array_join(F.slice("r.concepts", 1, 6), "; ").alias("concepts"), F.coalesce("r.times_cited", F.lit(0)).alias("citation_count"), url.alias("url"), F.col("r.abstract").alias("abstract"), F.col("r.type").alias("kind"))


def ingest_new(batch: DataFrame, existing: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Rows of which no key is known or on an earlier row that stands; rows come in turn of `order`, which is unique. Null and empty keys never match.

    A row that falls takes none of its keys with it. Decided in rounds over keys and order alone: a row that is the first of
    the open ones in all its keys stands, those that share a key with it fall, the rest stays open. The first open row always
    stands, so the rounds end; chains of rows that block each other in turn make them many, not the number of rows.
    """
    blank = lambda k: F.nullif(F.col(k).cast("string"), F.lit("")).alias(k)
    open_ = batch.select(order, *[blank(k) for k in keys])
    for k in keys:
        open_ = open_.join(existing.select(blank(k)).where(F.col(k).isNotNull()).distinct().hint("merge"), k, "left_anti")
    open_, stands = checkpointed(open_), []
    while not open_.isEmpty():
        marked = open_
        for k in keys:
            first = checkpointed(open_.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"first_{k}")))
            marked = marked.join(first.hint("merge"), k, "left")
        leads = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"first_{k}") == F.col(order), F.lit(True)) for k in keys])
        marked = checkpointed(marked.select(order, *keys, leads.alias("leads")))
        now, rest = marked.where("leads").drop("leads"), marked.where("NOT leads").drop("leads")
        for k in keys:
            rest = rest.join(now.select(k).where(F.col(k).isNotNull()).hint("merge"), k, "left_anti")
        stands.append(now.select(order))
        open_ = checkpointed(rest)
    if not stands:
        return batch.limit(0)
    return batch.join(reduce(DataFrame.unionByName, stands).hint("merge"), order, "left_semi")


def topic_links(rows: DataFrame, queries: DataFrame, key: str = "pos") -> DataFrame:
    """(key, topic_id): the topics of the search query that brought each row; queries: search_query, topic_id."""
    return rows.select(key, "search_query").join(queries.select("search_query", "topic_id").distinct().hint("merge"), "search_query").select(key, "topic_id").distinct()


def read_graph_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, attrs) and undirected edges (src <= dst, attrs) of GraphML, keys resolved to names; a parallel edge is an error."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    data = "data array<struct<_key:string,_VALUE:string>>"
    keys = read("key", "_id string, `_attr.name` string").select(F.col("_id").alias("key"), F.col("`_attr.name`").alias("attr"))
    def attrs(df: DataFrame, ids: list[str]) -> DataFrame:
        flat = df.select(*ids, F.explode_outer("data").alias("d")).select(*ids, F.col("d._key").alias("key"), F.col("d._VALUE").alias("value")).join(F.broadcast(keys), "key", "left")
        pairs = F.filter(F.collect_list(F.struct(F.coalesce("attr", "key").alias("k"), "value")), lambda x: x["k"].isNotNull())
        return flat.groupBy(*ids).agg(F.map_from_entries(pairs).alias("attrs"))
    nodes = attrs(read("node", f"_id string, {data}").select(F.col("_id").alias("id"), "data"), ["id"])
    raw = read("edge", f"_source string, _target string, {data}").select(F.least("_source", "_target").alias("src"), F.greatest("_source", "_target").alias("dst"), "data")
    if not raw.groupBy("src", "dst").count().where("count > 1").isEmpty():
        raise ValueError("parallel edges")
    return nodes, attrs(raw, ["src", "dst"])


_BLOCK = re.compile(r"<(h[1-6]|p|figcaption|li)\b[^>]*>(.*?)</\1>", re.S | re.I)
_SKIP = re.compile(r"<(script|style|nav|header|footer|aside)\b.*?</\1>|<!--.*?-->", re.S | re.I)


def body_blocks(page: str | None) -> list[str]:
    """Text blocks of headings, paragraphs, list items and captions, without scripts, styles and navigation, blanks collapsed."""
    bare = _SKIP.sub(" ", page or "")
    blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", m[2]))).strip() for m in _BLOCK.finditer(bare))
    return [b for b in blocks if b]


def extract_body(pages: DataFrame) -> DataFrame:
    """(page_id, body, characters, paragraphs) of pages with any body text, blocks parted by blank lines."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pdf["html"].map(body_blocks)
            yield pd.DataFrame({"page_id": pdf["page_id"], "body": found.map("\n\n".join), "paragraphs": found.map(len)})
    out = pages.select("page_id", "html").mapInPandas(run, "page_id long, body string, paragraphs long")
    return out.where(F.col("body") != "").withColumn("characters", F.length("body").cast("long"))


def reconcile_import(entities: DataFrame, edges: DataFrame, items: DataFrame, chunks: DataFrame | None = None, documents: DataFrame | None = None, evidence: DataFrame | None = None, stored: DataFrame | None = None, expected: dict[str, int] | None = None) -> DataFrame:
    """(check, n): what is wrong with an imported graph, by count.

    Vector items (id) without a graph entity and entities without an item, edges (src, dst) with an unknown end, and both
    totals. With chunks (chunk_id, document_id), documents (document_id), evidence and stored (item, chunk_id): evidence of an
    unknown chunk, chunks outside of the processed documents, pairs of the graph's evidence that are not stored, and stored ones that
    the graph doesn't have. With expected counts: by how much `entities`, `items` and `chunks` differ from them.
    """
    e, i = entities.select("id").distinct(), items.select("id").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    anti = lambda a, b, on: a.join(b.hint("merge"), on, "left_anti")
    checks = {"items_without_entity": anti(i, e, "id"), "entities_without_item": anti(e, i, "id"), "dangling_ends": anti(ends, e, "id"), "entities": e, "items": i}
    if chunks is not None:
        known, pairs, held = chunks.select("chunk_id").distinct(), evidence.select("item", "chunk_id").distinct(), stored.select("item", "chunk_id").distinct()
        checks |= {"dangling_chunks": anti(pairs, known, "chunk_id"), "chunks_outside_documents": anti(chunks.select("chunk_id", "document_id").distinct(), documents.select("document_id").distinct(), "document_id"),
                   "evidence_not_stored": anti(pairs, held, ["item", "chunk_id"]), "stored_without_evidence": anti(held, pairs, ["item", "chunk_id"]), "chunks": known}
    out = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()])
    if expected:
        wanted = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
        off = out.where(F.col("check").isin(list(expected))).select(F.concat(F.lit("difference_"), "check").alias("check"), (F.col("n") - wanted[F.col("check")]).alias("n"))
        out = out.unionByName(off)
    return out


def csv_safe(df: DataFrame, doi: str | None = "doi") -> DataFrame:
    """Every column as text that a spreadsheet takes for text: lists joined, booleans spelled, nulls empty, formulas quoted."""
    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "; ")
        elif isinstance(f.dataType, T.BooleanType):
            c = F.when(c, "true").when(~c, "false")
        elif not isinstance(f.dataType, T.StringType):
            return F.coalesce(c.cast("string"), F.lit("")).alias(f.name)
        c = F.coalesce(c, F.lit(""))
        return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c).alias(f.name)
    out = df.select(*[one(f) for f in df.schema.fields])
    return out.withColumn("doi_url", F.when(F.col(doi) != "", F.concat(F.lit("https://doi.org/"), F.col(doi))).otherwise("")) if doi and doi in df.columns else out


def export_csv(df: DataFrame, path: str) -> None:
    csv_safe(df).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def export_jsonl(tables: dict[str, tuple[DataFrame, str]], start: str, end: str, today: str) -> DataFrame:
    """Lines {table, row} of all tables from `start` to the end of the day `end`; fewer than 90 days and none ahead."""
    from datetime import date

    a, b, now = map(date.fromisoformat, (start, end, today))
    if not 0 <= (b - a).days < 90 or b > now:
        raise ValueError(f"range {start} to {end}")
    out = None
    for name, (df, at) in sorted(tables.items()):
        own = df.where((F.col(at) >= F.lit(start).cast("timestamp")) & (F.col(at) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")))
        rows = own.select(F.lit(name).alias("table"), F.to_json(F.struct(*[c for c, t in df.dtypes if t not in ("binary",)])).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, key_digest): counts and an order-free digest, one pass each."""
    one = lambda name, df: df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("digest")).select(F.lit(name).alias("table"), "rows", "digest")
    return reduce(DataFrame.unionByName, [one(n, df) for n, df in sorted(tables.items())])


def backup(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Every table as Parquet, and the manifest of what was written, read back."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    out = manifest({n: spark.read.parquet(f"{path}/{n}") for n in tables})
    out.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return out


class VersionConflict(RuntimeError):  # noqa: N818
    """Another payload holds the version, or a later version is published."""


def published(spark: SparkSession, path: str) -> list[int]:
    """The versions that are published below a path, in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    return sorted(int(n.removeprefix("version=")) for n in names if re.fullmatch(r"version=\d+", n))


def publish(df: DataFrame, path: str, version: int) -> str:
    """Publish a table as a version of its own: `published`, or `same` if this version holds equal rows already.

    The rows are written beside the version's folder and put there by a rename that fails if it exists, so of two writers one
    wins, a reader sees whole versions only, and a writer that dies leaves nothing that counts. The other writer compares what
    it has with what is there: equal rows are no conflict, other rows raise VersionConflict, and so does a version before the
    latest one.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    beside, place = (hadoop.Path(f"{path}/{name}") for name in (f"_new-{uuid.uuid4().hex}", f"version={version}"))
    files = hadoop.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    if max(published(spark, path), default=version) > version:
        raise VersionConflict(f"version {version} is before the latest one")
    df.write.parquet(beside.toString())
    try:
        files.rename(beside, place, spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
        return "published"
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        mine, theirs = (manifest({"t": spark.read.parquet(p.toString())}).first() for p in (beside, place))
        if mine != theirs:
            raise VersionConflict(f"version {version} holds another payload") from e
        return "same"
    finally:
        files.delete(beside, True)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the latest version."""
    versions = published(spark, path)
    if not versions:
        raise FileNotFoundError(f"nothing is published below {path}")
    return spark.read.parquet(f"{path}/version={versions[-1]}")


def publish_if_newer(candidates: DataFrame) -> DataFrame:
    """Of each workbook the newest version, unless two payloads claim it; `conflict` says so."""
    per = candidates.groupBy("workbook", "version").agg(F.countDistinct("payload").alias("payloads"), F.min("payload").alias("payload"))
    return per.groupBy("workbook").agg(F.max(F.struct("version", "payloads", "payload")).alias("m")).select("workbook", "m.version", F.when(F.col("m.payloads") == 1, F.col("m.payload")).alias("payload"), (F.col("m.payloads") > 1).alias("conflict"))


# Reviewed records and matches against a directory.

URL = r"^https?://[A-Za-z0-9.-]+\.[A-Za-z]{2,}(/\S*)?$"


#: Columns that a table of reviewed records must have.
HEADERS = ["record_id", "status", "note", "day", "score", "tier", "url"]


def reviewed_records(df: DataFrame) -> DataFrame:
    """Approved or merged rows with a proper, unique id; e-mail addresses scrubbed, serial dates as dates, bad scores 0.

    `url` is the first public URL of the cell and `evidence` all of them, each once. A table without one of the columns is refused.
    """
    missing = [c for c in HEADERS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    kept = df.where(F.lower("status").isin("approved", "merged") & F.col("record_id").rlike(r"^[A-Z]+-[0-9]+$"))
    once = checkpointed(kept.groupBy("record_id").agg(F.count("*").alias("uses")).where("uses = 1").drop("uses"))
    score = F.col("score").try_cast("double")
    day = F.when(F.col("day").rlike("^[0-9]+$"), F.date_add(F.lit("1899-12-30").cast("date"), F.col("day").cast("int"))).otherwise(F.col("day").try_cast("date"))
    urls = F.array_distinct(F.filter(F.split("url", r"[\s,;]+"), lambda u: u.rlike(URL)))
    return kept.join(once.hint("merge"), "record_id").select(
        "record_id", F.regexp_replace("note", r"\S+@\S+", "[e-mail]").alias("note"), day.alias("day"), F.when(score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")), score).otherwise(0.0).alias("score"),
        F.when(F.col("tier").isin("A", "B", "C"), F.col("tier")).alias("tier"), F.get(urls, F.lit(0)).alias("url"), F.coalesce(F.array_join(urls, "|"), F.lit("")).alias("evidence"))


def validate_matches(matches: DataFrame, directory: DataFrame, sector: str | None = None, country: str | None = None, since: bool = False, region: str | None = None) -> DataFrame:
    """Matches whose organization exists and honours the filters, each once; evidence must stand in the description, else its first sentence does."""
    known = directory
    if sector:
        known = known.where(F.col("org_type") == sector)
    if country:
        known = known.where(F.col("country") == country)
    if region:
        known = known.where(F.col("region") == region)
    first = matches.groupBy("id").agg(F.min_by("evidence", "pos").alias("evidence"), F.min("pos").alias("pos"))
    out = first.join(known.select("id", "name", "description"), "id")
    text = F.when(F.contains("description", F.col("evidence")) & (F.col("evidence") != ""), F.col("evidence")).otherwise(F.substring_index("description", ".", 1))
    return out.select("id", "name", text.alias("evidence"), "pos").where(F.lit(not since))
