"""Secret scans by linking the parts of a credential.

Strong patterns (assignments, access identifiers, long hex strings) always count. Weak ones (identifiers, opaque strings,
endpoints) mean little alone. Within a scope of `REACH` code points of the same document an identifier needs a secret, a
secret needs an identity, and an endpoint needs both. Parts are found with JVM regular expressions, become rows with their
positions, and meet in an interval join on (row, stretch of REACH code points). `link_credentials` gives the linked groups.

Defined results: a null text is empty; an empty text or table has no spans; equal rows each keep a row, a null doc_id
included; very long texts only make more part rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import any_of, checkpointed, table

REACH = 200

#: Kind, order, role, pattern, group whose length counts, least length, whether it is a strong kind.
KINDS = [
    ("assign", 0, "secret", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    ("access", 1, "identity", r"(AKIA[A-Z0-9]+)", 1, 20, True),
    ("hex", 2, "secret", r"([0-9a-f]{24,})", 1, 24, True),
    ("ident", 3, "identity", r"""((?i:client_?id|user_?name|login|account|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3, False),
    ("opaque", 4, "secret", r"((?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,})", 1, 20, False),
    ("endpoint", 5, "endpoint", r"((?i:https?|jdbc:[a-z0-9]+|redis|amqps?|postgres(?:ql)?|mysql|mongodb)://[A-Za-z0-9._-]+(?::[0-9]+)?)", 1, 8, False),
]


def _parts_of(text: Column, order: int, pattern: str, group: int) -> Column:
    """Array of (kind, n-th match, code points since the match before, length, length of the group) in one document.

    The pieces between matches and the matches themselves come from the same leftmost, non-overlapping search, so their
    lengths add up to positions.
    """
    rx = F.lit(pattern)
    found = F.zip_with(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, rx, F.lit(0)), lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"))),
                       F.regexp_extract_all(text, rx, F.lit(group)), lambda x, g: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), F.length(g).alias("size")))
    rows = F.transform(found, lambda x, i: F.struct(F.lit(order).alias("kind"), i.alias("nth"), x["gap"].alias("gap"), x["len"].alias("len"), x["size"].alias("size")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,nth:int,gap:int,len:int,size:int>>"))


def find_parts(docs: DataFrame) -> DataFrame:
    """One row per part with start and end, and one with a null kind for each document without any."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lists = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.concat(*[_parts_of(text, k[1], k[3], k[4]) for k in KINDS]).alias("parts"))
    flat = checkpointed(lists.select("doc_id", "row", F.explode_outer("parts").alias("part")).select("doc_id", "row", "part.*"))
    upto = Window.partitionBy("row", "kind").orderBy("nth")
    least = F.element_at(F.array(*[F.lit(k[5]) for k in KINDS]), F.col("kind") + 1)
    placed = flat.withColumn("end", F.sum(F.col("gap") + F.coalesce("len", F.lit(0))).over(upto)).withColumn("start", F.col("end") - F.col("len"))
    kept = F.col("kind").isNull() | (F.col("len").isNotNull() & (F.col("size") >= least))
    return placed.select("doc_id", "row", "kind", "start", "end", kept.alias("kept"))


#: Roles that must lie near a weak part of each role.
NEEDS = {"identity": ("secret",), "secret": ("identity",), "endpoint": ("identity", "secret")}


def _near_pairs(parts: DataFrame, reach: int) -> DataFrame:
    """Pairs of parts of other roles at most `reach` code points apart: row, kind, start, end, role, strong, and start_2, end_2, role_2, gap."""
    role = F.element_at(F.array(*[F.lit(k[2]) for k in KINDS]), F.col("kind") + 1)
    strong = F.element_at(F.array(*[F.lit(k[6]) for k in KINDS]), F.col("kind") + 1)
    placed = parts.where(F.col("kind").isNotNull() & F.col("kept")).select("row", "kind", "start", "end", role.alias("role"), strong.alias("strong"))
    stretch = lambda df, by: df.withColumn("stretch", F.explode(F.sequence(F.floor((F.col("start") - by) / reach), F.floor((F.col("end") + by) / reach))))
    near = stretch(placed, reach).select("row", "stretch", *[F.col(c).alias(f"{c}_2") for c in ("start", "end", "role")])
    gap = F.greatest("start", "start_2") - F.least("end", "end_2")
    return stretch(placed, 0).join(near.hint("merge"), ["row", "stretch"]).where(F.col("role") != F.col("role_2")).withColumn("gap", gap).where(F.col("gap") <= reach)


def link_weak(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak parts that parts of all roles they need lie near: row, kind, start, end."""
    near = _near_pairs(parts, reach).where(~F.col("strong")).groupBy("row", "kind", "start", "end", "role").agg(F.collect_set("role_2").alias("roles"))
    whole = [(F.col("role") == role) & F.forall(F.array(*[F.lit(n) for n in needs]), lambda n: F.array_contains("roles", n)) for role, needs in NEEDS.items()]
    return near.where(any_of(whole)).select("row", "kind", "start", "end")


def link_credentials(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, secret, its nearest identity, and the nearest endpoint (null if none is near): spans of each linked credential."""
    parts = find_parts(docs)
    pairs = _near_pairs(parts, reach).where("role = 'secret'").select("row", "start", "end", "role_2", "gap", F.struct(F.col("start_2").alias("start"), F.col("end_2").alias("end")).alias("other")).distinct()
    best = lambda role: F.min_by(F.when(F.col("role_2") == role, F.col("other")), F.when(F.col("role_2") == role, F.struct("gap", "other"))).alias(role)
    groups = pairs.groupBy("row", "start", "end").agg(best("identity"), best("endpoint")).where("identity IS NOT NULL")
    ids = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"))
    return groups.join(ids.hint("merge"), "row").select("doc_id", F.struct("start", "end").alias("secret"), "identity", "endpoint")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per row of `docs`: counts of the strong kinds, `base` (their spans) and `spans` (all), each kind:start:end by start."""
    parts = find_parts(docs)
    strong = F.col("kind").isNull() | any_of([F.col("kind") == k[1] for k in KINDS if k[6]])
    linked = link_weak(parts, reach).withColumn("kept", F.lit(True)).withColumn("weak", F.lit(True))
    # A document whose parts were all dropped still needs its row, so dropped parts stay until the spans are gathered.
    known = parts.withColumn("kept", F.col("kept") & strong).withColumn("weak", F.lit(False))
    every = known.unionByName(linked.withColumn("doc_id", F.lit(None).cast(known.schema["doc_id"].dataType)))
    span = F.struct("start", "kind", "end")
    kept = F.col("kept") & F.col("kind").isNotNull()
    count = lambda name, k: F.count_if(kept & (F.col("kind") == k)).alias(name)
    gathered = every.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), count("n_assign", 0), count("n_access", 1), count("n_hex", 2),
        F.collect_list(F.when(kept & ~F.col("weak"), span)).alias("strong_spans"), F.collect_list(F.when(kept, span)).alias("all_spans"))
    return gathered.select("doc_id", "n_assign", "n_access", "n_hex", _joined(F.col("strong_spans")).alias("base"), _joined(F.col("all_spans")).alias("spans"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
