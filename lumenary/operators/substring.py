"""Which texts contain which of many keys: an equi-join on short runs of characters, never texts by keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def _runs(c: Column, n: int) -> Column:
    """The distinct runs of n characters."""
    last = F.char_length(c) - n + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, keys: DataFrame, shortest: int = 1, longest: int = 4) -> DataFrame:
    """(id, key): the keys of at least `shortest` characters that occur in the text of an id; texts (id, text), keys (key).

    A key is looked up by the one of its runs of `longest` characters that the fewest texts hold (a shorter key by itself), so
    a common run brings texts and keys together only for keys of nothing but common runs. Null texts, ids and keys and empty
    keys match nothing; an id with several texts matches by each of them, a row for each text.
    """
    asked = keys.select("key").where(F.char_length("key") >= max(1, shortest)).distinct()
    of_key = asked.select("key", F.explode(F.when(F.char_length("key") < longest, F.array("key")).otherwise(_runs(F.col("key"), longest))).alias("run"))
    runs = _runs(F.col("text"), longest)
    for n in range(shortest, longest):
        runs = F.array_union(runs, _runs(F.col("text"), n))
    of_text = texts.select("id", F.explode(runs).alias("run")).join(of_key.select("run").distinct().hint("merge"), "run", "left_semi")
    often = checkpointed(of_text.groupBy("run").agg(F.count("*").alias("n")))
    n = F.coalesce("n", F.lit(0))
    rarest = checkpointed(of_key.join(often.hint("merge"), "run", "left").groupBy("key").agg(F.min_by("run", F.struct(n, F.col("run"))).alias("run")))
    found = of_text.join(rarest.hint("merge"), "run").groupBy("id").agg(F.collect_set("key").alias("keys"))
    held = texts.join(found.hint("merge"), "id")
    return held.select("id", F.explode(F.filter("keys", lambda k: F.contains(F.col("text"), k))).alias("key"))
