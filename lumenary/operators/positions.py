"""Positions of words within one array of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once, not for each use within f."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def positions(words: Column) -> Column:
    """An array of (word, positions from 0, ascending), each word once, by one sort of the array and cuts where the word changes."""
    def cut(s: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, i - 1)["w"])
        # An end follows each start, the array's length the last one.
        starts = F.concat(F.filter(F.transform(s, lambda x, i: F.when(new(i), i)), lambda i: i.isNotNull()), F.array(F.size(s)))
        return _bound(starts, lambda at: F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda i, n: F.struct(
            F.get(s, i)["w"].alias("word"), F.transform(F.slice(s, i + 1, F.get(at, n + 1) - i), lambda x: x["p"]).alias("places"))))

    return _bound(F.sort_array(F.transform(words, lambda w, p: F.struct(w.alias("w"), p.alias("p")))), cut)
