"""Which words hold, begin with or end with an item of a table, for tables of any size.

Beginnings and ends are joined as they are: a word gives one row for each length that items have. For
items inside words, each item of Q letters or more is looked for where its rarest run of Q letters is;
an item with a run that no word has is left out before. Shorter items are joined to the words' own short
runs. Distinct words are compared once, and the condition is tested inside the joins, so no pairs of
words and items are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a run of the index; distinct lengths of items up to which each is tried by itself.
Q, LENGTHS = 3, 64


def _lengths(items: DataFrame) -> list[int]:
    return [r["n"] for r in items.select(F.length("item").alias("n")).distinct().orderBy("n").limit(LENGTHS + 1).collect()]


def _cuts(word: Column, items: DataFrame, end: bool) -> Column:
    """The beginnings, or the ends, of a word in the lengths of items."""
    lengths = _lengths(items)
    if len(lengths) <= LENGTHS:
        wanted = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(word))
    else:
        longest = items.agg(F.max(F.length("item"))).first()[0]
        wanted = F.sequence(F.lit(0), F.least(F.length(word), F.lit(longest)))
    start = lambda n: F.length(word) - n + 1 if end else F.lit(1)
    return F.transform(wanted, lambda n: F.substring(word, start(n), n))


def _runs(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` letters; none in shorter texts."""
    at = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda p: F.substring(text, p, F.lit(size))))


def _equal(words: DataFrame, parts: Column, items: DataFrame) -> DataFrame:
    """Words (word) one of whose parts is an item."""
    return words.select("word", F.explode(parts).alias("item")).join(items, "item", "left_semi").select("word")


def _holding(words: DataFrame, items: DataFrame) -> DataFrame:
    short, long = items.where(F.length("item") < Q), items.where(F.length("item") >= Q)
    parts = F.flatten(F.array(F.array(F.lit("")), *[_runs(F.col("word"), n) for n in range(1, Q)]))
    found = _equal(words, parts, short)
    runs = words.select("word", F.explode(_runs(F.col("word"), Q)).alias("run"))
    many = runs.groupBy("run").agg(F.count("*").alias("n"))
    own = long.select("item", F.explode(_runs(F.col("item"), Q)).alias("run")).join(many, "run", "left")
    keys = own.groupBy("item").agg(F.min_by("run", F.coalesce("n", F.lit(0))).alias("run"), F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0").select("item", "run")
    return found.union(runs.join(keys, (runs["run"] == keys["run"]) & F.contains(runs["word"], keys["item"]), "left_semi").select("word"))


def including(rows: DataFrame, items: DataFrame, column: str = "word", unit_level: bool = False, endswith: bool = False, startswith: bool = False) -> DataFrame:
    """The rows whose word, in small letters, holds an item (item) in small letters, or begins or ends with one.

    With ``unit_level`` an item has to be a whole unit of the word between ``;`` as it is written, the last
    or the first one with the other flags. Null words and items match nothing; an empty item is part of
    every word. Rows keep all their columns and stay as often as they are.
    """
    words = rows.select(F.lower(column).alias("word")).where("word is not null").distinct()
    items = items.select((F.col("item") if unit_level else F.lower("item")).alias("item")).where("item is not null").distinct()
    if unit_level:
        units = F.split("word", ";")
        parts = F.array(F.element_at(units, -1)) if endswith else F.array(F.get(units, F.lit(0))) if startswith else F.array_distinct(units)
        found = _equal(words, parts, items)
    elif endswith or startswith:
        found = _equal(words, _cuts(F.col("word"), items, endswith), items)
    else:
        found = _holding(words, items)
    found = found.distinct().withColumnRenamed("word", "_found")
    return rows.join(found, F.lower(column) == F.col("_found"), "left_semi")
