"""Merging of neighbouring tokens into dictionary phrases.

From each place the longest run of tokens whose joined text the dictionary knows becomes one token;
the last token of a document never takes part. Runs of certain tag patterns also match with numbers
written as ``n``, or without their symbols. A dictionary of a checked size goes to all tasks, and each
document is tagged and merged in one pass without a shuffle. With a larger one, places where a word of
the dictionary can begin are found by a join; only there candidates are made and joined to the
dictionary, and the hits of a document are applied from left to right.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tagset as T
from ..functions.tokens import pair, strip
from .dictionary import Dictionary, collect_tokens, explode_tokens, only_tokens
from .phrases import Phrases, map_tokens, table_below

PLAIN, NUMBERED, SKIPPED = 0, 1, 2


def beginnings(words: DataFrame) -> DataFrame:
    """Distinct beginnings of the words (word) of a table, the empty one and the whole word among them."""
    parts = F.transform(F.sequence(F.lit(0), F.length("word")), lambda n: F.substring("word", F.lit(1), n))
    return words.select(_folded("word").alias("word")).select(F.explode(parts).alias("beginning")).distinct()


def _folded(column: str) -> Column:
    """As ``phrases.folded``."""
    return F.replace(F.lower(column), F.lit("ς"), F.lit("σ"))


def candidates(exploded: DataFrame, max_ngram: int, skip_patterns: tuple[str, ...], skipped_tags: tuple[str, ...], starts: DataFrame) -> DataFrame:
    """row, start, n, kind and text of the runs of tokens (row, pos, surface, tag) that may be a phrase.

    Only runs are made whose first token, in one of its forms, is a beginning (beginning) of ``starts``.
    """
    place = Window.partitionBy("row").orderBy("pos")
    tag = F.when(F.col("tag").isin(*T.NOUN_TAGS), "NNG").otherwise(F.coalesce("tag", F.lit("")))
    surface = F.coalesce("surface", F.lit(""))
    forms = {"plain": surface, "tags": tag, "numbered": F.when(F.col("tag") == "SN", "n").otherwise(surface), "skipped": F.when(F.col("tag").isin(*skipped_tags), "").otherwise(surface)}
    heads = [F.split_part(F.lit(x), F.lit("+"), F.lit(1)) for x in skip_patterns]
    other = F.col("tags_0").isin(*heads) & ((F.col("numbered_0") != F.col("plain_0")) | (F.col("skipped_0") == "")) if heads else F.lit(False)
    ahead = exploded.select("row", F.col("pos").alias("start"), *[F.lead(column, k).over(place).alias(f"{name}_{k}") for name, column in forms.items() for k in range(max_ngram + 1)])
    first = starts.select(F.col("beginning"), F.lit(True).alias("begins"))
    ahead = ahead.join(first, _folded("plain_0") == F.col("beginning"), "left").where(F.coalesce("begins", other, F.lit(False))).drop("beginning", "begins")
    joined = lambda name, n, by="": F.concat_ws(by, *[F.col(f"{name}_{k}") for k in range(n)])
    runs = []
    for n in range(2, max_ngram + 1):
        inside = F.col(f"plain_{n}").isNotNull()  # a token follows: the last one never takes part
        patterned = inside & joined("tags", n, "+").isin(*skip_patterns)
        runs.append(F.struct(F.lit(n).alias("n"), F.lit(PLAIN).alias("kind"), F.when(inside & ~joined("tags", n, "+").isin(*T.UNMERGED_PATTERNS), joined("plain", n)).alias("text")))
        if any(x.count("+") == n - 1 for x in skip_patterns):
            runs += [F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), F.when(patterned, joined(name, n)).alias("text")) for kind, name in ((NUMBERED, "numbered"), (SKIPPED, "skipped"))]
    return ahead.select("row", "start", F.inline(F.array(*runs))).where("text is not null")


def merge_pass(docs: DataFrame, dictionary: Dictionary, max_ngram: int, skip_patterns: tuple[str, ...] = T.SKIP_PATTERNS, skipped_tags: tuple[str, ...] = T.SKIPPED_TAGS) -> DataFrame:
    """Documents (row, doc_id, tokens) after one pass of merging."""
    found = candidates(only_tokens(explode_tokens(docs, keep_row=True)), max_ngram, skip_patterns, skipped_tags, beginnings(dictionary.words))
    hits = dictionary.with_tag(found, "text").where("dict_tag is not null")
    best = hits.groupBy("row", "start").agg(F.max_by(F.struct("n", "text", "dict_tag"), F.struct("n", -F.col("kind"))).alias("hit"))
    lists = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "hit"))).alias("hits"))
    none = F.array().cast("array<struct<start:int,n:int,text:string,tag:string>>")

    def step(acc: Column, x: Column) -> Column:
        hit = x["hit"]
        one = F.struct(x["start"].alias("start"), hit["n"].alias("n"), hit["text"].alias("text"), hit["dict_tag"].alias("tag"))
        return F.when(x["start"] < acc["next"], acc).otherwise(F.struct((x["start"] + hit["n"]).alias("next"), F.concat(acc["taken"], F.array(one)).alias("taken")))

    taken = F.aggregate("hits", F.struct(F.lit(0).alias("next"), none.alias("taken")), step, lambda acc: acc["taken"])
    merged = lists.select("row", F.explode(taken).alias("m")).select("row", "m.*")
    covered = merged.select("row", "start", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos"), "text", F.col("tag").alias("new_tag"))
    rows = explode_tokens(docs, keep_row=True).join(covered, ["row", "pos"], "left").where(F.col("start").isNull() | (F.col("start") == F.col("pos")))
    return collect_tokens(rows.select("row", "doc_id", "pos", F.coalesce("text", "surface").alias("surface"), F.coalesce("new_tag", "tag").alias("tag")), keep_row=True)


def extended_tags(
    docs: DataFrame, dictionary: Dictionary, max_ngram: int = 7, skip_patterns: Iterable[str] = T.SKIP_PATTERNS, skipped_tags: Iterable[str] = T.SKIPPED_TAGS, limit: int | None = None
) -> DataFrame:
    """Dictionary tags, a pass of merging up to ``max_ngram`` tokens, one of up to three, and tags again.

    Dictionaries up to ``limit`` bytes are sent to all tasks; ``limit`` 0 joins any dictionary. Returns doc_id
    and tokens; null tokens become none.
    """
    patterns = tuple(skip_patterns)
    bare = docs.select("doc_id", "tokens")
    words = table_below(dictionary.tag_of(), limit)
    if words is None:
        return _extended_by_joins(bare, dictionary, max_ngram, patterns, tuple(skipped_tags))
    sent = docs.sparkSession.sparkContext.broadcast(Phrases(dict(zip(words["word"].to_pylist(), words["dict_tag"].to_pylist(), strict=True))))
    heads = {"+".join(parts[:k]) for parts in (x.split("+") for x in patterns) for k in range(1, len(parts) + 1)}
    skipped = frozenset(skipped_tags)

    def one(surfaces: list, tags: list) -> tuple[list, list]:
        phrases = sent.value
        surfaces = [s if s is None else s.strip() for s in surfaces]
        tags = phrases.retag(surfaces, tags)
        for most in (max_ngram, 3):
            surfaces, tags = phrases.merge(surfaces, tags, most, patterns, heads, skipped)
        return surfaces, phrases.retag(surfaces, tags)

    return map_tokens(bare, one)


def _extended_by_joins(docs: DataFrame, dictionary: Dictionary, max_ngram: int, patterns: tuple[str, ...], skipped_tags: tuple[str, ...]) -> DataFrame:
    """Rows are told apart by a number, not by their ids. Each pass reads its input several times, so the
    inputs are kept (in memory, else on disk) until Spark drops them or ``spark.catalog.clearCache()``
    does; lost blocks are made again."""

    def retagged(rows: DataFrame) -> DataFrame:
        return collect_tokens(dictionary.retag(explode_tokens(rows, keep_row=True)), keep_row=True)

    bare = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.transform("tokens", lambda t: pair(strip(t["surface"]), t["tag"])).alias("tokens"))
    first = retagged(bare).persist()
    second = merge_pass(first, dictionary, max_ngram, patterns, skipped_tags).persist()
    third = merge_pass(second, dictionary, 3, patterns, skipped_tags).persist()
    return retagged(third).drop("row")
