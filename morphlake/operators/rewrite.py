"""Rewriting of tagged documents with a dictionary: in one pass without a shuffle where its tables can be sent.

The steps are those of ``Dictionary`` over exploded tokens, which are taken where a table is too large.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tagset as T
from .dictionary import Dictionary, collect_tokens, explode_tokens, passing, postprocess
from .phrases import Phrases, map_tokens, table_below


def _map(table: pa.Table | None) -> dict | None:
    return None if table is None else dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))


def rewritten(
    docs: DataFrame, dictionary: Dictionary, retag: bool = False, synonyms: bool = False, lemmas: bool = False, keep: Iterable[str] | None = None, drop_terms: bool = False,
    categories: Iterable[str] | None = None, lowercase: bool = False, limit: int | None = None,
) -> DataFrame:
    """Documents (doc_id, tokens) after the steps that are asked for, in this order: tags of the dictionary, synonyms,
    lemmas, only the tags ``keep``, without terms of ``categories`` (of any, if None), small letters.

    Tables up to ``limit`` bytes each are sent to all tasks; ``limit`` 0 joins. Null tokens become none.
    """
    keep = None if keep is None else tuple(keep)
    categories = None if categories is None else tuple(categories)
    docs = docs.select("doc_id", "tokens")
    terms = dictionary.terms if categories is None else dictionary.terms.where(F.col("category").isin(*categories))
    wanted = {
        "tags": dictionary.tag_of() if retag else None, "synonyms": dictionary.synonyms.select("src", F.lower("dst").alias("dst")) if synonyms else None,
        "lemmas": dictionary.lemmas.select("src", "dst") if lemmas else None, "terms": terms.select("word", F.lit(None).cast("string").alias("none")).distinct() if drop_terms else None,
    }
    maps = {name: _map(table_below(table, limit)) for name, table in wanted.items() if table is not None}
    if any(m is None for m in maps.values()):
        return _by_joins(docs, dictionary, retag, synonyms, lemmas, keep, drop_terms, categories, lowercase)
    if "tags" in maps:
        maps["tags"] = Phrases(maps["tags"])
    sent = docs.sparkSession.sparkContext.broadcast(maps)

    def one(surfaces: list, tags: list) -> tuple[list, list]:
        own, out_s, out_t = sent.value, [], []
        same, roots, gone = own.get("synonyms", {}), own.get("lemmas", {}), own.get("terms", {})
        if retag:
            tags = own["tags"].retag(surfaces, tags)
        for surface, tag in zip(surfaces, tags, strict=True):
            if surface is not None and same:
                surface = same.get(surface.lower()) or surface
            low = None if surface is None else surface.lower()
            if tag in T.LEMMA_TAGS and low in roots:
                surface, tag = roots[low] or surface, "VV" if tag == "XSV" else tag
                low = surface.lower()
            if (keep is None or tag in keep) and (low is None or low not in gone):
                out_s.append(low if lowercase else surface)
                out_t.append(tag)
        return out_s, out_t

    return map_tokens(docs, one)


def _by_joins(docs: DataFrame, dictionary: Dictionary, retag, synonyms, lemmas, keep, drop_terms, categories, lowercase) -> DataFrame:
    rows = explode_tokens(docs)
    for step, asked in ((dictionary.retag, retag), (dictionary.replace_synonyms, synonyms), (dictionary.lemmatize, lemmas)):
        rows = step(rows) if asked else rows
    rows = rows if keep is None else passing(rows, F.col("tag").isin(*keep))
    rows = dictionary.without_terms(rows, categories) if drop_terms else rows
    return collect_tokens(rows.withColumn("surface", F.lower("surface")) if lowercase else rows)


def postprocessed(
    docs: DataFrame, stopwords: DataFrame | None = None, passwords: DataFrame | None = None, passtags: Iterable[str] | None = None, replacements: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """Documents (doc_id, tokens) after ``dictionary.postprocess``, in one pass where its tables can be sent.

    Tables up to ``limit`` bytes each are sent to all tasks; ``limit`` 0 joins. Null tokens become none.
    """
    docs, passtags = docs.select("doc_id", "tokens"), tuple(passtags or ())
    lists = {k: t.select("word", "tag").distinct() for k, t in (("stop", stopwords), ("pass", passwords)) if t is not None}
    if replacements is not None:
        lists["new"] = replacements.select("word", "tag", "new_word", "new_tag")
    tables = {k: table_below(t, limit) for k, t in lists.items()}
    # A word and tag with several replacements gives a token for each: joins do that.
    if any(t is None for t in tables.values()) or "new" in tables and len({*_entries(tables["new"])}) < len(tables["new"]):
        return collect_tokens(postprocess(explode_tokens(docs), stopwords, passwords, passtags, replacements))
    own = {k: frozenset(_entries(t)) for k, t in tables.items() if k != "new"}
    if "new" in tables:
        own["new"] = dict(zip(_entries(tables["new"]), zip(tables["new"]["new_word"].to_pylist(), tables["new"]["new_tag"].to_pylist(), strict=True), strict=True))
    sent = docs.sparkSession.sparkContext.broadcast(own)

    def one(surfaces: list, tags: list) -> tuple[list, list]:
        own, out_s, out_t = sent.value, [], []
        stop, wanted, new = own.get("stop"), own.get("pass"), own.get("new", {})
        for surface, tag in zip(surfaces, tags, strict=True):
            known = surface is not None
            exact, loose = (surface, tag), (surface, None)
            if stop is not None and known and (tag is not None and exact in stop or loose in stop):
                continue
            if wanted is not None and not (known and (tag is not None and exact in wanted or loose in wanted)):
                continue
            if passtags and tag not in passtags:
                continue
            found = (new.get(exact) if tag is not None else None) or new.get(loose) if known and new else None
            if found:
                surface, tag = (x if y is None else y for x, y in zip((surface, tag), found, strict=True))
            out_s.append(surface)
            out_t.append(tag)
        return out_s, out_t

    return map_tokens(docs, one)


def _entries(table: pa.Table) -> list[tuple]:
    return list(zip(table["word"].to_pylist(), table["tag"].to_pylist(), strict=True))


def nouns(docs: DataFrame, dictionary: Dictionary, replace_synonyms: bool = True, industry: bool = False, generic: bool = False, sector: bool = False, country: bool = True, limit: int | None = None) -> DataFrame:
    """Documents with their lower-case nouns; each flag says whether terms of that category stay."""
    dropped = [c for c, stays in (("INDUSTRY", industry), ("GENERIC", generic), ("SECTOR", sector), ("COUNTRY", country)) if not stays]
    return rewritten(docs, dictionary, synonyms=replace_synonyms, keep=T.TOPIC_TAGS, drop_terms=bool(dropped), categories=dropped, lowercase=True, limit=limit)


def sentiment_words(docs: DataFrame, dictionary: Dictionary, replace_synonyms: bool = True, lemmatize: bool = True, exclude_terms: bool = True, with_tag: bool = True, limit: int | None = None) -> DataFrame:
    """doc_id and terms: the words that bear sentiment, in small letters, as ``word/TAG`` or without the tag."""
    rows = rewritten(docs, dictionary, synonyms=replace_synonyms, lemmas=lemmatize, keep=T.SENTIMENT_TAGS, drop_terms=exclude_terms, lowercase=True, limit=limit)
    word = lambda t: F.concat_ws("/", t["surface"], F.substring_index(t["tag"], "+", 1)) if with_tag else t["surface"]
    return rows.select("doc_id", F.transform("tokens", word).alias("terms"))
