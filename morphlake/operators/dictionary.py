"""User dictionaries as immutable tables, and the rewriting of tagged documents with them.

Documents are rows (doc_id, tokens); dictionaries are joined to exploded tokens, so they may have
any size: Spark broadcasts them below its size threshold and sorts or hashes them beyond it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tagset as T
from ..functions.tokens import pair


#: Place of the row that stands for a document as a whole.
WHOLE = -1


def explode_tokens(docs: DataFrame, keep_row: bool = False) -> DataFrame:
    """row, doc_id, pos, surface and tag of every token of (doc_id, tokens), and a row WHOLE for each document.

    ``row`` tells rows of ``docs`` apart, so repeated and null ids do no harm; with ``keep_row`` it is the
    column of that name, which must tell them apart. Operators here let the row WHOLE pass, so no document
    is lost with its tokens.
    """
    row = F.col("row") if keep_row else F.monotonically_increasing_id()
    none = F.lit(None).cast("string")
    tokens = F.concat(F.array(pair(none, none)), F.coalesce(F.col("tokens"), F.array().cast("array<struct<surface:string,tag:string>>")))
    rows = docs.select(row.alias("row"), "doc_id", tokens.alias("tokens"))  # numbered before they are taken apart
    rows = rows.select("row", "doc_id", F.posexplode("tokens").alias("pos", "token"))
    return rows.select("row", "doc_id", (F.col("pos") - 1).alias("pos"), "token.surface", "token.tag")


def only_tokens(exploded: DataFrame) -> DataFrame:
    return exploded.where(F.col("pos") > WHOLE)


def passing(exploded: DataFrame, condition: Column) -> DataFrame:
    """The tokens for which a condition holds, and the rows WHOLE."""
    return exploded.where((F.col("pos") == WHOLE) | condition)


def collect_tokens(exploded: DataFrame, keep_row: bool = False) -> DataFrame:
    """Documents (doc_id, tokens) with their tokens in order of ``pos``; those that lost all keep an empty array."""
    own = F.array_sort(F.collect_list(F.when(F.col("pos") > WHOLE, F.struct("pos", "surface", "tag"))))
    rows = exploded.groupBy("row", "doc_id").agg(own.alias("own"))
    return rows.select(*["row"] * keep_row, "doc_id", F.transform("own", lambda t: pair(t["surface"], t["tag"])).alias("tokens"))


@dataclass(frozen=True)
class Dictionary:
    """words (word, tag, prio), terms (word, category), synonyms (src, dst) and lemmas (src, dst).

    Methods that add return a new dictionary. ``ranks`` has the priority of each tag; without it, it is
    read from the words when a method first needs it.
    """

    words: DataFrame
    terms: DataFrame
    synonyms: DataFrame
    lemmas: DataFrame
    ranks: tuple[tuple[str, int], ...] | None = None

    @classmethod
    def empty(cls, spark: SparkSession) -> Dictionary:
        table = lambda schema: spark.createDataFrame([], schema)
        return cls(table("word string, tag string, prio int"), table("word string, category string"), table("src string, dst string"), table("src string, dst string"), ())

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.words.sparkSession.createDataFrame(rows, schema)

    def _ranked(self, tag: str) -> dict:
        """``ranks`` with the tag, after all others if it is new."""
        ranks = self.ranks
        if ranks is None:
            ranks = tuple((r["tag"], r["prio"]) for r in self.words.groupBy("tag").agg(F.min("prio").alias("prio")).collect())
        known = dict(ranks)
        known.setdefault(tag, max(known.values(), default=0) + 1)
        return known

    @classmethod
    def load(cls, spark: SparkSession, words: Iterable[tuple[str, str]] = (), terms: Iterable[tuple[str, str]] = (), synonyms: Iterable[tuple[str, str]] = (), lemmas: Iterable[str] = ()) -> Dictionary:
        """From files: words (path, tag) in falling priority of their tags, terms (path, category),
        synonyms (path, tag), of which later ones win, and lemmas (path)."""
        from ..sources.wordlists import load_dictionary, load_vocab

        out = cls.empty(spark)
        for path, tag in words:
            out = out.add_table(load_dictionary(spark, path), tag)
        for path, category in terms:
            out = out.add_term_table(load_dictionary(spark, path), category)
        for path, tag in synonyms:
            out = out.add_synonyms(load_vocab(spark, path), tag)
        for path in lemmas:
            out = out.add_lemmas(load_vocab(spark, path))
        return out

    def add_words(self, words: Iterable[str] | str, tag: str, force: bool = False) -> Dictionary:
        """Words under a tag; a tag seen first keeps its priority. Unknown tags need ``force``."""
        if tag not in T.TAGS and not force:
            raise ValueError(f"unknown tag {tag}")
        ranks = self._ranked(tag)
        rows = [(w, tag, ranks[tag]) for w in ([words] if isinstance(words, str) else words)]
        return replace(self, words=self.words.unionByName(self._rows(rows, "word string, tag string, prio int")).distinct(), ranks=tuple(ranks.items()))

    def add_table(self, words: DataFrame, tag: str, force: bool = False) -> Dictionary:
        """The words of a table (word) under a tag."""
        if tag not in T.TAGS and not force:
            raise ValueError(f"unknown tag {tag}")
        ranks = self._ranked(tag)
        return replace(self, words=self.words.unionByName(words.select("word", F.lit(tag).alias("tag"), F.lit(ranks[tag]).alias("prio"))).distinct(), ranks=tuple(ranks.items()))

    def add_terms(self, words: Iterable[str] | str, category: str, compat: bool = False) -> Dictionary:
        """Terms of a category; with ``compat`` they become words under that name instead."""
        if category not in T.TERM_CATEGORIES:
            raise ValueError(f"unknown category {category}")
        if compat:
            return self.add_words(words, category, force=True)
        rows = self._rows([(w,) for w in ([words] if isinstance(words, str) else words)], "word string")
        return self.add_term_table(rows, category)

    def add_term_table(self, words: DataFrame, category: str) -> Dictionary:
        """The words of a table (word) as terms of a category."""
        if category not in T.TERM_CATEGORIES:
            raise ValueError(f"unknown category {category}")
        return replace(self, terms=self.terms.unionByName(words.select("word", F.lit(category).alias("category"))).distinct())

    def add_synonym(self, word: str, synonym: str, tag: str = "NNG") -> Dictionary:
        one = self._rows([(word.lower(), synonym.lower())], "src string, dst string")
        return replace(self.add_words([word, synonym], tag), synonyms=self.synonyms.where(F.col("src") != word.lower()).unionByName(one))

    def add_synonyms(self, mapping: DataFrame, tag: str = "NNG") -> Dictionary:
        """A mapping (src, dst) whose both sides become words."""
        both = mapping.select(F.explode(F.array("src", "dst")).alias("word")).distinct()
        rest = self.synonyms.join(mapping.select("src"), "src", "left_anti")
        return replace(self.add_table(both, tag), synonyms=rest.unionByName(mapping.select("src", "dst")))

    def add_lemma(self, word: str, lemma: str) -> Dictionary:
        one = self._rows([(word, lemma)], "src string, dst string")
        return replace(self, lemmas=self.lemmas.where(F.col("src") != word).unionByName(one))

    def add_lemmas(self, mapping: DataFrame) -> Dictionary:
        rest = self.lemmas.join(mapping.select("src"), "src", "left_anti")
        return replace(self, lemmas=rest.unionByName(mapping.select("src", "dst")))

    def tag_of(self) -> DataFrame:
        """word and the tag of the highest priority."""
        return self.words.groupBy("word").agg(F.min_by("tag", "prio").alias("dict_tag"))

    def with_tag(self, words: DataFrame, column: str = "word") -> DataFrame:
        """``words`` with dict_tag, null for unknown words; looked up in lower case."""
        found = self.tag_of().withColumnRenamed("word", "known")
        return words.join(found, F.lower(column) == F.col("known"), "left").drop("known")

    def having(self, words: DataFrame, column: str = "word", tag: str | None = None, known: bool = True) -> DataFrame:
        """The rows whose word is in the dictionary, or with ``known=False`` is not.

        Under a tag that the dictionary has, in that tag's words; otherwise in those of any tag.
        """
        rows = self.words
        if tag is not None and (any(t == tag for t, _ in self.ranks) if self.ranks is not None else not rows.where(F.col("tag") == tag).isEmpty()):
            rows = rows.where(F.col("tag") == tag)
        rows = rows.select(F.col("word").alias("known")).distinct()
        return words.join(rows, F.lower(column) == F.col("known"), "left_semi" if known else "left_anti")

    def retag(self, exploded: DataFrame) -> DataFrame:
        """Tag of the dictionary, else the first part of a compound tag; a root becomes a noun."""
        rows = self.with_tag(exploded, "surface")
        tag = F.substring_index(F.coalesce("dict_tag", "tag"), "+", 1)
        return rows.withColumn("tag", F.when(tag == "XR", "NNG").otherwise(tag)).drop("dict_tag")

    def replace_synonyms(self, exploded: DataFrame) -> DataFrame:
        rows = exploded.join(self.synonyms.select("src", F.lower("dst").alias("dst")), F.lower("surface") == F.col("src"), "left")
        return rows.withColumn("surface", F.coalesce("dst", "surface")).drop("src", "dst")

    def lemmatize(self, exploded: DataFrame) -> DataFrame:
        """One hop, for verbs, adjectives and adverbs; a verb suffix that is replaced becomes a verb."""
        rows = exploded.join(self.lemmas, F.col("tag").isin(*T.LEMMA_TAGS) & (F.lower("surface") == F.col("src")), "left")
        tag = F.when(F.col("src").isNotNull() & (F.col("tag") == "XSV"), "VV").otherwise(F.col("tag"))
        return rows.withColumn("tag", tag).withColumn("surface", F.coalesce("dst", "surface")).drop("src", "dst")

    def without_terms(self, exploded: DataFrame, categories: Iterable[str] | None = None) -> DataFrame:
        """Without words that are terms of some categories, of any if none are given."""
        rows = self.terms if categories is None else self.terms.where(F.col("category").isin(*categories))
        return exploded.join(rows.select(F.col("word").alias("term")).distinct(), F.lower("surface") == F.col("term"), "left_anti")

    def nouns(self, exploded: DataFrame, replace_synonyms: bool = True, industry: bool = False, generic: bool = False, sector: bool = False, country: bool = True) -> DataFrame:
        """Lower-case nouns; each flag says whether terms of that category stay."""
        rows = self.replace_synonyms(exploded) if replace_synonyms else exploded
        dropped = [c for c, keep in (("INDUSTRY", industry), ("GENERIC", generic), ("SECTOR", sector), ("COUNTRY", country)) if not keep]
        rows = passing(rows, F.col("tag").isin(*T.TOPIC_TAGS))
        return (self.without_terms(rows, dropped) if dropped else rows).withColumn("surface", F.lower("surface"))

    def sentiment_words(self, exploded: DataFrame, replace_synonyms: bool = True, lemmatize: bool = True, exclude_terms: bool = True, with_tag: bool = True) -> DataFrame:
        """Exploded tokens that bear sentiment, with ``word``, lower-case ``word/TAG``."""
        rows = self.replace_synonyms(exploded) if replace_synonyms else exploded
        rows = self.lemmatize(rows) if lemmatize else rows
        rows = passing(rows, F.col("tag").isin(*T.SENTIMENT_TAGS))
        rows = self.without_terms(rows) if exclude_terms else rows
        word = F.concat_ws("/", F.lower("surface"), F.substring_index("tag", "+", 1)) if with_tag else F.lower("surface")
        return rows.withColumn("word", word)


def _matches(rows: DataFrame, how: str, exploded: DataFrame) -> DataFrame:
    """Semi or anti join with rows (word, tag): an entry without a tag holds for every tag."""
    tagged = rows.where("tag is not null").select(F.struct("word", "tag").alias("key"))
    bare = rows.where("tag is null").select("word")
    flagged = exploded.join(tagged.distinct().withColumn("a", F.lit(True)), F.struct(F.col("surface").alias("word"), F.col("tag")) == F.col("key"), "left")
    flagged = flagged.join(bare.distinct().withColumn("b", F.lit(True)), F.col("surface") == F.col("word"), "left")
    hit = F.coalesce("a", F.lit(False)) | F.coalesce("b", F.lit(False))
    return passing(flagged, hit if how == "semi" else ~hit).drop("a", "b", "key", "word")


def postprocess(exploded: DataFrame, stopwords: DataFrame | None = None, passwords: DataFrame | None = None, passtags: Iterable[str] | None = None, replacements: DataFrame | None = None) -> DataFrame:
    """Drop stopwords, keep passwords, keep tags, then replace; each step only if it is given.

    Word tables have (word, tag), the tag null for any; replacements (word, tag, new_word, new_tag):
    an entry with the tag goes before one without, a null new_tag keeps the tag.
    """
    rows = exploded
    if stopwords is not None:
        rows = _matches(stopwords, "anti", rows)
    if passwords is not None:
        rows = _matches(passwords, "semi", rows)
    if passtags:
        rows = passing(rows, F.col("tag").isin(*passtags))
    if replacements is not None:
        exact = replacements.where("tag is not null").select(F.col("word").alias("w1"), F.col("tag").alias("t1"), F.struct("new_word", "new_tag").alias("r1"))
        loose = replacements.where("tag is null").select(F.col("word").alias("w2"), F.struct("new_word", "new_tag").alias("r2"))
        rows = rows.join(exact, (F.col("surface") == F.col("w1")) & (F.col("tag") == F.col("t1")), "left").join(loose, F.col("surface") == F.col("w2"), "left")
        new: Column = F.coalesce("r1", "r2")
        rows = rows.select("row", "doc_id", "pos", F.coalesce(new["new_word"], F.col("surface")).alias("surface"), F.coalesce(new["new_tag"], F.col("tag")).alias("tag"))
    return rows
