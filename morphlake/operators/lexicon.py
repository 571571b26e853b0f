"""Lexicon scores of documents, their explanation, and the term lists they are made of.

Lexicons are tables (term, pos, neg, pol): pos is 1, neg is -1, pol any value, each null if absent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import SLICE, bounded_batches
from ..functions.porter import english_words, stem_column, stemmed
from ..functions.tagset import EPSILON
from ..functions.tokens import drop_tags, ngrams, phrase, slash
from .phrases import Runs, known_ngrams, longest_terms, map_lists, table_below, topic_runs

# Longest n-gram of each kind of tone lexicon.
TONE_NGRAM = {0: 5, 1: 5, 3: 3, 7: 7, 99: 1}


def explode_terms(docs: DataFrame, column: str = "terms", *more: str) -> DataFrame:
    """row, doc_id, pos and term of every term of (doc_id, terms), and a row with pos -1 for each document.

    ``row`` tells rows apart, so repeated and null ids do no harm.
    """
    terms = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.col(column), F.array().cast("array<string>")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *more, terms.alias("terms"))  # numbered before they are taken apart
    rows = rows.select("row", "doc_id", *more, F.posexplode("terms").alias("pos", "term"))
    return rows.withColumn("pos", F.col("pos") - 1)


def collect_terms(exploded: DataFrame, column: str = "terms", *more: str) -> DataFrame:
    """Documents (doc_id, terms) with their terms in order; a null term is left out."""
    own = F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("pos", "term"))))
    return exploded.groupBy("row", "doc_id", *more).agg(own.alias("own")).select("doc_id", *more, F.transform("own", lambda x: x["term"]).alias(column))


def only_known(docs: DataFrame, known: DataFrame, column: str = "terms", limit: int | None = None) -> DataFrame:
    """doc_id and the array ``column`` without what the table ``known`` (term) lacks; order and repeats stay. Null becomes none.

    A table up to ``limit`` bytes is sent to all tasks; ``limit`` 0 joins.
    """
    words = known.select(F.col("term").alias("known")).where("known is not null").distinct()
    small = table_below(words, limit)
    if small is None:
        rows = explode_terms(docs, column).join(words, F.col("term") == F.col("known"), "left")
        return collect_terms(rows.withColumn("term", F.col("known")), column)
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(small["known"].to_pylist()))
    rows = docs.select("doc_id", F.coalesce(F.col(column), F.array().cast("array<string>")).alias(column))
    return map_lists(rows, column, lambda terms: [t for t in terms if t in sent.value])


def known_runs(words: DataFrame, low: int, high: int, wordset: DataFrame | None = None, vocab: DataFrame | None = None, longest: bool = False, limit: int | None = None) -> DataFrame:
    """Topic n-grams of ``low`` to ``high`` tokens of documents (doc_id, terms): of the words of ``wordset``
    (term), only those of ``vocab`` (term), and with ``longest`` without those that a longer one holds.

    Tables up to ``limit`` bytes are sent to all tasks, and a document is read once, from each token only
    as far as a known n-gram goes on; larger tables are joined. Null terms become none.
    """
    spark, sent = words.sparkSession.sparkContext, {}
    rows = words.select("doc_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    for name, table in (("wordset", wordset), ("vocab", vocab)):
        small = None if table is None else table_below(table.select("term").where("term is not null").distinct(), limit)
        if small is not None:
            terms = small["term"].to_pylist()
            sent[name] = spark.broadcast(Runs(terms) if name == "vocab" else frozenset(terms))
    if wordset is not None and "wordset" not in sent:
        rows = only_known(rows, wordset, limit=0)

    words_sent, vocab_sent = sent.get("wordset"), sent.get("vocab")
    last = longest and (vocab is None or vocab_sent is not None)

    def grams(tokens: list) -> list:
        if words_sent is not None:
            known = words_sent.value
            tokens = [t for t in tokens if t in known]
        found = topic_runs(tokens, low, high, known=None if vocab_sent is None else vocab_sent.value)
        return longest_terms(found) if last else found

    rows = map_lists(rows, "terms", grams)
    if vocab is not None and "vocab" not in sent:
        rows = only_known(rows, vocab, limit=0)
        rows = map_lists(rows, "terms", longest_terms) if longest else rows
    return rows


def tone_terms(words: DataFrame, wordset: DataFrame | None, vocab: DataFrame, kind: int = 1, keep_overlapping: bool = False, limit: int | None = None) -> DataFrame:
    """Terms of documents (doc_id, terms) of slash tokens: known words, their n-grams, and of these the
    known ones without those that a longer one holds. With overlaps, n-grams are taken as they are."""
    high = TONE_NGRAM.get(kind, 0)
    return known_runs(words, 1, high, wordset, None if keep_overlapping else vocab, longest=not keep_overlapping, limit=limit)


def classifier_terms(words: DataFrame, vocab: DataFrame, keep_overlapping: bool = False, limit: int | None = None) -> DataFrame:
    """Known n-grams of two to five of documents (doc_id, terms)."""
    return known_runs(words, 2, 5, None, vocab, longest=not keep_overlapping, limit=limit)


def classifier_features(words: DataFrame, vocab: DataFrame, keep_overlapping: bool = False, limit: int | None = None) -> DataFrame:
    """doc_id and features of documents (doc_id, terms): their words, then their :func:`classifier_terms`. Null terms are none."""
    own = F.coalesce("terms", F.array().cast("array<string>")).alias("terms")
    found = classifier_terms(words.select(F.struct("doc_id", own).alias("doc_id"), own), vocab, keep_overlapping, limit)
    return found.select("doc_id.doc_id", F.concat(F.col("doc_id.terms"), F.col("terms")).alias("features"))


def general_terms(docs: DataFrame, vocab: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Known n-grams of one to three of tagged documents (doc_id, tokens), without symbols.

    A vocabulary up to ``limit`` bytes is sent to all tasks, and only n-grams that it goes on with are made.
    """
    rows = docs.select("doc_id", slash(drop_tags(F.col("tokens"))).alias("terms"))
    small = None if vocab is None else table_below(vocab.select("term").where("term is not null").distinct(), limit)
    if small is not None:
        sent = docs.sparkSession.sparkContext.broadcast(Runs(small["term"].to_pylist()))
        rows = rows.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
        return map_lists(rows, "terms", lambda tokens: known_ngrams(tokens, 1, 3, sent.value))
    rows = rows.select("doc_id", ngrams(F.col("terms"), 1, 3).alias("terms"))
    return rows if vocab is None else only_known(rows, vocab, limit=0)


def english_terms(docs: DataFrame, stoplist: DataFrame | None = None) -> DataFrame:
    """Stems of the words of documents (doc_id, text), without those of the stoplist (stem)."""
    words = explode_terms(docs.select("doc_id", english_words(F.col("text")).alias("words")), "words")
    words = stemmed(words.withColumnRenamed("term", "word"))
    if stoplist is not None:
        words = words.join(stoplist.select("stem").distinct(), "stem", "left_anti")
    return collect_terms(words.withColumnRenamed("stem", "term"))


def stem_lexicon(words: DataFrame, stoplist: DataFrame | None = None) -> DataFrame:
    """Lexicon of rows (word, positive, negative): the first stem of each entry that the stoplist (stem)
    lacks, positive before negative."""
    rows = words.where(F.col("positive") | F.col("negative")).select(F.monotonically_increasing_id().alias("entry"), "positive", "negative", english_words(F.col("word")).alias("parts"))
    rows = rows.select("entry", "positive", "negative", F.posexplode("parts").alias("pos", "part"))
    rows = rows.withColumn("stem", stem_column("part"))
    if stoplist is not None:
        rows = rows.join(stoplist.select("stem").distinct(), "stem", "left_anti")
    rows = rows.groupBy("entry", "positive", "negative").agg(F.min_by("stem", "pos").alias("term"))
    both = rows.groupBy("term").agg(F.max(F.when(F.col("positive"), 1)).alias("pos"), F.min(F.when(F.col("negative"), -1)).alias("neg"))
    return both.withColumn("pol", F.lit(None).cast("double"))


def _scored(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Exploded terms with their score (by count) and pol (by value)."""
    known = lexicon.select(F.col("term").alias("known"), F.coalesce("pos", "neg", F.lit(0)).cast("double").alias("score"), F.coalesce("pol", F.lit(0.0)).alias("pol"))
    rows = rows.join(known, F.col("term") == F.col("known"), "left").drop("known")
    return rows.withColumns({"score": F.coalesce("score", F.lit(0.0)), "pol": F.coalesce("pol", F.lit(0.0))})


def term_scores(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, pos, term, score (by count) and pol of every term of (doc_id, terms)."""
    rows = docs.select("doc_id", F.posexplode("terms").alias("pos", "term"))
    return _scored(rows, lexicon).select("doc_id", "pos", "term", "score", "pol")


#: What a document's score is made of; sums of its parts add up to its own.
SUMS = ("positive", "negative", "hits", "n")


def _sums(value: Column) -> list[Column]:
    """SUMS of exploded terms and their values."""
    return [
        F.sum(F.when(value > 0, value).otherwise(0.0)).alias("positive"), F.sum(F.when(value < 0, value).otherwise(0.0)).alias("negative"),
        F.count_if(value != 0).alias("hits"), F.count_if(F.col("pos") >= 0).alias("n"),
    ]


def from_sums(sums: DataFrame, by_count: bool = True, *more: str | Column) -> DataFrame:
    """doc_id, positive, negative, polarity and subjectivity of rows (doc_id, SUMS)."""
    p, n, size = F.col("positive"), F.col("negative"), F.col("n") + EPSILON
    polarity = (p + n) / ((p - n) + EPSILON) if by_count else (p + n) / size
    return sums.select("doc_id", "positive", "negative", polarity.alias("polarity"), (F.col("hits") / size).alias("subjectivity"), *more)


def partial_sums(docs: DataFrame, lexicon: DataFrame, by_count: bool = True) -> DataFrame:
    """doc_id and SUMS of documents (doc_id, terms), whose rows may be parts of documents.

    Works on streams too, where it keeps these four numbers of each document as state.
    """
    terms = F.concat(F.array(F.lit(None).cast("string")), F.coalesce("terms", F.array().cast("array<string>")))
    rows = docs.select("doc_id", F.posexplode(terms).alias("pos", "term")).withColumn("pos", F.col("pos") - 1)
    return _scored(rows, lexicon).groupBy("doc_id").agg(*_sums(F.col("score" if by_count else "pol")))


def score(docs: DataFrame, lexicon: DataFrame, by_count: bool = True, with_breakdown: bool = False, limit: int | None = None) -> DataFrame:
    """doc_id, positive, negative, polarity and subjectivity of every row; those without terms score zero.

    ``with_breakdown`` adds the array ``breakdown`` of term, score, polarity and sentiment of each term in order.
    A lexicon up to ``limit`` bytes is sent to all tasks and no term leaves its document; a larger one, or one
    with a term twice, is joined.
    """
    value = F.coalesce("pos", "neg", F.lit(0)).cast("double") if by_count else F.coalesce("pol", F.lit(0.0))
    small = table_below(lexicon.select("term", value.alias("s")).where("term is not null"), limit)
    known = None if small is None else dict(zip(small["term"].to_pylist(), small["s"].to_pylist(), strict=True))
    explained = F.transform("own", lambda x: F.struct(x["term"].alias("term"), x["s"].alias("score"), x["s"].alias("polarity"), _sentiment(x["s"]).alias("sentiment")))
    if known is not None and len(known) == len(small):
        return from_sums(_summed(docs, known, with_breakdown), by_count, *[explained.alias("breakdown")] * with_breakdown)
    rows = _scored(explode_terms(docs), lexicon).withColumn("s", F.col("score" if by_count else "pol"))
    own = F.array_sort(F.collect_list(F.when(F.col("pos") >= 0, F.struct("pos", "term", "s")))).alias("own")
    sums = rows.groupBy("row", "doc_id").agg(*_sums(F.col("s")), *[own] * with_breakdown)
    return from_sums(sums, by_count, *[explained.alias("breakdown")] * with_breakdown)


def _summed(docs: DataFrame, known: dict[str, float], with_breakdown: bool) -> DataFrame:
    """doc_id and SUMS of documents (doc_id, terms), with ``own``, their terms and values, if asked for; in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast({t: x for t, x in known.items() if x != 0})
    entry = pa.struct([("term", pa.string()), ("s", pa.float64())])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part, scores = batch.slice(k, SLICE), sent.value
                lists, sums, values = part.column(1), [], []
                for terms in lists.to_pylist():
                    own = [scores.get(t, 0.0) for t in terms or []]
                    hits = [x for x in own if x != 0]
                    sums.append((sum([x for x in hits if x > 0], 0.0), sum([x for x in hits if x < 0], 0.0), len(hits), len(own)))
                    values += own
                kinds = (pa.float64(), pa.float64(), pa.int64(), pa.int64())
                columns = [part.column(0), *[pa.array(x, kind) for x, kind in zip(zip(*sums, strict=True), kinds, strict=True)]]
                if with_breakdown:
                    ends = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
                    flat = pa.StructArray.from_arrays([lists.flatten(), pa.array(values, pa.float64())], fields=list(entry))
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *SUMS, *["own"] * with_breakdown])

    rows = bounded_batches(docs).select("doc_id", "terms")
    more = ", own array<struct<term:string,s:double>>" if with_breakdown else ""
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, positive double, negative double, hits long, n long{more}")


def _sentiment(value: Column) -> Column:
    return F.when(value > 0, "positive").when(value < 0, "negative").otherwise("neutral")


def breakdown(docs: DataFrame, lexicon: DataFrame, by_count: bool = True, phrases: bool = False) -> DataFrame:
    """doc_id, pos, term, score, polarity and sentiment of each term in order; with ``phrases`` the
    plain phrase too, and then scores by count and polarities by value."""
    rows = term_scores(docs, lexicon)
    if phrases:
        return rows.select("doc_id", "pos", "term", phrase(F.col("term")).alias("phrase"), "score", F.col("pol").alias("polarity"), _sentiment(F.col("score")).alias("sentiment"))
    value = F.col("score" if by_count else "pol")
    return rows.select("doc_id", "pos", "term", value.alias("score"), value.alias("polarity"), _sentiment(value).alias("sentiment"))


def class_proportions(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id and the share of each class of ``table`` (ngram, a column a class) over matched terms, with
    repeats; null where nothing matched."""
    classes = [c for c in table.columns if c != "ngram"]
    rows = explode_terms(docs).join(table, F.col("term") == F.col("ngram"), "left")
    sums = rows.groupBy("row", "doc_id").agg(*[F.sum(F.coalesce(F.col(f"`{c}`"), F.lit(0.0))).alias(c) for c in classes])
    total = sum((F.col(f"`{c}`") for c in classes[1:]), F.col(f"`{classes[0]}`"))
    return sums.select("doc_id", *[F.try_divide(F.col(f"`{c}`"), total).alias(c) for c in classes])


def analysis(docs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """doc_id and, for each name, a struct of the shares of the classes of its table, as in :func:`class_proportions`.

    All tables are joined to the same exploded terms, so documents are regrouped once.
    """
    rows = explode_terms(docs)
    sums, out = [], []
    for k, (name, table) in enumerate(tables.items()):
        classes = [c for c in table.columns if c != "ngram"]
        rows = rows.join(table.select(F.col("ngram").alias(f"ngram_{k}"), *[F.col(f"`{c}`").cast("double").alias(f"{k}_{i}") for i, c in enumerate(classes)]), F.col("term") == F.col(f"ngram_{k}"), "left")
        sums += [F.sum(F.coalesce(F.col(f"{k}_{i}"), F.lit(0.0))).alias(f"s{k}_{i}") for i in range(len(classes))]
        total = sum((F.col(f"s{k}_{i}") for i in range(1, len(classes))), F.col(f"s{k}_0"))
        out.append(F.struct(*[F.try_divide(F.col(f"s{k}_{i}"), total).alias(c) for i, c in enumerate(classes)]).alias(name))
    return rows.groupBy("row", "doc_id").agg(*sums).select("doc_id", *out)
