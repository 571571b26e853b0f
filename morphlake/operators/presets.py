"""Scorers as they are used: a lexicon, and how the terms of a document are made for it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import drop_auxiliaries
from ..sources import wordlists
from . import bayes, lexicon, rewrite
from .analyze import Analyzer
from .dictionary import Dictionary
from .merge import extended_tags


@dataclass(frozen=True)
class Scorer:
    """``terms`` makes (doc_id, terms) of documents; ``lexicon`` is (term, pos, neg, pol)."""

    lexicon: DataFrame
    terms: Callable[[DataFrame], DataFrame]

    def score(self, docs: DataFrame, by_count: bool = True, with_breakdown: bool = False) -> DataFrame:
        return lexicon.score(self.terms(docs), self.lexicon, by_count, with_breakdown)

    def breakdown(self, docs: DataFrame, by_count: bool = True) -> DataFrame:
        return lexicon.breakdown(self.terms(docs), self.lexicon, by_count)

    def phrases(self, docs: DataFrame) -> DataFrame:
        return lexicon.breakdown(self.terms(docs), self.lexicon, phrases=True)


def tone(rows: DataFrame, wordset: DataFrame, kind: int = 0, cutoff: float | None = None) -> Scorer:
    """Monetary tone: rows of a polarity lexicon (word, polarity, score, intensity) and the known words (term).

    Documents are (doc_id, terms) of sentiment words.
    """
    own = wordlists.polarity_lexicon(rows, kind, cutoff)
    return Scorer(own, lambda docs: lexicon.tone_terms(docs, wordset, own, kind))


def uncertainty(rows: DataFrame, wordset: DataFrame, kind: int = 0, cutoff: float | None = None) -> Scorer:
    """Economic uncertainty: as :func:`tone`, but every n-gram counts as a term, in the lexicon or not."""
    own = wordlists.uncertainty_lexicon(rows, kind, cutoff)
    return Scorer(own, lambda docs: lexicon.tone_terms(docs, wordset, own, kind, keep_overlapping=True))


def general(rows: DataFrame) -> Scorer:
    """General sentiment: n-gram shares (ngram, neg_share, pos_share); documents are (doc_id, tokens)."""
    own = wordlists.class_lexicon(rows)
    return Scorer(own, lambda docs: lexicon.general_terms(docs, own))


def english(words: DataFrame, stoplist: DataFrame | None = None) -> Scorer:
    """English word lists (word, positive, negative), stemmed; documents are (doc_id, text).

    Made for what ``wordlists.load_harvard`` and ``wordlists.load_finance`` read.
    """
    own = lexicon.stem_lexicon(words, stoplist)
    return Scorer(own, lambda docs: lexicon.english_terms(docs, stoplist))


@dataclass(frozen=True)
class Tagger:
    """From texts (doc_id, text) to tokens: the analyser alone, or with a dictionary its extended mode."""

    analyzer: Analyzer
    dictionary: Dictionary | None = None

    def tag(self, docs: DataFrame, max_ngram: int = 7) -> DataFrame:
        tokens = docs.select("doc_id", self.analyzer.tagged(docs["text"]).alias("tokens"))
        return tokens if self.dictionary is None else extended_tags(tokens, self.dictionary, max_ngram)

    def nouns(self, docs: DataFrame, **options) -> DataFrame:
        if self.dictionary is None:
            raise ValueError("nouns without terms need a dictionary; functions.tokens.base_nouns does without")
        return rewrite.nouns(self.tag(docs), self.dictionary, **options)

    def sentiment_words(self, docs: DataFrame, **options) -> DataFrame:
        """doc_id and terms, the slash words of texts that bear sentiment."""
        if self.dictionary is None:
            raise ValueError("sentiment words need a dictionary")
        return rewrite.sentiment_words(self.tag(docs), self.dictionary, **options)


@dataclass(frozen=True)
class TextScorer:
    """From texts (doc_id, text) to scores: tags, sentiment words, n-grams and the lexicon in one chain.

    ``scorer`` is one of :func:`tone` or :func:`uncertainty`. Texts without words, null ones too, score zero.
    """

    tagger: Tagger
    scorer: Scorer

    def tokenize(self, docs: DataFrame) -> DataFrame:
        """doc_id and terms as they are scored."""
        return self.scorer.terms(self.tagger.sentiment_words(docs))

    def score(self, docs: DataFrame, by_count: bool = True, with_breakdown: bool = False) -> DataFrame:
        return self.scorer.score(self.tagger.sentiment_words(docs), by_count, with_breakdown)

    def phrases(self, docs: DataFrame) -> DataFrame:
        return self.scorer.phrases(self.tagger.sentiment_words(docs))


@dataclass(frozen=True)
class TextClassifier:
    """From texts (doc_id, text) to the tone of a trained classifier in one chain: tags, sentiment words without
    auxiliaries, their n-grams of two to five words in ``vocab`` (term), and the model.

    Null and empty texts have no features and get what the sizes of the classes say. Repeated rows are each returned.
    """

    tagger: Tagger
    vocab: DataFrame
    model: bayes.Model | None = None

    def tokenize(self, docs: DataFrame) -> DataFrame:
        """doc_id and terms, the words that tell tone."""
        return self.tagger.sentiment_words(docs).withColumn("terms", drop_auxiliaries(F.col("terms")))

    def features(self, docs: DataFrame, keep_overlapping: bool = False) -> DataFrame:
        return lexicon.classifier_features(self.tokenize(docs), self.vocab, keep_overlapping)

    def fit(self, docs: DataFrame, features: str = "word", best_ratio: float = 0.8) -> TextClassifier:
        """This chain with a model of texts (doc_id, text, label), label 1 or -1; other labels and null ones teach nothing."""
        known = docs.where(F.col("label").isin(1, -1)).select(F.struct("doc_id", "label").alias("doc_id"), "text")
        rows = self.features(known).select("doc_id.doc_id", "doc_id.label", "features")
        return replace(self, model=bayes.fit(rows, features, best_ratio))

    def classify(self, docs: DataFrame, cutoff: float = 1.3) -> DataFrame:
        """doc_id, polarity, intensity, pos_score and neg_score of every row."""
        if self.model is None:
            raise ValueError("classifying needs a model: fit one, or load a saved one")
        return self.model.classify(self.features(docs), cutoff)
