"""Terms of documents: n-grams, known ones and the longest, sent and joined, against plain programs."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from morphlake.functions import tagset as T
from morphlake.functions import tokens as K
from morphlake.operators import lexicon, rewrite
from morphlake.operators.dictionary import Dictionary
from morphlake.operators.phrases import longest_terms


def kept(terms):
    out = []
    for t in sorted(terms, key=len, reverse=True):
        if not any(t in k for k in out):
            out.append(t)
    return out


@given(st.lists(st.text("ab;", max_size=6), max_size=30))
def test_longest_terms(terms):
    assert longest_terms(terms) == kept(terms)


def test_longest_terms_of_many_and_nested():
    rng = random.Random(1)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(600)] + ["a" * n for n in range(1, 300)]
    assert longest_terms([None, *terms]) == kept(terms)
    assert longest_terms([""]) == [""] and longest_terms([None]) == [] and longest_terms(["", "a"]) == ["a"]


def grams(tokens, low, high):
    """N-grams token by token, as they are defined."""
    tag = lambda t: t.split("/")[1] if "/" in t else None
    out = []
    for i in range(len(tokens)):
        for n in range(low, high + 1):
            run = tokens[i : i + n]
            if len(run) == n and tag(run[0]) in T.NGRAM_START_TAGS:
                text = [t for k, t in enumerate(run) if k == 0 or t != run[k - 1]]
                if any(tag(t) == "NNG" for t in text):
                    out.append(";".join(text))
    return out


@pytest.mark.parametrize("limit", [None, 0, 220])  # all tables sent, none, and the smaller one
def test_known_runs(spark, limit):
    rng = random.Random(2)
    units = ["a/NNG", "b/VV", "c/MAG", "a/VA", "bare", "d/XR/x", "aa/NNG"]
    docs = [(k % 5 or None, [rng.choice(units) for _ in range(n)]) for k, n in enumerate((0, 1, 2, 5, 9, 30, 30, 30))] + [(7, None), (7, ["a/NNG"] * 6)]
    words = [u for u in units if u != "c/MAG"]
    vocab = sorted({g for _, tokens in docs for g in grams(tokens or [], 1, 4) if rng.random() < 0.3} | {"a/NNG;zz/NNG", "a/NNG"})
    rows = spark.createDataFrame([(*d, ["clash"]) for d in docs], "doc_id long, terms array<string>, known array<string>")
    table = lambda terms: spark.createDataFrame([(t, 1) for t in [*terms, None, terms[0]]], "term string, known int")
    show = lambda df: sorted(((r["doc_id"], r["terms"]) for r in df.collect()), key=repr)
    only = lambda tokens, known: [t for t in tokens or [] if t in known]
    for high in (3, 4):
        every = [(d, grams(tokens or [], 1, high)) for d, tokens in docs]
        assert show(lexicon.known_runs(rows, 1, high, limit=limit)) == sorted(every, key=repr)
    found = lexicon.tone_terms(rows, table(words), table(vocab), kind=3, limit=limit)
    assert show(found) == sorted(((d, kept(only(grams(only(t, words), 1, 3), vocab))) for d, t in docs), key=repr)
    found = lexicon.classifier_terms(rows, table(vocab), keep_overlapping=True, limit=limit)
    assert show(found) == sorted(((d, only(grams(t or [], 2, 5), vocab)) for d, t in docs), key=repr)
    found = lexicon.classifier_terms(rows, table(vocab), limit=limit)
    assert show(found) == sorted(((d, kept(only(grams(t or [], 2, 5), vocab))) for d, t in docs), key=repr)
    column = rows.where("terms is not null").select("doc_id", K.topic_ngrams(F.col("terms"), 1, 4).alias("terms"))
    assert show(column) == sorted(((d, grams(t, 1, 4)) for d, t in docs if t is not None), key=repr)


@pytest.mark.parametrize("limit", [None, 0])
def test_rewriting_sent_and_joined(spark, limit):
    """All steps in a row, token by token as they are defined, with nulls, repeated ids and a clashing column."""
    words = Dictionary.empty(spark).add_words(["up"], "NNG").add_words(["both"], "NNP").add_words(["both"], "VV").add_synonym("old", "New").add_lemma("go", "gone").add_lemma("gone", "x")
    words = words.add_terms(["firm"], "INDUSTRY").add_terms(["land"], "COUNTRY")
    tokens = [("UP", "XR"), ("Both", "X"), ("Old", "NNG"), ("go", "XSV"), ("Gone", "VV+EC"), ("gone", "VV"), ("Firm", "NNG"), ("land", "NNG"), ("r", "XR"), (None, "NNG"), ("y", None), ("z", "JX")]
    rows = [(1, tokens), (1, tokens[::-1]), (None, tokens[2:5]), (2, []), (3, None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, tokens array<struct<surface:string,tag:string>>, row string")
    known = {"up": "NNG", "both": "NNP", "old": "NNG", "new": "NNG"}

    def retagged(s, t):
        t = known.get((s or "").lower(), t)
        t = t and t.split("+")[0]
        return (s, "NNG" if t == "XR" else t)

    same = lambda s, t: ("new" if s and s.lower() == "old" else s, t)
    root = lambda s, t: ({"go": "gone", "gone": "x"}[s.lower()], "VV" if t == "XSV" else t) if s and s.lower() in ("go", "gone") and t in T.LEMMA_TAGS else (s, t)
    low = lambda s: s and s.lower()
    show = lambda df: sorted(((r["doc_id"], [tuple(t) for t in r["tokens"]]) for r in df.collect()), key=repr)
    each = lambda f: sorted(((i, f(t or [])) for i, t in rows), key=repr)
    assert show(rewrite.rewritten(docs, words, retag=True, limit=limit)) == each(lambda t: [retagged(*x) for x in t])
    assert show(rewrite.rewritten(docs, words, retag=True, synonyms=True, lemmas=True, limit=limit)) == each(lambda t: [root(*same(*retagged(*x))) for x in t])
    assert show(rewrite.nouns(docs, words, limit=limit)) == each(lambda t: [(low(s), x) for s, x in (same(*y) for y in t) if x == "NNG" and low(s) != "firm"])
    found = sorted(((r["doc_id"], r["terms"]) for r in rewrite.sentiment_words(docs, words, limit=limit).collect()), key=repr)
    assert found == each(lambda t: ["/".join(p for p in (low(s), x) if p) for s, x in (root(*same(*y)) for y in t) if x in T.SENTIMENT_TAGS and low(s) not in ("firm", "land")])
