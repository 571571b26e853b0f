"""Small fixtures for functions, readers, scores and the classifier."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from morphlake.functions import tokens as K
from morphlake.functions.porter import stem
from morphlake.operators import bayes, lexicon
from morphlake.operators.analyze import DictionaryAnalyzer, PretaggedAnalyzer
from morphlake.operators.dictionary import Dictionary, collect_tokens, explode_tokens
from morphlake.operators.userdic import UserDictionary
from morphlake.sources import wordlists

TOKENS = "doc_id long, tokens array<struct<surface:string,tag:string>>"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word,expected", [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("hopefulness", "hope"), ("electricity", "electr"), ("adjustment", "adjust"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("dying", "die"), ("sky", "sky"), ("enjoy", "enjoy"), ("say", "say")])
def test_stems(word, expected):
    assert stem(word) == expected


def test_ngrams(spark):
    assert one(spark, K.ngrams(F.array(*map(F.lit, "abc")), 1, 2)) == ["a", "a;b", "b", "b;c", "c"]
    words = F.array(*map(F.lit, ["x/NNG", "x/NNG", "y/VV", "z/NNG"]))
    assert one(spark, K.topic_ngrams(words, 1, 3)) == ["x/NNG", "x/NNG", "x/NNG;y/VV", "x/NNG", "x/NNG;y/VV", "x/NNG;y/VV;z/NNG", "z/NNG"]
    assert one(spark, K.phrase(F.lit("a/NNG;b/NNG"))) == "ab" and one(spark, K.phrase(F.lit("a/b/NNG"))) == "a/b/NNG"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=4), max_size=8))
def test_containment(terms):
    from pyspark.sql import SparkSession

    kept = []
    for t in sorted(terms, key=len, reverse=True):
        if not any(t in k for k in kept):
            kept.append(t)
    df = SparkSession.getActiveSession().createDataFrame([(terms,)], "t array<string>")
    assert df.select(K.longest_only(F.col("t")).alias("x")).first()["x"] == kept


def test_containment_of_all_ngrams(spark, tmp_path):
    """The query keeps what comparing all pairs of n-grams of one to five words keeps."""
    import hashlib
    import random

    from morphlake.plans import catalogue

    rng = random.Random(4)
    docs = [[], ["a"], ["a", "a"], ["ba", "b", "c", "d", "ea", "a", "b", "c", "d", "e"]]
    docs += [["".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(n)] for n in (3, 5, 6, 12, 60, 60)]
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, words in enumerate(docs):
        kept = []
        for t in sorted([";".join(words[k : k + n]) for k in range(len(words)) for n in range(1, 6) if k + n <= len(words)], key=len, reverse=True):
            if not any(t in x for x in kept):
                kept.append(t)
        expected.append((i, len(kept), hashlib.md5(" ".join(kept).encode()).hexdigest()))
    found = catalogue.QUERIES["ngram_containment_all"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == expected


def test_bagging_query(spark, tmp_path):
    from morphlake.plans import catalogue

    docs = [(i, ("good fine " if i % 2 else "bad poor ") * 3, i % 2) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    df.select("doc_id", "quality").write.parquet(f"{tmp_path}/labels.parquet")
    rows = catalogue.QUERIES["bagging"](spark, str(tmp_path))
    assert sorted(r["iteration"] for r in rows.collect()) == list(range(1, 21))
    summary = catalogue.QUERIES["bagging_summary"](spark, str(tmp_path)).collect()
    assert len(summary) == 1 and 1 <= summary[0]["best_iteration"] <= 20 and 0 <= summary[0]["accuracy"] <= 1


def test_score_formulas(spark):
    docs = spark.createDataFrame([(0, ["up"]), (1, ["down", "x"]), (2, [])], "doc_id long, terms array<string>")
    lex = spark.createDataFrame([("up", 1, None, 0.5), ("down", None, -1, -0.25)], "term string, pos int, neg int, pol double")
    rows = {r["doc_id"]: r for r in lexicon.score(docs, lex).collect()}
    assert rows[0]["polarity"] == rows[0]["subjectivity"] == 1 / (1 + 1e-6)
    assert (rows[1]["positive"], rows[1]["negative"]) == (0, -1) and rows[2]["polarity"] == 0
    assert {r["doc_id"]: r["polarity"] for r in lexicon.score(docs, lex, by_count=False).collect()}[1] == pytest.approx(-0.25 / (2 + 1e-6))
    found = lexicon.breakdown(docs, lex).orderBy("doc_id", "pos").collect()
    assert [(r["term"], r["sentiment"]) for r in found] == [("up", "positive"), ("down", "negative"), ("x", "neutral")]


def test_bayes(spark):
    data = [(0, 1, ["a", "b"]), (1, 1, ["a"]), (2, -1, ["b", "c"])]
    docs = spark.createDataFrame(data, "doc_id long, label int, features array<string>")
    model = {r["feature"]: (math.exp(r["logp_pos"]), math.exp(r["logp_neg"])) for r in bayes.conditionals(docs).collect()}
    assert model["a"] == pytest.approx((2.5 / 3, 0.5 / 2)) and model["b"] == pytest.approx((1.5 / 3, 1.5 / 2))
    new = spark.createDataFrame([(9, ["a", "unseen"]), (8, [])], "doc_id long, features array<string>")
    out = {r["doc_id"]: r for r in bayes.classify(new, bayes.conditionals(docs), bayes.label_counts(docs)).collect()}
    p, n = 2.5 / 4 * 2.5 / 3, 1.5 / 4 * 0.5 / 2
    assert out[9]["pos_score"] == pytest.approx(p / (p + n)) and out[8]["pos_score"] == pytest.approx(2.5 / 4)
    assert out[9]["polarity"] == pytest.approx((p - n) / (p + n))
    even = bayes.classify(new.where("doc_id = 8"), bayes.conditionals(docs), bayes.label_counts(docs), cutoff=10.0).first()
    assert even["polarity"] == 0
    metrics = bayes.bagging(docs.union(docs.select(F.col("doc_id") + 10, "label", "features")), iterations=2, ratio=0.5)
    assert metrics.count() == 2 and bayes.bagging_summary(metrics).count() == 1


def test_rewriting(spark):
    docs = spark.createDataFrame([(0, [("Old", "NNG"), ("go", "XSV"), ("run", "NNG")]), (1, [])], TOKENS)
    d = Dictionary.empty(spark).add_synonym("old", "New").add_lemma("go", "gone").add_lemma("gone", "x").add_terms(["run"], "INDUSTRY").add_words(["both"], "NNP").add_words(["both"], "VV")
    text = lambda rows: {r["doc_id"]: [tuple(t) for t in r["tokens"]] for r in collect_tokens(rows).collect()}
    assert text(d.replace_synonyms(explode_tokens(docs))) == {0: [("new", "NNG"), ("go", "XSV"), ("run", "NNG")], 1: []}
    assert text(d.lemmatize(explode_tokens(docs)))[0][1] == ("gone", "VV")
    assert text(d.nouns(explode_tokens(docs)))[0] == [("new", "NNG")]
    assert d.with_tag(spark.createDataFrame([("BOTH",)], "word string")).first()["dict_tag"] == "NNP"
    with pytest.raises(ValueError):
        d.add_words(["x"], "NOPE")


def test_readers(spark, tmp_path):
    (tmp_path / "d.txt").write_text(" Ab C \nab c\n\n")
    assert sorted(r["word"] for r in wordlists.load_dictionary(spark, f"file://{tmp_path}/d.txt").collect()) == ["", "abc"]
    (tmp_path / "v.txt").write_text("A,b,c\na, D\nnone\n")
    assert [tuple(r) for r in wordlists.load_vocab(spark, f"file://{tmp_path}/v.txt").collect()] == [("a", "d")]
    (tmp_path / "w.txt").write_text("x/NNG;y/NNG 3\n# no\nz 1\nlong/NNG\n")
    assert [r["word"] for r in wordlists.load_wordlist(spark, f"file://{tmp_path}/w.txt").collect()] == ["long/NNG", "x/NNG;y/NNG", "z"]
    assert [r["word"] for r in wordlists.load_wordlist(spark, f"file://{tmp_path}/w.txt", max_ngram=1, remove_tag=True, lowercase=True).collect()] == ["long", "x", "z"]
    (tmp_path / "s.txt").write_bytes("CÓRDOBA  | place\nrunning\n".encode())
    assert sorted(r["stem"] for r in wordlists.load_stoplist(spark, f"file://{tmp_path}/s.txt").collect()) == ["cã", "run"]


def test_user_dictionary_and_analysis(spark):
    ids = spark.createDataFrame([(0, "1", "NNP", "*", "T"), (1, "2", "NNP", "*", "F")], "line_no int, id string, pos string, semantic string, has_jongseong string")
    words = spark.createDataFrame([("금리",), ("상승",), ("금리상승",)], "surface string")
    own = UserDictionary(spark.createDataFrame([], wordlists.USER_SCHEMA), ids, ids).add(words).adjust_costs(500)
    entries = {r["surface"]: (r["left_id"], r["right_id"], r["cost"]) for r in own.entries.collect()}
    assert entries == {"금리": ("1", "2", 500), "상승": ("1", "1", 500), "금리상승": ("1", "1", 500)}
    text = spark.createDataFrame([("금리상승 12%",), (None,)], "text string")
    out = [[tuple(t) for t in r["x"]] for r in text.select(DictionaryAnalyzer(own.entries).tagged(F.col("text")).alias("x")).collect()]
    assert out == [[("금리상승", "NNP"), ("12", "SN"), ("%", "SY")], []]
    assert [tuple(t) for t in one(spark, PretaggedAnalyzer().tagged(F.lit("a/b/NNG c/VV")))] == [("a/b", "NNG"), ("c", "VV")]


def test_stream(spark, tmp_path):
    from morphlake.streaming import read_documents, write

    spark.createDataFrame([(1, [("a", "NNG"), (".", "SF")])], TOKENS).write.parquet(f"{tmp_path}/in")
    stream = read_documents(spark, f"{tmp_path}/in", TOKENS).select("doc_id", K.slash(K.drop_tags(F.col("tokens"))).alias("terms"))
    write(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    assert [r["terms"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [["a/NNG"]]


def plain_score(parts, lex):
    values = [lex.get(t, 0) for terms in parts for t in terms or []]
    p, n = sum(v for v in values if v > 0), sum(v for v in values if v < 0)
    return (p, n, (p + n) / (p - n + 1e-6), sum(v != 0 for v in values) / (len(values) + 1e-6))


def test_scores_of_parts_with_a_changing_lexicon(spark, tmp_path):
    from morphlake import streaming
    from morphlake.sources import versions

    lex = lambda up: spark.createDataFrame([(up, 1, None, 0.5), ("down", None, -1, -0.5)], "term string, pos int, neg int, pol double")
    first, second = [(1, ["up", "x"]), (2, None), (None, ["down"]), (1, ["down"])], [(1, ["up", "new"]), (3, ["new"]), (None, [])]
    found = lambda df: {r["doc_id"]: tuple(r)[1:] for r in df.collect()}
    path, schema = f"file://{tmp_path}/lexicon", "doc_id long, terms array<string>"
    for rows, up in ((first, "up"), (second, "new")):
        versions.write(lex(up), path)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streaming.read_documents(spark, f"{tmp_path}/in", schema)
        streaming.score_parts(stream, path, f"{tmp_path}/sums", f"{tmp_path}/check").awaitTermination(120)
    value = lambda d: ([t for i, t in first if i == d], [t for i, t in second if i == d])
    expected = {}
    for d in (1, 2, 3, None):  # the old lexicon for the first batch, the new one for the second
        a, b = value(d)
        both = [[{"up": "+", "down": "-"}.get(t, t) for t in x or []] for x in a] + [[{"new": "+", "down": "-"}.get(t, t) for t in x or []] for x in b]
        expected[d] = pytest.approx(plain_score(both, {"+": 1, "-": -1}))
    assert found(streaming.scores(spark, f"{tmp_path}/sums")) == expected
    streaming.add_parts(spark.createDataFrame(second, schema), lex("new"), f"{tmp_path}/sums", 1)  # a batch that is run again
    assert found(streaming.scores(spark, f"{tmp_path}/sums")) == expected
    query = streaming.running_scores(streaming.read_documents(spark, f"{tmp_path}/in", schema), lex("up")).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert found(spark.table("running")) == {d: pytest.approx(plain_score(sum(value(d), []), {"up": 1, "down": -1})) for d in (1, 2, 3, None)}


def test_spaces_of_a_long_text(spark):
    rows = [(1, [("a", "X"), ("b", "X"), ("zz", "X"), ("c", "X")], " a b\x1c\u3000cc"), (2, None, "x"), (3, [], " "), (4, [("a", "X")], None), (5, [(None, "X"), ("b", None)], "a b")]
    df = spark.createDataFrame(rows, "i int, t array<struct<surface:string,tag:string>>, text string")
    found = {r["i"]: r["x"] and [x["surface"] for x in r["x"]] for r in df.select("i", K.with_spaces(F.col("t"), F.col("text")).alias("x")).collect()}
    assert found == {1: ["a", " ", "b", " ", "zz", "c"], 2: None, 3: [], 4: ["a"], 5: [None, "b"]}
    words = [f"w{i}" for i in range(200_000)]
    text = " ".join(words)  # over a million characters
    surfaces, _ = K.spaced(words, ["X"] * len(words), text)
    assert len(text) > 1_000_000 and "".join(surfaces) == text
