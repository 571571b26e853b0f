"""Saved lists, word inclusion by tables of items, and texts scored in one chain."""

import random

import pytest
from pyspark.sql import functions as F

from morphlake.functions import tokens as K
from morphlake.operators import presets
from morphlake.operators.analyze import PretaggedAnalyzer
from morphlake.operators.dictionary import Dictionary
from morphlake.operators.inclusion import including
from morphlake.sources import versions, wordlists


def words_of(df, name="word"):
    return sorted(r[name] for r in df.collect())


def test_lists_are_changed_and_saved_under_their_names(spark, tmp_path):
    path = f"file://{tmp_path}/list"
    wordlists.save_wordlist(spark.createDataFrame([("aa",), ("bb",), ("cc",)], "word string"), path)
    reader = wordlists.load_dictionary(spark, path)
    for left in (["aa", "bb"], ["aa"]):  # a filter reads lazily, without a shuffle
        now = spark.read.text(versions.current(spark, path)).select(F.col("value").alias("word"))
        wordlists.save_wordlist(now.where(F.col("word").isin(left)), path)
        assert words_of(wordlists.load_dictionary(spark, path)) == left
        if len(left) == 2:
            assert words_of(reader) == ["aa", "bb", "cc"]  # a reader that has begun keeps its state
    assert len(versions.states(spark, path)) == 2
    wordlists.save_vocab(spark.createDataFrame([("a", "x"), ("b", None)], "src string, dst string"), f"{path}-map")
    vocab = wordlists.load_vocab(spark, f"{path}-map")
    wordlists.save_vocab(vocab.where("src = 'a'").union(spark.createDataFrame([("c", "y")], "src string, dst string")), f"{path}-map")
    assert sorted(map(tuple, wordlists.load_vocab(spark, f"{path}-map").collect())) == [("a", "x"), ("c", "y")]


def test_a_failed_write_leaves_the_list(spark, tmp_path):
    path = f"file://{tmp_path}/list"
    wordlists.save_wordlist(spark.createDataFrame([("aa",)], "word string"), path)
    with pytest.raises(Exception, match="no"):
        wordlists.save_wordlist(wordlists.load_dictionary(spark, path).select(F.raise_error(F.lit("no")).cast("string").alias("word")), path)
    assert words_of(wordlists.load_dictionary(spark, path)) == ["aa"]
    wordlists.save_wordlist(wordlists.load_dictionary(spark, path).limit(0), path)
    assert words_of(wordlists.load_dictionary(spark, path)) == []


def test_rewrite_of_plain_files(spark, tmp_path):
    plain, listed = tmp_path / "d.txt", tmp_path / "w.txt"
    plain.write_text(" Ab C \nab c\nx\n")
    assert words_of(wordlists.load_dictionary(spark, f"file://{plain}", rewrite=True)) == ["abc", "x"]
    assert words_of(wordlists.load_dictionary(spark, f"file://{plain}")) == ["abc", "x"]
    assert spark.read.text(f"file://{plain}/v0000000000-plain").count() == 3  # what was there before
    listed.write_text("# note\nX/NNG 3\nz 1\nq\nX/VV\n")
    options = {"remove_tag": True, "lowercase": True}
    assert words_of(wordlists.load_wordlist(spark, f"file://{listed}", rewrite=True, **options)) == ["q", "x", "z"]
    assert words_of(spark.read.text(versions.current(spark, f"file://{listed}")), "value") == ["#", "X", "q", "z"]


def test_folders_of_user_dictionaries_take_csv_files_only(spark, tmp_path):
    row = "{},1,2,5,NNG,*,F,x,*,*,*,*\n"
    (tmp_path / "a.csv").write_text(row.format("one"))
    (tmp_path / "notes.txt").write_text(row.format("note"))
    assert words_of(wordlists.load_user_dictionary(spark, f"file://{tmp_path}"), "surface") == ["one"]
    assert words_of(wordlists.load_user_dictionary(spark, f"file://{tmp_path}/notes.txt"), "surface") == ["note"]


@pytest.mark.parametrize("options", [{}, {"startswith": True}, {"endswith": True}, {"unit_level": True}, {"unit_level": True, "startswith": True}, {"unit_level": True, "endswith": True}])
@pytest.mark.parametrize("kind", ["short", "mixed", "long", "empty", "none"])
def test_inclusion_by_a_table(spark, options, kind):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abA;é") for _ in range(n))
    words = [None, "", "ab", "ABAB;ab", *(word(rng.randint(0, 12)) for _ in range(120))]
    items = {"short": ["b", "aé"], "mixed": ["A", *(word(rng.randint(1, 5)) for _ in range(8))], "long": [word(n % 90 + 3) for n in range(90)] + ["abab"], "empty": [""], "none": []}[kind]
    rows = spark.createDataFrame([(w, 1) for w in words], "word string, item int")
    table = spark.createDataFrame([(i,) for i in [*items, None]], "item string")
    expected = rows.where(K.includes(F.col("word"), items, **options)).collect() if items else []
    assert sorted(including(rows, table, **options).collect(), key=repr) == sorted(expected, key=repr)


def test_texts_to_scores_in_one_chain(spark):
    """Own sentences: institution merged at the start, compound tag cut, phrase scored, a lemma and a synonym replaced."""
    words = Dictionary.empty(spark).add_words(["금통위", "금리"], "NNG").add_words(["인상"], "NNG").add_synonym("기준금리", "금리").add_lemma("오르", "오르다").add_words(["오르다"], "VV").add_terms(["한국"], "COUNTRY")
    tagger = presets.Tagger(PretaggedAnalyzer(), words)
    rows = spark.createDataFrame([("금리/NNG;인상/NNG", 1.0, 0.8, 2.0), ("금리/NNG", -1.0, -0.5, 2.0), ("오르다/VV", 1.0, 0.1, 2.0)], "word string, polarity double, score double, intensity double")
    known = spark.createDataFrame([("금리/NNG",), ("인상/NNG",), ("오르다/VV",), ("금통위/NNG",)], "term string")
    scorer = presets.TextScorer(tagger, presets.tone(rows, known, kind=3))
    texts = [(1, "금/NNG 통위/NNG 은/JX 기준금리/NNG 를/JKO 인상/NNG 하/XSV+EC ./SF"), (2, "금리/NNG 가/JKS 오르/VV+EP 다/EF ./SF"), (3, "한국/NNP 은/JX ./SF"), (4, ""), (5, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["doc_id"]: r["terms"] for r in scorer.tokenize(docs).collect()} == {1: ["금리/NNG;인상/NNG"], 2: ["금리/NNG"], 3: [], 4: [], 5: []}
    found = {r["doc_id"]: r for r in scorer.score(docs, with_breakdown=True).collect()}
    assert found[1]["polarity"] == found[1]["subjectivity"] == 1 / (1 + 1e-6) and found[2]["negative"] == -1
    assert [tuple(x) for x in found[1]["breakdown"]] == [("금리/NNG;인상/NNG", 1.0, 1.0, "positive")] and found[3]["breakdown"] == [] and found[5]["polarity"] == 0
    assert [(r["doc_id"], r["phrase"], r["polarity"]) for r in scorer.phrases(docs).orderBy("doc_id").collect()] == [(1, "금리인상", 0.8), (2, "금리", -0.5)]
    merged = {r["doc_id"]: [tuple(t) for t in r["tokens"]][:2] for r in tagger.tag(docs).collect()}
    assert merged[1] == [("금통위", "NNG"), ("은", "JX")] and merged[2] == [("금리", "NNG"), ("가", "JKS")]
