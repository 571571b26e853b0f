"""Bagging, triples of words and saved models against plain programs."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from morphlake.operators import bayes, presets
from morphlake.operators.analyze import PretaggedAnalyzer
from morphlake.operators.dictionary import Dictionary

SCHEMA = "doc_id long, label int, features array<string>"


def corpus(n, seed):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        label = rng.choice([1, 1, -1])
        words = [rng.choice("abcdef" if label > 0 and rng.random() < 0.6 else "defghi") for _ in range(rng.randint(0, 8))]
        docs.append((i, label, words + ["every"]))
    return docs


def scores(train, test):
    """Probability of the positive label for each test document."""
    size = Counter(label for _, label, _ in train)
    seen = defaultdict(Counter)
    for _, label, words in train:
        for w in set(words):
            seen[w][label] += 1
    out = {}
    for i, _, words in test:
        logs = {}
        for label in (1, -1):
            p = math.log((size[label] + 0.5) / (len(train) + 1))
            for w in set(words) & set(seen):
                bins = 1 if all(seen[w][x] == size[x] for x in (1, -1)) else 2
                p += math.log((seen[w][label] + 0.5) / (size[label] + bins * 0.5))
            logs[label] = p
        out[i] = 1 / (1 + math.exp(logs[-1] - logs[1]))
    return out


@pytest.mark.parametrize("bits", [60, 2])  # all splits in one mask, and in several
def test_bagging_equals_single_runs(spark, monkeypatch, bits):
    monkeypatch.setattr(bayes, "MASK_BITS", bits)
    data = corpus(60, 1) + [(None, 1, ["a"]), (100, -1, []), (101, 1, None), (102, -1, ["g", "g"])]
    docs = spark.createDataFrame([(*d, 7, "clash") for d in data], SCHEMA + ", iteration int, mask string").drop("iteration", "mask")
    found = {r["iteration"]: r for r in bayes.bagging(docs, iterations=5, cutoff=1.5).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5]
    accuracies = {}
    for k, row in found.items():
        flags = {(r["doc_id"], r["label"]): r["train"] for r in bayes.split_by_class(docs.withColumn("iteration", F.lit(k)), by=("iteration",)).collect()}
        train = [(i, lab, w or []) for i, lab, w in data if flags[i, lab]]
        test = [(i, lab, w or []) for i, lab, w in data if not flags[i, lab]]
        cells = Counter()
        for (i, p), (_, label, _) in zip(scores(train, test).items(), test, strict=True):
            high, low = max(p, 1 - p), min(p, 1 - p)
            predicted = 2 * p - 1 if high / (low + 1e-6) > 1.5 else 0
            if predicted:
                cells[label > 0, predicted > 0] += 1
        assert (row["t_pos"], row["t_neg"], row["f_pos"], row["f_neg"]) == (cells[True, True], cells[False, False], cells[False, True], cells[True, False])
        accuracies[k] = row["accuracy"]
    summary = bayes.bagging_summary(bayes.bagging(docs, iterations=5, cutoff=1.5)).first()
    assert summary["accuracy"] == pytest.approx(sum(accuracies.values()) / 5)
    assert summary["best_iteration"] == min(k for k in accuracies if accuracies[k] == max(accuracies.values()))


def test_tokens_are_shuffled_once_for_all_splits(spark):
    docs = spark.createDataFrame(corpus(30, 2), SCHEMA)
    plan = bayes.bagging(docs, iterations=20)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(array_distinct") == 2  # once counted, once scored


def deviation(o):
    """Pearson's statistic of a table o[i][j][k]."""
    n = sum(o.values())
    total = 0.0
    for cell, seen in o.items():
        expected = math.prod(sum(v for c, v in o.items() if c[d] == cell[d]) for d in range(3)) / n**2
        total += (seen - expected) ** 2 / (expected + 1e-20)
    return total


def test_triples_by_all_eight_cells(spark):
    rng = random.Random(3)
    data = [(i, 1, [rng.choice("abcd") for _ in range(n)]) for i, n in enumerate((0, 1, 2, 3, 9, 40, 40))]
    docs = spark.createDataFrame(data, SCHEMA)
    found = {r["doc_id"]: r["features"] for r in bayes.best_collocations(docs, 3, top=6).collect()}
    for i, _, words in data:
        n, single = len(words), Counter(words)
        pairs, outer, triples = Counter(zip(words, words[1:], strict=False)), Counter(zip(words, words[2:], strict=False)), Counter(zip(words, words[1:], words[2:], strict=False))
        ranked = []
        for (a, b, c), k in triples.items():
            o = {(1, 1, 1): k, (1, 1, 0): pairs[a, b] - k, (1, 0, 1): outer[a, c] - k, (0, 1, 1): pairs[b, c] - k}
            o[1, 0, 0] = single[a] - k - o[1, 1, 0] - o[1, 0, 1]
            o[0, 1, 0] = single[b] - k - o[1, 1, 0] - o[0, 1, 1]
            o[0, 0, 1] = single[c] - k - o[1, 0, 1] - o[0, 1, 1]
            o[0, 0, 0] = n - sum(o.values())
            ranked.append((round(deviation(o), 6), f"{a} {b} {c}"))
        value = {t: x for x, t in ranked}  # which of equal ones are taken, rounding decides
        assert sorted(value[t] for t in found[i]) == sorted(sorted((x for x, _ in ranked), reverse=True)[:6])


def test_saved_models_classify(spark, tmp_path):
    docs = spark.createDataFrame(corpus(40, 4), SCHEMA)
    path = f"file://{tmp_path}/model"
    model = bayes.fit(docs)
    model.save(path)
    again = bayes.Model.load(spark, path)
    show = lambda m: sorted(tuple(float(f"{x:.8g}") for x in r) for r in m.classify(docs.select("doc_id", "features")).collect())  # noqa: E731  sums have no order
    assert show(again) == show(model) and again.features == "word"
    assert sorted(map(tuple, again.informative().collect())) == sorted(map(tuple, model.informative().collect()))
    assert sorted(map(tuple, again.prior.collect())) == sorted(map(tuple, model.prior.collect()))
    other = bayes.fit(docs.where("doc_id < 20"))
    other.save(path)  # whoever has loaded the old state keeps it
    assert show(again) == show(model) and show(bayes.Model.load(spark, path)) == show(other)
    fresh = bayes.Model.load(spark.newSession(), path)
    assert fresh.classify(fresh.cond.sparkSession.createDataFrame([(1, ["a"])], "doc_id long, features array<string>")).count() == 1


def test_texts_to_classes_in_one_chain(spark, tmp_path):
    """Own sentences, learned and classified against a plain program; the saved model does the same."""
    words = Dictionary.empty(spark).add_words(["금리", "성장"], "NNG").add_words(["인상", "둔화"], "NNG")
    vocab = spark.createDataFrame([("금리/NNG;인상/NNG",), ("성장/NNG;둔화/NNG",)], "term string")
    chain = presets.TextClassifier(presets.Tagger(PretaggedAnalyzer(), words), vocab)
    up, down = "금리/NNG 를/JKO 인상/NNG 하/XSV ./SF", "성장/NNG 이/JKS 둔화/NNG 되/XSV ./SF"
    data = [(1, up, 1), (2, down, -1), (3, up + " " + down, -1), (4, "인상/NNG 되/VX", 1), (5, None, 1), (6, up, None), (7, up, 0), (8, up, 1), (10, up, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, label int")
    expected = {1: ["금리/NNG", "인상/NNG", "하/XSV", "금리/NNG;인상/NNG"], 2: ["성장/NNG", "둔화/NNG", "되/XSV", "성장/NNG;둔화/NNG"], 4: ["인상/NNG"], 5: []}
    found = {r["doc_id"]: r["features"] for r in chain.features(docs).collect()}
    assert {i: found[i] for i in expected} == expected and set(found[3]) == {*expected[1], *expected[2]}
    with pytest.raises(ValueError):
        chain.classify(docs)
    fitted = chain.fit(docs.withColumn("tokens", F.lit("clash")))
    asked = spark.createDataFrame([(1, up), (1, up), (2, down), (3, ""), (None, None), (9, "모름/NNG")], "doc_id long, text string")
    learned = [(i, label, found[i]) for i, _, label in data if label in (1, -1)]
    features = [expected[1]] * 2 + [expected[2], [], [], []]
    plain = [scores(learned, [(0, 0, f)])[0] for f in features]
    rows = fitted.classify(asked, cutoff=1.5).collect()
    assert sorted(round(r["pos_score"], 9) for r in rows) == sorted(round(p, 9) for p in plain) and len(rows) == 6
    tone = {r["doc_id"]: r for r in rows}
    assert tone[1]["polarity"] > 0 > tone[2]["polarity"] and tone[3]["polarity"] == tone[9]["polarity"]
    fitted.model.save(f"file://{tmp_path}/model")
    again = presets.TextClassifier(chain.tagger, vocab, bayes.Model.load(spark, f"file://{tmp_path}/model"))
    assert sorted(map(str, again.classify(asked, cutoff=1.5).collect())) == sorted(map(str, rows))
    assert fitted.classify(asked.where("doc_id > 99")).count() == 0


def test_collocations_stay_with_their_documents(spark):
    """No word moves for n-grams of one document; rows of one id are each their own, and nulls part the words."""
    docs = spark.createDataFrame([(1, 1, ["a", "b", "c"]), (1, 1, ["d", "e"]), (None, 1, ["f", "g"]), (2, 1, ["h", None, "i", "j"]), (3, 1, None)], SCHEMA)
    for size, expected in ((2, [["a b", "b c"], ["d e"], ["f g"], ["i j"], []]), (3, [["a b c"], [], [], [], []])):
        found = bayes.best_collocations(docs, size)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["features"] for r in found.collect()) == sorted(expected)


def test_features_of_the_best_words_move_no_token(spark, monkeypatch):
    """Words that are not among the best are told by their hashes where documents lie; joined words give the same."""
    rng = random.Random(5)
    data = [(i, 1 if i % 3 else -1, [rng.choice(["a", "b", "c d", "c", "e\tf", "e", "é", "zz", f"w{i}"]) for _ in range(i)]) for i in range(40)]
    docs = spark.createDataFrame([*data, (40, 1, None)], SCHEMA)
    for kind in ("best_word", "best_bigram", "best_trigram"):
        rows = bayes.feature_sets(docs, kind, 0.5, top=7)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        found = {r["doc_id"]: r["features"] for r in rows.collect()}
        with monkeypatch.context() as m:
            m.setattr(bayes.phrases, "SENT_BYTES", 0)
            joined = bayes.feature_sets(docs, kind, 0.5, top=7)
            assert "Exchange" in joined._jdf.queryExecution().executedPlan().toString()
            assert {r["doc_id"]: r["features"] for r in joined.collect()} == found
    best = {r["feature"] for r in bayes.best_words(docs, 0.5).collect()}
    pairs, triples = ({r["doc_id"]: r["features"] for r in bayes.best_collocations(docs, k, 7).collect()} for k in (2, 3))
    assert found == {i: sorted(best & set(w or [])) + pairs[i] + triples[i] for i, _, w in [*data, (40, 1, None)]}
    assert all(x[i] == sorted(x[i]) for x in (pairs, triples) for i in x)


def test_evaluation_reads_its_documents_once(spark):
    """The tables of an evaluation start from written documents, and the ends of the shares are not found again in each."""
    docs = spark.createDataFrame(corpus(60, 3), SCHEMA).repartition(3).withColumn("features", F.filter("features", lambda w: w != "never"))
    plan = bayes.evaluate(docs, features="best_bigram")._jdf.queryExecution().optimizedPlan().toString()
    assert "never" not in plan and "Window" not in plan
