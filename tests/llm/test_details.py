"""Long texts, pieces, gradients, all code points and the registered queries themselves."""

import itertools
import math
import os
import re
import struct
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from morphlake.llm import components, iblt, maxent_lm, packing, quality_cnn, quality_rules, queries, set_join, simhash, suffix_dedup
from morphlake.llm.bpe_codec import WordBpe

from .test_search import negatives, ranked


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(7)
    words = [f"w{int(k)}" for k in rng.zipf(1.4, 4000) % 300]
    texts = [" ".join(words[k : k + 40]) for k in range(0, 4000, 40)]
    train = spark.createDataFrame([(t, k % maxent_lm.PARTS) for k, t in enumerate(texts)], "text string, part long")
    tokens = Counter(w for t in texts for w in maxent_lm.tokens_of(t))
    return maxent_lm.fit(train, spark.createDataFrame(list(tokens.items()), "token binary, c long")), tokens


def test_language_model_sums_to_one(model):
    """After any history the probabilities of all known tokens and of the unseen ones of each rare class add up to one."""
    fitted, tokens = model
    worker = maxent_lm.Worker(fitted)
    every = list(tokens)
    cls = worker.classes[worker.encode(every)]
    c = np.array([tokens[t] for t in every])
    inside = (c + maxent_lm.RARE) / 10 ** fitted.leaf_bottom()[cls]
    for history in ([], [b"w1"], [b"w2", b"w7", b"never seen"], [b"", b"w1", b"w1"]):
        ids = worker.encode([*history, b"w1"])
        p = np.exp(worker.class_logs(worker.features(ids, np.zeros(len(ids), np.int64)))[-1].astype(np.float64))
        unseen = sum(p[k] * maxent_lm.RARE / 10 ** fitted.leaf_bottom()[k] for k in range(maxent_lm.TAIL_CLASS, maxent_lm.END_CLASS))
        empty = sum(p[k] for k in range(maxent_lm.CLASSES) if not (cls == k).any() and not maxent_lm.TAIL_CLASS <= k < maxent_lm.END_CLASS)
        assert abs((p[cls] * inside).sum() + unseen + empty - 1) < 1e-5 and empty < 0.05


def test_language_model_reads_long_texts_in_runs(model, monkeypatch):
    fitted, _ = model
    texts = [" ".join(f"w{k % 31}" for k in range(900)), "", None, "w1 w2", "W5 " * 333]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(range(5)), pa.array([False] * 5), pa.array(texts)], names=["rid", "doc_id", "held_out", "text"])

    def scored():
        written = maxent_lm._places(SimpleNamespace(value=fitted.tokens))([batch])
        (out,) = maxent_lm._scores(SimpleNamespace(value=fitted))(written)
        return out.to_pydict()

    whole = scored()
    monkeypatch.setattr(maxent_lm, "TOKENS_AT_ONCE", 50)
    parts = scored()
    assert parts["n_tokens"] == whole["n_tokens"] == [len(maxent_lm.tokens_of(t)) for t in texts] and np.allclose(parts["head_score"], whole["head_score"])


def test_letter_trigrams_of_many_tokens():
    """Trigrams of tokens side by side are those of each alone; tokens without a letter have bucket 0."""
    tokens = [b"word", b"a", b"(ab)", b"...", b"", "\u00fc\u00df".encode(), b"^$", b"x" * 5000]
    alone = []
    for t in tokens:
        x = b"^" + t.strip(b".,;:!?|\"'()") + b"$"
        alone.append([((a * 7919 + b * 104729 + c * 1299709) >> 3) % maxent_lm.TRIGRAMS for a, b, c in zip(x, x[1:], x[2:], strict=False)] or [0])
    flat, sizes = maxent_lm._grams(tokens)
    assert flat.tolist() == sum(alone, []) and sizes.tolist() == [len(x) for x in alone]


def test_class_weights_of_combinations_and_counts_of_batches():
    """Weights of the classes before, summed up once, give the softmax of plain sums; batches of a task are counted together."""
    rng = np.random.default_rng(5)
    head = [(b"w%d" % k, 90 - k) for k in range(80)]
    model = maxent_lm.Model(head, 5000, 100, {})
    model.weights = rng.normal(0, 3, model.weights.shape).astype(np.float32)
    worker = maxent_lm.Worker(model)
    ids = rng.integers(0, 80 + maxent_lm.TOPICS + 1, 9000)
    features = worker.features(ids, np.arange(9000) // 70 * 70)
    z = model.weights[features].astype(np.float64).sum(1)
    assert np.allclose(worker.class_logs(features), z - np.log(np.exp(z).sum(1, keepdims=True)), atol=1e-4)
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["text"]) for x in (["A b", None], [], ["a a"])]
    found = list(maxent_lm._token_counts(batches))
    assert len(found) == 1 and dict(zip(*(c.to_pylist() for c in found[0].columns), strict=True)) == {b"a": 3, b"b": 1, b"": 3}


def test_language_model_learns(spark):
    """Held-out texts with an order are likelier than under the base, and the model beats counts alone."""
    rng = np.random.default_rng(1)
    pairs = [(f"a{k}", f"the b{k % 3}") for k in range(12)]
    texts = [(k, " ".join(" ".join(pairs[int(rng.integers(12))]) for _ in range(60))) for k in range(300)]
    rows = maxent_lm.score_documents(spark.createDataFrame(texts, "doc_id long, text string")).where("held_out").collect()
    assert len(rows) > 20 and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_fingerprints_in_blocks(monkeypatch):
    text = " ".join(f"w{k * k % 97}" for k in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("together", [1, 300, 1 << 16])
def test_anchors_of_many_texts_at_once(monkeypatch, together):
    """Contexts of texts hashed side by side are those of each alone; none reaches into the next text."""
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    rng = np.random.default_rng(6)
    texts = [rng.integers(97, 101, n, dtype=np.uint8) for n in (0, 99, 100, 5, 700, 23, 0, 101, 250, 99)] + [np.full(300, 97, np.uint8)]
    alone = [(*row, k) for k, t in enumerate(texts) for row in zip(*(x.tolist() for x in suffix_dedup.anchors(t)), strict=True)]
    assert list(zip(*(x.tolist() for x in suffix_dedup.anchors_of(texts)), strict=True)) == alone
    assert [len(x) for x in suffix_dedup.anchors_of([])] == [len(x) for x in suffix_dedup.anchors_of(texts[:2])] == [0] * 4


def test_pipeline_near_dedup_looks_up_fingerprints(spark, monkeypatch):
    """Near copies meet by fingerprints first; what they do not find is joined, so nothing depends on them."""
    import corpus_pipeline

    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in rng.integers(0, 9000, 400).tolist()]
    texts = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(0, 400, 10)] + [" ".join(base[k : k + 90]) for k in range(0, 400, 100)] + [None, ""]
    assert simhash.of_hashes(set_join.shingles(texts[0], 3)) & (1 << 64) - 1 == simhash.fingerprint(texts[0])
    prints = {simhash.of_hashes(set_join.shingles(t, 5)) for t in texts}
    close = {(min(a, b), max(a, b)) for a in prints for b in prints if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= simhash.DISTANCE}
    docs, links, met = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), simhash.links, set()

    def seen(nodes):
        met.update((min(r), max(r)) for r in links(nodes).collect())
        return links(nodes)

    kept = {}
    for name, way in (("all", seen), ("none", lambda nodes: links(nodes).limit(0))):
        monkeypatch.setattr(simhash, "links", way)
        kept[name] = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert close and met == close
    assert kept["all"] == kept["none"] == [0, 40, 41, 42, 43, 44]


def test_one_id_with_several_texts_keeps_each_group(spark):
    rows = [(1, "alpha beta gamma delta " * 9), (1, "one two three four five six " * 9), (1, "alpha beta gamma delta " * 9), (2, "alpha beta gamma delta " * 9), (3, "one two three four five six " * 9), (None, "x"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"shingle": 5, "similarity": 0.8}):
        kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(docs, **options).collect()), key=repr)
        assert kept == sorted([rows[0], rows[1], (None, "x"), (4, None)], key=repr)
    assert simhash.keep_one(docs.limit(0), shingle=5, similarity=0.8).count() == 0


def test_gradients():
    """One step of plain descent along the gradient lowers the loss as much as it should, weight by weight."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 256, n, dtype=np.uint8) for n in (10, 300, 700, 64)]
    labels, weights = np.array([0, 1, 1, 0], np.float32), np.array([1, 2, 0.5, 1], np.float32)
    net = quality_cnn.train(texts, labels, weights, epochs=1)

    def loss(n):
        p = n.probability(quality_cnn.pooled(n, texts))
        return float(np.mean(-weights * (labels * np.log(p) + (1 - labels) * np.log(1 - p))))

    # Adam's first step is the sign of the gradient times the rate, so a tiny first step shows each sign.
    before = quality_cnn.train(texts, labels, weights, epochs=0)
    after = quality_cnn.train(texts, labels, weights, epochs=1, batch=4, rate=1e-4)
    checked = agreed = 0
    for k, (a, b) in enumerate(zip(before.arrays(), after.arrays(), strict=True)):
        for at in rng.permutation(a.size)[:40]:
            one = quality_cnn.train(texts, labels, weights, epochs=0)
            x = one.arrays()[k].reshape(-1)
            x[at] += 2e-2
            up = loss(one)
            x[at] -= 4e-2
            slope = (up - loss(one)) / 4e-2
            moved = float(b.reshape(-1)[at] - a.reshape(-1)[at])
            if abs(slope) > 2e-3 and abs(moved) > 2e-5:
                checked, agreed = checked + 1, agreed + (slope * moved < 0)
    assert checked > 30 and agreed / checked > 0.9 and 0 < loss(net) < 5


def test_fitting_sample_is_bounded_by_bytes(spark, monkeypatch):
    """Long texts are in the sample as far as they fit; nothing else bounds their length."""
    seen = []
    monkeypatch.setattr(quality_cnn, "train", lambda texts, y, w, **_: seen.append([len(t) for t in texts]) or 0.5)
    docs = spark.createDataFrame([(i, "x" * (100_000 if i % 10 == 0 else 50)) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    quality_cnn.fit(docs, labels)
    assert max(seen[0]) == 100_000 and len(seen[0]) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(100))
    quality_cnn.fit(docs, labels, sample_bytes=1000)
    assert max(seen[1]) == 50 and 2 <= len(seen[1]) <= 40 and sum(seen[1]) <= 2000


def test_batches_are_full(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 37)) for i in range(3000)] + [(5000, "w " * 70_000), (5001, "w " * 70_001)], "doc_id long, text string")
    rows = packing.pack(docs, budget=500, buckets=4).collect()
    assert max(r["bucket_tokens"] for r in rows) == 70_001 and {r["padding"] for r in rows if r["doc_id"] == 5001} == {0}
    each = {}
    for r in rows:
        bucket, chunk, number = r["batch_id"].split("-")
        each.setdefault((int(bucket), chunk), Counter())[int(number)] += 1
    for (bucket, _), sizes in each.items():
        full = max(1, 500 // max(1, bucket))
        assert [sizes[k] for k in range(len(sizes) - 1)] == [full] * (len(sizes) - 1) and 1 <= sizes[len(sizes) - 1] <= full
    upper = sorted({r["bucket_tokens"] for r in rows})
    lengths = Counter(r["n_tokens"] for r in rows)
    cost = lambda bounds: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in lengths.items())
    assert cost(upper) == min(cost([*c, 70_001]) for c in itertools.combinations(sorted(lengths)[:-1], 3))


@pytest.fixture(scope="module")
def codec():
    return WordBpe(public_tokenizers.path("word_bpe_49k.json"))


def _same(codec, text):
    ids = codec.library.encode(text, add_special_tokens=False).ids
    found, decoded = codec.encode(text)
    assert list(struct.unpack(f"<{len(found) // 4}I", found)) == ids, repr(text[:80])
    assert decoded.decode() == codec.library.decode(ids, skip_special_tokens=False)


def test_codec_on_all_code_points(codec):
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for at in range(0, len(points), 997):
        block = points[at : at + 997]
        _same(codec, "".join(block))
        _same(codec, " ".join(f"a{c}" for c in block))
    for p in (0x1F600, 0x1F469, 0x1FAE8, 0x0378, 0x10D4A, 0x1E900, 0x16EA0, 0xA7CB):
        _same(codec, f"so {chr(p)}{chr(p)}x and é{chr(p)}")


def test_codec_on_random_bytes(codec):
    rng = np.random.default_rng(11)
    for n in (1, 3, 10, 100, 3000):
        for _ in range(20):
            _same(codec, rng.integers(0, 256, n, dtype=np.uint8).tobytes().decode("utf-8", "replace"))
            _same(codec, "".join(rng.choice(list("abtheingABΣσς'0 1\n\t.,!é漢👍🏽‍"), n)))


SHARED = " ".join(f"shared{k}" for k in range(40))
BASIC = " ".join(f"basic{k} text." for k in range(60))


def _items(docs):
    return [(k, t and t[:150]) for k, (_, t) in enumerate(docs[-9:])]


def _turns(docs):
    return [(i and i % 7, k, ("user", "assistant", None)[k % 3], t) for k, (i, t) in enumerate(docs)]


def _vectors(docs):
    return [(i, None if k % 50 == 49 else [((k * 7 + d * d * 3) % 11 - 3) / 8 for d in range(4)], k % 3 if k % 40 else None) for k, (i, _) in enumerate(docs)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tables of the driver's names: plain, awkward and empty."""
    rng = np.random.default_rng(21)
    folder = tmp_path_factory.mktemp("tables")
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrst"), int(rng.integers(2, 8))))
    prose = lambda n: " ".join(word() + ("." if k % 9 == 8 else "") for k in range(n))
    junk = [lambda: " ".join(x + "###" for x in prose(60).split()), lambda: " ".join(x.upper() + "!!" for x in prose(60).split()), lambda: " ".join(" ".join([x] * 12) for x in prose(9).split())]
    rows = [(i, junk[i % 3]() if i % 6 == 5 else prose(int(rng.integers(25, 120)))) for i in range(240)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, rows[1][1].replace(" ", "  ", 1)), (303, prose(30) + " " + SHARED + " " + prose(20)), (304, prose(25) + " " + SHARED + " " + prose(30))]
    labels = [(i, int(i % 6 != 5), 0) for i in range(240)]
    made = {"plain": (rows, labels), "awkward": ([*rows[:60], (None, None), (None, BASIC), (400, ""), (400, None), (401, "x"), (0, rows[0][1]), (0, rows[2][1])], [*labels[:60], (None, 1, 0), (999, 0, 0), (0, 0, 0)]), "empty": ([], [])}
    for name, (docs, known) in made.items():
        os.makedirs(folder / name)
        spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/{name}/documents.parquet")
        spark.createDataFrame(known, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/{name}/labels.parquet")
        spark.createDataFrame([(k, f"http://a{k % 3}.example.de/{k}", f"<html lang='en'><p>{t}</p></html>") for k, (_, t) in enumerate(docs[:40])], "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/{name}/pages.parquet")
        spark.createDataFrame(_items(docs), "item_id long, text string").coalesce(1).write.parquet(f"{folder}/{name}/benchmark.parquet")
        spark.createDataFrame(_turns(docs), "conv_id long, turn long, role string, text string").coalesce(2).write.parquet(f"{folder}/{name}/conversations.parquet")
        spark.createDataFrame(_vectors(docs), "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/{name}/embeddings.parquet")
    return folder, made


@pytest.mark.parametrize("name", ["plain", "awkward", "empty"])
def test_registered_queries(spark, tables, name):
    """Every registered query returns a row for each row of its table, whatever the rows are like."""
    folder, made = tables
    for key, query in queries.QUERIES.items():
        if key == "pipeline":
            continue
        out, docs = query(spark, f"{folder}/{name}"), made[name][0]
        if key.startswith("op11"):
            assert sorted(map(tuple, out.collect()), key=repr) == ranked(docs, _items(docs)), key
            continue
        if key.startswith("op12"):
            assert Counter(r["conv_id"] for r in out.collect()) == Counter({*(r[0] for r in _turns(docs)), -1}), key
            continue
        if key.startswith("op13"):
            shifted = [(i, v, lab if lab is None or i is None or i % 7 else (lab + 1) % 10) for i, v, lab in _vectors(docs)]
            assert sorted(map(tuple, out.collect()), key=repr) == negatives(shifted, lambda i: i is not None and i % 100 == 0), key
            continue
        found = out.count()
        assert found == (min(40, len(made[name][0])) if key.startswith("op3") else len(made[name][0])), key


def test_pipeline_on_plain_rows(spark, tables):
    """Each stage against its own rule on its own input; the end is every kept document, packed once."""
    import corpus_pipeline

    folder, made = tables
    docs = spark.read.parquet(f"{folder}/plain/documents.parquet")
    text = dict(made["plain"][0])
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, f"{folder}/plain"), name)
        seen.append({r["doc_id"]: r.asDict() for r in docs.collect()})
    classified, ruled, single, cut, packed = seen
    good = {i for i in text if not (i % 6 == 5 and i < 240)}
    known = spark.read.parquet(f"{folder}/plain/labels.parquet")
    assert set(classified) == {r["doc_id"] for r in quality_cnn.classify(spark.read.parquet(f"{folder}/plain/documents.parquet"), known).where("predicted = 1").collect()}
    assert len(good - set(classified)) <= 2 and len(set(classified) - good) < 40
    assert set(ruled) == {i for i in classified if i in good}
    sets = {i: {tuple(w[k : k + 5]) for w in [text[i].split()] for k in range(max(1, len(w) - 4))} for i in ruled}
    alike = lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    assert set(single) == {i for i in ruled if not any(j < i and alike(i, j) for j in ruled)}  # no chains in these rows
    windows, gone = set(), {}
    for i in sorted(single):
        b, flags = text[i].encode(), bytearray(len(text[i].encode()))
        for s in range(len(b) - 99):
            if b[s : s + 100] in windows:
                flags[s : s + 100] = b"\1" * 100
            windows.add(b[s : s + 100])
        gone[i] = bytes(x for x, f in zip(b, flags, strict=True) if not f).decode()
    assert {i: r["text"] for i, r in cut.items()} == gone and any(gone[i] != text[i] for i in gone)
    assert all(r["n_chars"] == len(r["text"]) for r in cut.values())
    assert {i: r["n_tokens"] for i, r in packed.items()} == {i: len(gone[i].split()) for i in cut}
    again = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, f"{folder}/plain").collect())
    assert again == sorted(packed)


@pytest.mark.parametrize("name", ["awkward", "empty"])
def test_pipeline_on_awkward_rows(spark, tables, name):
    """The whole pipeline runs; with labels of several kinds or none it keeps the columns it promises."""
    import corpus_pipeline

    folder, made = tables
    out = corpus_pipeline.run(spark, f"{folder}/{name}")
    assert {"doc_id", "batch_id", "n_tokens"} <= set(out.columns) and out.count() <= len(made[name][0])


def test_words_of_rules_and_packing_agree(docs, rows):
    """Both count the runs without ASCII white space; other blanks part no words."""
    expected = Counter((i, n) for i, t in rows if (n := len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))))
    count = lambda df, name: Counter((r["doc_id"], r[name]) for r in df.collect() if r[name])
    assert count(quality_rules.judge(docs), "n_words") == count(packing.pack(docs), "n_tokens") == expected


def test_cells_that_look_like_one_digest(spark):
    """Two digests of ours and one of theirs whose xor passes for a digest: it must not be among what was recovered."""
    digest = lambda n: F.xxhash64(F.lit("row"), F.col("id"), F.lit(n)).bitwiseAND(F.lit(~0xFFFF))
    rows = spark.range(1 << 21).select(*[digest(n).bitwiseOR(iblt._check(digest(n))).alias(c) for n, c in enumerate("abc")])
    mixed = F.col("a").bitwiseXOR(F.col("b")).bitwiseXOR(F.col("c"))
    rows = rows.where(mixed.bitwiseAND(F.lit(0xFFFF)) == iblt._check(mixed)).localCheckpoint()
    assert rows.count() > 10
    found = rows.withColumn("found", iblt.recovered(F.array("a", "b"), F.array("c"))["found"])
    wrong = found.where((F.array_sort("found.ours") != F.array_sort(F.array("a", "b"))) | (F.col("found.theirs") != F.array("c")))
    assert wrong.count() == 0


def test_components_of_one_task_take_one_round(spark, monkeypatch):
    """A task's edges become stars at once, so a chain takes one round, which plans little on the driver."""
    rounds, remove = [], components.remove
    monkeypatch.setattr(components, "remove", lambda spark, path: rounds.append(path) or remove(spark, path))
    edges = spark.createDataFrame([(k, k + 1) for k in range(99)] + [(None, 5), (7, 7)], "a long, b long")
    found = sorted(map(tuple, components.connected_components(edges).collect()))
    assert found == [(k, 0) for k in range(100)] and len(rounds) == 1


def test_training_holds_few_responses():
    """The responses at all positions, 24 KB a chunk, are held for some chunks of a batch only."""
    texts = [np.arange(100_000, dtype=np.uint8)] * 4
    tracemalloc.start()
    quality_cnn.train(texts, np.array([0, 1, 0, 1], np.float32), np.ones(4, np.float32), epochs=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24_000 * (400_000 // quality_cnn.STEP)


def test_language_model_tells_tokens_of_a_class_apart(model):
    """Within a class the tokens before decide, after any history its tokens add up to one, and scores use it."""
    fitted, tokens = model
    worker = maxent_lm.Worker(fitted)
    every = [t for t in tokens if t in worker.ids and t]
    ids = worker.encode(every)
    cls, low = worker.classes[ids], np.log10(np.array([tokens[t] for t in every]) + maxent_lm.RARE)
    low -= fitted.leaf_bottom()[cls]
    found = {}
    for history in ([], [b"w1"], [b"w2", b"w7", b"never seen"], [b"never seen", b"w1"], [b"w3", b"w2"]):
        rows = [worker.encode([*history, t]) for t in every]
        p = found[tuple(history)] = np.array([10 ** worker.inside(x, np.zeros(len(x), np.int64), np.full(len(x), y))[-1] for x, y in zip(rows, low, strict=True)])
        for c in set(cls.tolist()):
            assert abs(p[cls == c].sum() - (10 ** low[cls == c]).sum()) < 1e-5
    one, other = found[b"w1",], found[b"w3", b"w2"]
    ratio = one / other
    assert max(ratio[cls == c].max() / ratio[cls == c].min() for c in set(cls.tolist())) > 1.2


def test_language_model_learns_the_order_of_words(spark, monkeypatch):
    """Two texts of the same words in another order: the one whose pairs were seen scores higher, beyond what classes tell."""
    rng = np.random.default_rng(1)
    pairs = [(f"a{k}", f"b{k}") for k in range(40)]
    texts = [" ".join(x for k in rng.permutation(40)[:20] for x in pairs[k]) for _ in range(300)]
    seen, mixed = " ".join(f"a{k} b{k}" for k in range(40)), " ".join(f"a{k} b{(k + 7) % 40}" for k in range(40))
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [*enumerate(texts), (held[0], seen), (held[1], mixed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda: {r["doc_id"]: r["score"] for r in maxent_lm.score_documents(docs).where(F.col("doc_id") >= 1000).collect()}
    found = score()
    monkeypatch.setattr(maxent_lm, "PAIRS", 0)
    classes_only = score()
    assert found[held[0]] > classes_only[held[0]] + 20 and found[held[0]] > -100 > classes_only[held[0]]
    assert found[held[0]] - found[held[1]] > classes_only[held[0]] - classes_only[held[1]] + 20
