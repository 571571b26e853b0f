"""Each operator on awkward rows against brute force, and on an empty table."""

import hashlib
import itertools
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash

from morphlake.llm import iblt, language_id, maxent_lm, packing, quality_cnn, quality_rules, simhash, suffix_dedup
from morphlake.llm.bpe_codec import WordBpe, encode_documents
from morphlake.llm.token_counts import token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def pairs(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_token_counts(docs, nothing, rows, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    expected = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 5) for i, t in rows), key=repr)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        assert pairs(token_counts(docs, path, cache, limit=5), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    stored = docs.sparkSession.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == len({t or "" for _, t in rows})
    assert token_counts(nothing, path).count() == 0


def test_piece_counts(docs, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert pairs(token_counts(docs, path), "doc_id", "n_tokens") == sorted(((i, len(model.encode(t or ""))) for i, t in rows), key=repr)


def test_bpe_codec(docs, nothing, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)

    def expected(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    found = pairs(encode_documents(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert found == sorted(((i, *expected(t)) for i, t in rows), key=repr)
    own = WordBpe(path)
    ids, decoded = own.encode("Hello wörld, it's 42!")
    assert own.decode(ids) == decoded.decode()
    assert encode_documents(nothing, path).count() == 0


def test_quality_rules(docs, nothing, rows):
    def expected(i, text):
        text = text or ""
        w = WORD.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        count = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if count[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        return i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)

    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = quality_rules.judge(docs)
    assert pairs(found, *names) == sorted((expected(i, t) for i, t in rows), key=repr)
    assert found.where("kept and base_failed").count() == 0
    assert quality_rules.judge(nothing).count() == 0
    assert quality_rules.keep_good(docs).columns == docs.columns


def _votes(text):
    """The nine rules again, on plain strings."""
    text = text or ""
    w = WORD.findall(text)
    n, size = len(w), sum(map(len, w))
    if n < 20:
        return [0] * 9
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count = Counter(tuple(w[k : k + 8]) for k in range(n - 7))
    covered = len({p for k in range(n - 7) if count[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)})
    symbols, others = sum(c in "#*$%&|<>" for c in text), sum(c in "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»–—…“”„•·©®™°±×" for c in text)
    capitals, shouts, near = len(re.findall("[A-ZÀ-ÖØ-Þ]{3}", text)), text.count("!"), sum(x == y for x, y in zip(w, w[1:], strict=False))
    ends = len(re.findall(r"[.?!](?=[ \n]|\Z)", text)) + sum(c in "。？！।۔" for c in text)
    distinct, dup = len(set(w)), len(lines) - len(set(lines))
    sides = [
        (symbols / size > 0.06, symbols / size < 0.01), (others / size > 0.2, others / size < 0.07), (capitals / size > 0.05, capitals / size < 0.01), (shouts / n > 0.2, shouts / n < 0.02),
        (near / n > 0.15, near / n < 0.03), (covered / n > 0.15, covered / n <= 0.02), (n <= 1000 and distinct * 3 < n or distinct * 20 < n, distinct * 2 > n), (dup * 3 > len(lines), dup == 0),
        (ends * 2 > n or n >= 50 and ends * 200 < n, n < 50 * ends and ends * 5 < n),
    ]
    return [-1 if bad else int(good) for bad, good in sides]


def _posteriors(votes, rounds=2000):
    """Expectation-maximisation over documents instead of patterns, in numpy."""
    v = np.array(votes)
    kinds = [0, 0, 1, 1, 2, 2, 2, 2, None]
    hope = np.array([[0.05] * 9, *[[0.3 if k is None else 0.8 if k == j else 0.1 for k in kinds] for j in range(3)]])
    rates, shares = hope.copy(), np.array([0.9, 0.1 / 3, 0.1 / 3, 0.1 / 3])
    voting = v[(v != 0).any(1)]
    trust = max(1.0, 0.01 * len(voting))

    def classes(v):
        z = np.log(shares) + (v < 0) @ np.log(rates).T + (v > 0) @ np.log(1 - rates).T
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    for _ in range(rounds):
        p = classes(voting)
        bad, good = p.T @ (voting < 0), p.T @ (voting > 0)
        rates, shares = (bad + trust * hope) / (bad + good + trust), (p.sum(0) + 1) / (len(voting) + 4)
    return classes(v)[:, 0]


def _junk_and_prose(spark, n=300):
    """Prose, junk of three kinds, and prose that trips a single rule."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9))))
    prose = lambda m: " ".join(word() + ("." if k % 11 == 10 else "") for k in range(m))
    out = []
    for k in range(n):
        base = prose(int(rng.integers(30, 200)))
        junk = [" ".join(x + "###" for x in base.split()), " ".join(x.upper() + "!!" for x in base.split()), " ".join(" ".join([x] * 12) for x in base.split()[:40])]
        out.append((k, junk[k // 10 % 3] if k % 10 == 9 else base + "\n" + base[: len(base) // 8] if k % 30 == 4 else base))
    out += [(n, None), (n + 1, ""), (n + 2, "too short"), (5, out[5][1])]
    return out, spark.createDataFrame(out, "doc_id long, text string")


def test_rule_posteriors(spark):
    """The model over patterns is that over documents; single bad votes are outweighed, joint ones are not."""
    data, docs = _junk_and_prose(spark)
    votes = [_votes(t) for _, t in data]
    expected = _posteriors(votes)
    found = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for (i, _), p in zip(data, expected, strict=True):
        assert abs(found[i]["posterior"] - p) < 1e-6 and found[i]["kept"] == (not found[i]["base_failed"] and p >= 0.5)
    kept = [sum(x < 0 for x in v) for v, (i, _) in zip(votes, data, strict=True) if found[i]["kept"]]
    dropped = [i for i, r in found.items() if not r["kept"]]
    assert 1 in kept and {i for i, _ in data if i % 10 == 9 and i < 300} <= set(dropped) and len(dropped) < 40
    good = sorted(r["doc_id"] for r in quality_rules.keep_good(docs).collect())
    assert good == sorted(i for i, _ in data if found[i]["kept"])


def test_rule_accuracies():
    """Expected rates hold without data; classes that are absent keep their meaning."""
    shares, rates = quality_rules.estimate({})
    assert rates == quality_rules.expected_rates()
    code = sum(2 * 3**k for k in range(9))
    shares, rates = quality_rules.estimate({code: 1000})
    assert shares[0] > 0.95 and quality_rules.probability_of(code, (shares, rates)) > 0.99
    assert quality_rules.probability_of(0, (shares, rates)) < 0.01


def test_rules_stage_plan(spark, docs, nothing):
    kept = quality_rules.keep_good(docs)
    assert len(kept._jdf.queryExecution().optimizedPlan().toString()) < 50_000
    assert quality_rules.keep_good(nothing).count() == 0 and kept.schema == docs.schema


def test_cnn_pools_whole_texts():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 256, n, dtype=np.uint8) for n in (0, 1, 63, 64, 65, 256, 257, 500, 3000)]
    net = quality_cnn.train(texts, np.array([0, 1] * 4 + [1], np.float32), np.ones(9, np.float32), epochs=1)
    whole = quality_cnn.pooled(net, texts)
    small, quality_cnn.PIECE_CHUNKS = quality_cnn.PIECE_CHUNKS, 2
    try:
        assert np.allclose(whole, quality_cnn.pooled(net, texts, budget=100), atol=1e-5)
    finally:
        quality_cnn.PIECE_CHUNKS = small
    # every chunk by hand
    data = np.concatenate([texts[-1], np.zeros(16, np.uint8)])
    y = np.stack([net.embed[data[p * 4 : p * 4 + 8]].ravel() @ net.filters for p in range(750)])
    chunks = np.stack([np.maximum(y[k * 48 : k * 48 + 64].max(0) + net.bias, 0) for k in range(-(-(47 - 1) // 3))])
    assert np.allclose(whole[-1], np.concatenate([chunks.max(0), chunks.mean(0)]), atol=1e-4)


def test_cnn_on_rows(docs, nothing, labels, rows):
    found = quality_cnn.classify(docs, labels, sample_rows=50)
    out = found.collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    assert quality_cnn.classify(nothing, labels).count() == 0
    assert {r["score"] for r in quality_cnn.classify(docs, labels.where("quality = 1")).collect()} != set()
    kept = quality_cnn.keep(docs, labels, sample_rows=50)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in out)


def test_cnn_learns(spark):
    good = [(i, " ".join(["the quick brown fox jumps"] * (1 + i % 5)), 1) for i in range(0, 300, 2)]
    bad = [(i, "!! $$ ## " * (3 + i % 7), 0) for i in range(1, 300, 2)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    out = quality_cnn.classify(df.drop("quality"), df.drop("text")).join(df.drop("text"), "doc_id").where("held_out").collect()
    assert len(out) > 20 and np.mean([r["predicted"] == r["quality"] for r in out]) > 0.95


def _fingerprint(text):
    w = WORD.findall(lower(text))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(prints))]


def test_simhash(docs, nothing, rows):
    prints = [_fingerprint(t) for _, t in rows]
    roots = _components(prints)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    expected = sorted(((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, roots, strict=True)), key=repr)
    assert pairs(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expected
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({r for (i, _), r in zip(rows, roots, strict=True) if i is not None}) + 2


@pytest.mark.parametrize("hot", [64, 2])
def test_simhash_links(spark, monkeypatch, hot):
    """Chains, clusters and crowded segments give the same components by either way."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(3)
    prints = {0}
    for base in rng.integers(0, 1 << 63, 6).tolist():
        for _ in range(25):
            prints.add(base)
            base ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
    prints |= {7 << 40 | 1 << b for b in range(32)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r["node"]: r["root"] for r in simhash.connected_components(simhash.links(nodes)).collect()}
    groups = lambda labels: sorted(sorted(signed[i] for i in g) for g in labels.values())
    by_root, by_found = {}, {}
    for i, r in enumerate(_components(prints)):
        by_root.setdefault(r, []).append(i)
        by_found.setdefault(found.get(signed[i], signed[i]), []).append(i)
    assert groups(by_root) == groups(by_found)


def test_pipeline_near_dedup(spark):
    """The stage links all texts of 0.8 of common five-word shingles or more, and no others."""
    import corpus_pipeline

    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(5000)}"
    notice = " ".join(word() for _ in range(30))
    texts = [None, "", "  ", "one two", "ONE  two", "one three"]
    for size in (12, 60, 300):
        for changes in (0, 1, 2, 4, 8, 12):
            base = [word() for _ in range(size)]
            for _ in range(4):  # each differs from the one before
                texts.append(" ".join(base))
                for at in rng.integers(0, size, changes).tolist():
                    base[at] = word()
    texts += [" ".join(word() for _ in range(20)) + " " + notice for _ in range(30)]
    crowd = [word() for _ in range(200)]
    texts += [" ".join([*crowd[:k], word(), *crowd[k + 1 :]]) for k in range(0, 200, 4)]

    def shingles(text):
        w = lower(text).split()
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def _dedup(rows):
    signed = lambda t: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(t.encode(), 42)))[0]
    order = sorted({(i, signed(t or ""), t or "") for i, t in rows if i is not None})
    seen, out = set(), {}
    for i, _, t in order:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        out[i, t] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def _expected_dedup(rows):
    by = _dedup(rows)
    out = []
    for i, t in rows:
        n, removed, spans, kept = by.get((i, t or ""), (len((t or "").encode()), 0, 0, (t or "").encode()))
        out.append((i, n, removed, spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


DEDUP = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _passages(rng, n):
    """Documents of passages that many share, near copies, and texts of one id."""
    letters = list("abcdefgh     ")
    prose = lambda m: "".join(rng.choice(letters, m))
    common = [prose(int(rng.integers(90, 400))) for _ in range(4)]
    out = []
    for k in range(n):
        t = prose(int(rng.integers(0, 300))) + common[int(rng.integers(4))] + prose(int(rng.integers(0, 200)))
        out.append((k, t))
        if k % 5 == 0:
            at = int(rng.integers(len(t)))
            out.append((k + 1000, t[:at] + "X" + t[at:]))
        if k % 7 == 0:
            out.append((k, t[: len(t) // 2] + prose(50)))
    out += [(2000, "ab" * 400), (2001, "ab" * 400), (2002, common[0] * 3), (3, None), (3, "")]
    return out


@pytest.mark.parametrize("crowd", [4096, 1])
def test_suffix_dedup(spark, docs, nothing, rows, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    assert pairs(suffix_dedup.deduplicate(docs), *DEDUP) == _expected_dedup(rows)
    shared = _passages(np.random.default_rng(crowd), 60)
    assert pairs(suffix_dedup.deduplicate(spark.createDataFrame(shared, "doc_id long, text string").repartition(4)), *DEDUP) == _expected_dedup(shared)
    if crowd > 1:
        assert suffix_dedup.deduplicate(nothing).count() == 0
        cut = suffix_dedup.cut_repeats(docs)
        assert cut.columns == docs.columns and cut.count() == len(rows)


def test_suffix_dedup_in_pieces(spark, monkeypatch):
    """Texts above PIECE, small shards and tasks give the same result; without the merge nothing goes."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2000)
    shared = _passages(np.random.default_rng(5), 40)
    shared += [(3000, " ".join(t or "" for _, t in shared[:20])), (3001, "q" * 9000)]
    df = spark.createDataFrame(shared, "doc_id long, text string").repartition(4)
    expected = _expected_dedup(shared)

    def in_parts(name, value):
        """Settings that Python workers read: the module's functions are run in this process."""
        with monkeypatch.context() as m:
            m.setattr(suffix_dedup, name, value)
            data = np.frombuffer(shared[-2][1].encode(), np.uint8)
            return [x.tolist() for x in suffix_dedup.anchors(data)]

    whole = in_parts("PIECE", 1 << 22)
    h, at, n = in_parts("PIECE", 500)
    covered = lambda at, n: sorted(p for s, m in zip(at, n, strict=True) for p in range(s, s + (m & 0xFFFF)))
    assert covered(at, n) == covered(whole[1], whole[2]) and set(whole[0]) <= set(h)
    assert pairs(suffix_dedup.deduplicate(df), *DEDUP) == expected
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*[(k // 3, k, 0, 5, 5, None, False, data) for k, data in enumerate([b"a" * 150, b"b" * 120, b"a" * 130, b"c" * 140, b"c" * 100, b"d" * 100])], strict=True)], names=list("abcdefgh"))]
    large = [b.to_pylist() for b in suffix_dedup._merge_task(batches)]
    monkeypatch.setattr(suffix_dedup, "TASK_BYTES", 10)
    assert [b.to_pylist() for b in suffix_dedup._merge_task(batches)] == large
    monkeypatch.setattr(suffix_dedup, "merge_transforms", lambda *a: (np.zeros(0, np.int64),) * 4)
    assert not any(len(b) for b in suffix_dedup._merge_task(batches))


def test_only_the_merge_removes(spark, monkeypatch):
    shared = _passages(np.random.default_rng(8), 20)
    df = spark.createDataFrame(shared, "doc_id long, text string")

    def nothing_merged(batches):
        for _ in batches:
            pass
        yield suffix_dedup._batch([[]] * 5, suffix_dedup.FOUND)

    monkeypatch.setattr(suffix_dedup, "_merge_task", nothing_merged)
    assert {r["n_removed"] for r in suffix_dedup.deduplicate(df).collect()} == {0}


def test_merged_transforms():
    """Intervals, common prefixes and repeats are those of all suffixes compared with each other."""
    rng = np.random.default_rng(2)
    groups = [[bytes(rng.integers(97, 99, int(rng.integers(1, 30)), dtype=np.uint8)) for _ in range(6)] for _ in range(4)]
    weights = rng.integers(1, 3, 24).tolist()
    both = [suffix_dedup.shard_transform(g) for g in groups]
    strings = [s for g in groups for s in g]
    for (before, order), g in zip(both, groups, strict=True):
        text = b"".join(s + b"\0" for s in g)
        starts = np.cumsum([0] + [len(s) + 1 for s in g])[:-1]
        key = lambda p: (text[p:].split(b"\0")[0], int(np.searchsorted(starts, p, side="right")))
        assert [key(p) for p in order.tolist()] == sorted(key(p) for p in range(len(text)))
        assert before.tolist() == [0 if p in starts else text[p - 1] + 1 for p in order.tolist()]
    suffixes = [(i, k) for i, s in enumerate(strings) for k in range(len(s) + 1)]
    offsets = np.cumsum([0] + [len(b) for b, _ in both])
    of_row = [suffixes[p + at] for (_, order), at in zip(both, offsets, strict=False) for p in order.tolist()]
    depth = 7
    rows, interval, _, shared = suffix_dedup.merge_transforms([b for b, _ in both], np.array([weights[i] for i, _ in of_row]), depth)
    times = Counter()
    for i, k in suffixes:
        for h in range(1, depth + 1):
            if k + h <= len(strings[i]):
                times[strings[i][k : k + h]] += weights[i]
    longest = [max((h for h in range(1, depth + 1) if k + h <= len(strings[i]) and times[strings[i][k : k + h]] > 1), default=0) for i, k in of_row]
    assert shared.tolist() == longest
    texts = [strings[i][k : k + depth] for i, k in (of_row[r] for r in rows.tolist())]
    assert sorted(rows.tolist()) == [r for r, h in enumerate(longest) if h == depth] and texts == sorted(texts, key=lambda x: list(x))
    assert [a == b for a, b in zip(texts, texts[1:], strict=False)] == [a == b for a, b in zip(interval.tolist(), interval[1:].tolist(), strict=False)]
    string, offset, settled = suffix_dedup.repeated_places(strings, weights, depth, 40)
    assert sorted(zip(string.tolist(), offset.tolist(), strict=True)) == sorted(of_row[r] for r in rows.tolist())
    by = {}
    for i, k, group in zip(string.tolist(), offset.tolist(), settled.tolist(), strict=True):
        by.setdefault(group, set()).add(strings[i][k : k + depth])
    assert all(len(x) == 1 for x in by.values()) and len(by) == len(set(texts))


def _xx(seed, *values):
    """Hash of longs, ints and strings, one seeding the next."""
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, seed)
    return seed


def _check(key):
    return _xx(42, struct.pack("<Q", key & ~0xFFFF), "check") & 0xFFFF


def _places_of(key, width):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(_xx(42, struct.pack("<Q", key), struct.pack("<i", part), struct.pack("<i", width))) % width + width * part for part in range(3)]


def _invert(fingerprint):
    """All digests of a fingerprint, from its text alone, by peeling group after group."""
    out = set()
    for group in fingerprint.split(";"):
        cells = [[int(n), int(x, 16)] if c else [0, 0] for c in group.split(",") for n, _, x in [c.partition(".")]]
        while any(n for n, _ in cells):
            key = next(x for n, x in cells if n == 1 and _check(x) == x & 0xFFFF)
            out.add(key)
            for at in _places_of(key, len(cells) // 3):
                cells[at][0] -= 1
                cells[at][1] ^= key
        assert cells == [[0, 0]] * len(cells)
    return out


def _like(a, b):
    return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))


def test_iblt(docs, nothing, rows):
    order = sorted(((t or "", i) for i, t in rows), key=lambda x: x[0])
    order.sort(key=lambda x: -(x[1] if x[1] is not None else -(1 << 63)))
    out = {}
    pieces = lambda x: set(re.findall(r"[^\n]{1,256}", x))
    for k, (t, i) in enumerate(order):
        n, other = len(t) // 3, order[(k + 1) % len(order)][0]
        edited = t[: len(t) - n] + other[:n]
        a, b, c = pieces(t), pieces(edited), pieces(other)
        out.setdefault(repr(i), []).append((len(t), hashlib.sha256(edited.encode()).hexdigest(), round(_like(a, b), 9), round(_like(a, c), 9)))
    found, prints = {}, {}
    for r in iblt.fingerprints(docs).collect():
        found.setdefault(repr(r["doc_id"]), []).append((r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)))
        prints.setdefault(repr(r["doc_id"]), []).append(r)
        assert round(_like(_invert(r["fingerprint"]), _invert(r["edited_fingerprint"])), 9) == round(r["near_edited"], 9)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in out.items()}
    once = {i: t or "" for i, t in rows if len(prints[repr(i)]) == 1}
    by_text = {}
    for k, i in enumerate(sorted(once, key=lambda i: -(i if i is not None else -(1 << 63)))):
        r = prints[repr(i)][0]
        by_text.setdefault(once[i], set()).add(r["fingerprint"])
        assert len(_invert(r["fingerprint"])) == len(pieces(once[i]))
    assert all(len(x) == 1 for x in by_text.values()) and len({x for v in by_text.values() for x in v}) == len({frozenset(pieces(t)) for t in by_text})
    assert iblt.fingerprints(nothing).count() == 0


def test_iblt_on_prose(spark):
    """Likeness to the next document, too, follows from the fingerprint columns alone; ranges cut by size give the same neighbours."""
    _, docs = _junk_and_prose(spark, 60)
    docs = docs.where("doc_id < 60").dropDuplicates(["doc_id"])
    found = {r["doc_id"]: r for r in iblt.fingerprints(docs).collect()}
    ids = sorted(found, reverse=True)
    for i, following in zip(ids, [*ids[1:], ids[0]], strict=True):
        own = _invert(found[i]["fingerprint"])
        assert round(_like(own, _invert(found[following]["fingerprint"])), 9) == round(found[i]["near_next"], 9)
        assert round(_like(own, _invert(found[i]["edited_fingerprint"])), 9) == round(found[i]["near_edited"], 9)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for ranges, size in ((3, 64), (200, 1 << 20), (2, 1)):
        neighbours = {r["doc_id"]: r["next_text"] for r in iblt.with_next(docs, ranges, size).collect()}
        assert neighbours == {i: text[following] for i, following in zip(ids, [*ids[1:], ids[0]], strict=True)}


def test_iblt_recovers_differences(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    data = [(k, rng.integers(0, 1 << 60, n).tolist(), rng.integers(0, 1 << 60, m).tolist()) for k, (n, m) in enumerate([(0, 0), (1, 0), (5, 5), (40, 3), (150, 160)])]
    data = [(k, a, b + a[: len(a) // 2]) for k, a, b in data]
    df = spark.createDataFrame(data, "k int, a array<long>, b array<long>")
    checked = lambda c: F.transform(c, lambda x: x.bitwiseAND(F.lit(~0xFFFF)).bitwiseOR(iblt._check(x)))
    df = df.select("k", checked("a").alias("a"), checked("b").alias("b"))
    for r in df.select("a", "b", iblt.difference(F.col("a"), F.col("b")).alias("d"), iblt.recovered(F.col("a"), F.col("b")).alias("whole")).collect():
        for side in (r["d"], r["whole"]["found"]):
            assert set(side["ours"]) == set(r["a"]) - set(r["b"]) and set(side["theirs"]) == set(r["b"]) - set(r["a"])
    sizes = [len(r["whole"]["cells"]) for r in df.select("k", iblt.recovered(F.col("a"), F.col("b")).alias("whole")).orderBy("k").collect()]
    assert sizes[0] == sizes[1] == 12 < sizes[3] < sizes[4]  # larger sketches where smaller ones get stuck


def test_packing(docs, nothing, rows):
    out = packing.pack(docs, budget=200, buckets=3).collect()
    assert sorted((r["n_tokens"] for r in out)) == sorted(len(WORD.findall(t or "")) for _, t in rows)
    batches = {}
    for r in out:
        assert r["padding"] == r["bucket_tokens"] - r["n_tokens"] >= 0
        batches.setdefault(r["batch_id"], []).append(r["bucket_tokens"])
    assert all(len(b) == 1 or sum(b) <= 200 for b in batches.values()) and all(len(set(b)) == 1 for b in batches.values())
    assert packing.pack(nothing).count() == 0


def test_boundaries_are_optimal():
    rng = np.random.default_rng(8)
    for _ in range(20):
        histogram = {int(x): int(n) for x, n in zip(rng.choice(40, 9, replace=False), rng.integers(1, 30, 9), strict=True)}
        lengths = sorted(histogram)
        cost = lambda upper: sum(n * (min(u for u in upper if u >= x) - x) for x, n in histogram.items())
        for k in (1, 2, 4, 9, 12):
            best = min(cost([*c, lengths[-1]]) for size in range(min(k, 9)) for c in itertools.combinations(lengths[:-1], size))
            found = packing.boundaries(histogram, k)
            assert len(found) <= k and cost(found) == best
    assert packing.boundaries({}, 4) == []


def test_language_model(docs, nothing, rows):
    held = {i: zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2 for i, _ in rows}
    tokens = lambda t: lower(t).encode().split() + [b""]
    counts = Counter(w for i, t in rows if not held[i] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted(((i, held[i], len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows), key=repr)
    out = maxent_lm.score_documents(docs).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out), key=repr) == expected
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in out)
    assert maxent_lm.score_documents(nothing).count() == 0


def test_language_model_is_a_distribution():
    words = [b"a", b"b", b"c", b"dd", b""]
    model = maxent_lm.Model([(w, 9 - i) for i, w in enumerate(words)], 35, 5, {b"a": np.arange(5.0), b"b": np.ones(5)})
    model.weights[:] = np.random.default_rng(0).normal(0, 0.3, model.weights.shape)
    model.class_counts += np.bincount(model.classes, model.counts, maxent_lm.CLASSES)
    worker = maxent_lm.Worker(model)
    ids = worker.encode([b"a", b"c", b"unseen", b"b", b""])
    logs = worker.class_logs(worker.features(ids, np.zeros(5, np.int64)))
    assert np.allclose(np.exp(logs).sum(1), 1, atol=1e-5)
    leaf = (model.counts + maxent_lm.RARE) / 10 ** model.leaf_bottom()[model.classes]
    for c in set(model.classes.tolist()):
        assert abs(leaf[model.classes == c].sum() - 1) < 1e-9


def test_language_model_fits_on_every_part(spark):
    """Class totals are those of all training tokens, and each part of the texts moves weights."""
    texts = [(f"lead{k} next{k} " * 5 + f"once{k}{j}", k) for k in range(maxent_lm.PARTS) for j in range(6)]
    train = spark.createDataFrame(texts, "text string, part long")
    tokens = Counter(w for t, _ in texts for w in maxent_lm.tokens_of(t))
    counts = spark.createDataFrame([(w, c) for w, c in tokens.items()], "token binary, c long")
    model = maxent_lm.fit(train, counts)
    worker = maxent_lm.Worker(model)
    assert model.class_counts.sum() == sum(tokens.values())
    ids = worker.encode(list(tokens))
    cls = worker.classes[ids]
    leaf = (np.array(list(tokens.values())) + maxent_lm.RARE) / 10 ** model.leaf_bottom()[cls]
    for c in set(cls.tolist()):
        unseen = maxent_lm.RARE / 10 ** model.leaf_bottom()[c] if maxent_lm.TAIL_CLASS <= c < maxent_lm.END_CLASS else 0
        assert abs(leaf[cls == c].sum() + unseen - 1) < 1e-9
    for k in range(maxent_lm.PARTS):
        row = worker.features(worker.encode([f"lead{k}".encode(), f"next{k}".encode()]), np.zeros(2, np.int64))[1, 1]
        assert np.abs(model.weights[row]).max() > 0.1


def test_topics_see_every_text(spark, monkeypatch):
    """Each head token has its count in all training texts, also in long ones, shared among the topics."""
    texts = [f"short{k % 7} word " * 3 for k in range(40)] + [f"long{k} " * (maxent_lm.SAMPLE_BYTES // 4) for k in range(3)] + [None, ""]
    tokens = Counter(w for t in texts for w in maxent_lm.tokens_of(t))
    train = spark.createDataFrame([(t or "", k % maxent_lm.PARTS) for k, t in enumerate(texts)], "text string, part long")
    counts = spark.createDataFrame(list(tokens.items()), "token binary, c long")
    seen, made = [], maxent_lm.Model.__init__
    monkeypatch.setattr(maxent_lm.Model, "__init__", lambda *a: seen.append(a[4]) or made(*a))
    maxent_lm.fit(train, counts)
    assert {t: round(float(x.sum()), 6) for t, x in seen[0].items()} == {t: c for t, c in tokens.items() if t and c > 2}


def test_language_id(spark):
    words = {"en": "the and of with that there ", "de": "der die und mit nicht eine ", "fr": "les une avec dans pour être "}
    labelled = spark.createDataFrame([(lang, w * 30) for lang, w in words.items()] + [(None, "x"), ("en", None)], "lang string, text string")
    page = lambda lang, text: f'<!DOCTYPE html><html lang="{lang}"><script>var der=1;</script><body><p>{text}</p></body></html>'
    data = [(i, f"http://{lang}.example.{lang}/x{i}", page(lang, words[lang] * 4)) for i, lang in enumerate(["en", "de", "fr"] * 4)]
    data += [(50, "http://de.example.de/y", ""), (51, None, None), (52, "no url", "<p></p>"), (1, data[1][1], data[1][2]), (None, "", page("zz", words["fr"]))]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS lang", "0 AS p0")
    out = language_id.identify(pages, labelled).collect()
    assert len(out) == len(data)
    found = {r["page_id"]: r["lang"] for r in out}
    assert [found[i] for i in range(12)] == ["en", "de", "fr"] * 4 and found[50] == "de" and found[None] == "fr"
    assert all(0 < r["probability"] <= 1 for r in out)
    assert language_id.identify(pages.limit(0), labelled).count() == 0
    assert {r["lang"] for r in language_id.identify(pages, labelled.limit(0)).collect()} == {None}


def _fused(pages, langs, table):
    """The fusion page by page: all sums run over the other pages."""
    n = len(langs)
    text, hosts, said = [], [], []
    for _, url, source in pages:
        found = language_id._buckets(language_id.visible_text(source))
        sums = table[found].sum(0) * min(1.0, 40.0 / len(found)) if len(found) else np.zeros(n)
        p = np.exp(sums - sums.max())
        text.append(p / p.sum())
        m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", (url or "").lower())
        hosts.append(m[1].removesuffix(".") if m else "")
        m = re.search(r"<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})\b", source or "", re.S | re.I)
        said.append("none" if not m else m[1].lower() if m[1].lower() in langs else "other language")

    def levels(host):
        labels = host.split(".")
        country = len(labels) > 2 and len(labels[-1]) == 2 and len(labels[-2]) <= 3
        return labels[-1], ".".join(labels[-3:] if country else labels[-2:]), host

    out = []
    for k in range(len(pages)):
        others = [j for j in range(len(pages)) if j != k]
        prior = (sum((text[j] for j in others), np.zeros(n)) + 4.0 / n) / (len(others) + 4.0)
        for level in range(3):
            same = [j for j in others if levels(hosts[j])[level] == levels(hosts[k])[level]]
            prior = (sum((text[j] for j in same), np.zeros(n)) + 4.0 * prior) / (len(same) + 4.0)
        rate = np.array([(sum(text[j][x] for j in others if said[j] == said[k]) + (0.5 if said[k] == lang else 0.5 / (n + 1))) / (sum(text[j][x] for j in others) + 1.0) for x, lang in enumerate(langs)])
        joint = np.maximum(text[k], 1e-12) * rate * np.maximum(prior, 1e-12)
        out.append((langs[int(joint.argmax())], joint.max() / joint.sum()))
    return out


def test_language_id_fuses_all_evidence(spark):
    rng = np.random.default_rng(6)
    words = {"en": "the and of with that there".split(), "de": "der die und mit nicht eine".split(), "fr": "les une avec dans pour être".split()}
    labelled = spark.createDataFrame([(lang, " ".join(w * 20)) for lang, w in words.items()], "lang string, text string")
    hosts = ["http://a.example.co.uk/", "https://b.example.co.uk:80/x", "http://user@news.example.de/", "http://example.fr./", "http://www.other.com/", "", None, "nonsense"]
    pages = []
    for k in range(90):
        lang = list(words)[int(rng.integers(3))]
        said = [f' lang="{lang}"', "", " lang=zz", f" lang='{list(words)[int(rng.integers(3))]}'"][int(rng.integers(4))]
        body = " ".join(rng.choice(words[lang], int(rng.integers(0, 9)))) if k % 9 else ""
        pages.append((k, hosts[int(rng.integers(len(hosts)))], f"<html{said}><p>{body}</p></html>" if k % 13 else None))
    langs, table = language_id.train(labelled)
    expected = _fused(pages, langs, table)
    out = {r["page_id"]: r for r in language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), labelled).collect()}
    for (k, _, _), (lang, p) in zip(pages, expected, strict=True):
        assert out[k]["lang"] == lang and abs(out[k]["probability"] - p) < 1e-9


def test_language_id_learns_every_language(spark):
    """Also a rare one of more than 32, with its declarations; too many are refused."""
    letters = "bcdfghjklmnpqrstvwxz"
    name = lambda k: f"{letters[k // 20]}{letters[k % 20]}"
    words = {name(k): " ".join(f"{letters[k % 20]}{v}{letters[k // 20]}{letters[(k * 7) % 20]}{v}" for v in "aeiou") for k in range(40)}
    labelled = spark.createDataFrame([(x, w) for k, (x, w) in enumerate(words.items()) for _ in range(1 + (k < 39))], "lang string, text string")
    data = [(k, None, f'<html lang="{x}"><p>{words[x]}</p>') for k, x in enumerate(words)]
    out = language_id.identify(spark.createDataFrame(data, "page_id long, url string, html string"), labelled).collect()
    assert {r["page_id"]: r["lang"] for r in out} == dict(enumerate(words)) and len(out) == 40
    many = spark.range(language_id.LANGUAGES + 1).selectExpr("cast(id as string) AS lang", "'x' AS text")
    with pytest.raises(ValueError):
        language_id.train(many)


def test_pipeline_stages(spark, docs, labels, tmp_path):
    import corpus_pipeline

    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert after.columns == docs.columns and after.count() <= df.count()
        df = after
    assert {"doc_id", "batch_id"} <= set(df.columns)
