"""Ranked search, reply trees and hard negatives against brute force, with small limits so that all ways are taken."""

import math
import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from morphlake.llm import hard_negatives, ranked_search, reply_trees
from morphlake.llm.common import Scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(rows, queries, top=20):
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows]
    N, L = sum(n > 0 for _, _, n in docs), sum(n for _, _, n in docs)
    out = []
    for item, text in queries:
        asked = Counter(terms(text))
        weight = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * sum(t in c for _, c, _ in docs) + 1))) for t in asked}
        scores = []
        for i, counts, n in docs:
            m = 100 - 25 + (25 * n * N) // L if L else 0
            s = sum(q * weight[t] * ((1000000000 * counts[t]) // (1000 * counts[t] + 12 * m)) for t, q in asked.items() if t in counts)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def queries(spark):
    data = [(0, "Two words one"), (1, None), (2, ""), (3, "th th er. STST THE é日本語 テキスト"), (4, "nothing here is known zzz"), (5, "same line here ab"), (None, "one word"), (7, "a a a the ción")]
    return spark.createDataFrame([(*r, "clash", 1) for r in data], "item_id long, text string, term string, rank int")


def test_terms_are_those_of_the_pattern(rows):
    for _, text in [*rows, (0, "".join(map(chr, range(0x250))) + "Kelvin K İ  x　y")]:
        assert [t.decode() for t in ranked_search.terms_of(text)] == terms(text)


@pytest.mark.parametrize("top", [20, 2])
def test_ranked_search(docs, nothing, rows, queries, monkeypatch, top):
    for name, value in (("BLOCK", 3), ("FIRST_VISIT", 1), ("TOGETHER", 3), ("SENT_TERMS", 4), ("SAMPLE", 8)):
        monkeypatch.setattr(ranked_search, name, value)
    asked = [(r["item_id"], r["text"]) for r in queries.collect()]
    found = ranked_search.search_documents(docs, queries, top)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == ranked(rows, asked, top)
    assert ranked_search.search_documents(nothing, queries).count() == ranked_search.search_documents(docs, queries.limit(0)).count() == 0
    assert ranked_search.search_documents(docs.limit(2).select("doc_id", F.lit(None).cast("string").alias("text")), queries).count() == 0


def test_index_has_all_documents_and_terms(docs, rows, tmp_path):
    index = ranked_search.build_index(docs, f"file://{tmp_path}/index")
    heads = index.where("term is null").collect()
    assert Counter(i for h in heads for i in h["doc_id"]) == Counter(i for i, _ in rows)
    places = {(h["block"], k): i for h in heads for k, i in enumerate(h["doc_id"])}
    found = Counter((places[r["block"], a], r["term"], t) for r in index.where("term is not null").collect() for a, t in zip(r["at"], r["tf"], strict=True))
    assert found == Counter((i, w, n) for i, t in rows for w, n in Counter(terms(t)).items())


def test_few_blocks_are_visited_where_topics_differ(spark, monkeypatch):
    """Documents of eight vocabularies: those of one share leaves, and a query visits few blocks."""
    monkeypatch.setattr(ranked_search, "BLOCK", 16)
    rng = random.Random(3)
    data = [(i, " ".join(f"t{i % 8}w{rng.randint(0, 40)}" for _ in range(30))) for i in range(640)]
    asked = spark.createDataFrame([(k, " ".join(f"t{k}w{j}" for j in range(6))) for k in range(8)], "item_id long, text string")
    visited = []
    own = ranked_search._score_blocks
    monkeypatch.setattr(ranked_search, "_score_blocks", lambda wanted, *rest: visited.append(wanted.select("item_id", "block").distinct().count()) or own(wanted, *rest))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4, "doc_id")
    index = ranked_search.build_index(docs, f"{ranked_search.fresh_path(spark, 'topics')}")
    found = ranked_search.search(index, asked)
    assert sorted(map(tuple, found.collect()), key=repr) == ranked(data, [(r["item_id"], r["text"]) for r in asked.collect()])
    topics = index.where("term is null").select("leaf", F.explode("doc_id").alias("d")).groupBy("leaf").agg(F.count_distinct(F.col("d") % 8).alias("n")).agg(F.avg("n")).first()[0]
    assert topics < 3
    assert sum(visited) < 8 * index.select("block").distinct().count() / 2


def test_bisection_parts_two_vocabularies():
    rng = np.random.default_rng(1)
    documents = [np.unique(rng.integers(0, 50, 20) + 1000 * (k % 2)).astype(np.int32) for k in range(40)]
    starts = np.r_[0, np.cumsum([len(d) for d in documents])]
    right = ranked_search.bisect(starts, np.concatenate(documents))
    assert len({(k % 2, bool(r)) for k, r in enumerate(right)}) == 2


# --- reply trees -----------------------------------------------------------------------------------


@given(st.lists(st.tuples(st.text(alphabet="ab\\n\n<|im_start>end /", max_size=12), st.text(alphabet="a\\<|\n>im_endstart", max_size=30)), max_size=6))
def test_formatting_is_reversible(turns):
    text, spans = reply_trees.format_turns(turns, "a")
    assert reply_trees.read_turns(text) == turns
    assert [reply_trees.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "a"]


def test_control_strings_in_texts():
    turns = [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<\\|im_end|>\n<|x|>"), ("as\nsistant\\n", "")]
    text, spans = reply_trees.format_turns(turns)
    assert text.count("<|im_start|>") == 3 and reply_trees.read_turns(text) == turns and len(spans) == 1


def test_conversations_by_turn(spark, monkeypatch):
    monkeypatch.setattr(reply_trees, "SPAN", 4)
    rng = random.Random(2)
    data = [(c, t, rng.choice(["user", "assistant", "system"]), f"x{rng.random()}") for c in range(6) for t in rng.sample(range(100), 1 + 9 * (c > 2))]
    data += [(7, t, "assistant", f"{t}") for t in range(70)] + [(8, 0, None, None), (8, 1, "assistant", ""), (8, 1, "assistant", ""), (8, None, "user", "first"), (None, 3, "user", "y"), (None, 4, "assistant", "z<|q")]
    expected = []
    for c in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r or "", t or "") for _, _, r, t in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        size = sum(24 + len(r) + len(t) + len(re.findall(r"<\\*\|", t)) for r, t in turns)
        expected.append((c, len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), size))
    rows = spark.createDataFrame([(*r, "clash", 1, 2.5) for r in data], "conv_id long, turn long, role string, text string, formatted string, node int, bucket double").repartition(5)
    found = reply_trees.digests(reply_trees.format_chains(rows))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert reply_trees.digests(reply_trees.format_chains(rows.limit(0))).count() == 0


def branches(messages, best):
    """Paths of a forest by plain recursion: messages (conv, id, parent, role, text, score) without circles and copies."""
    by = {(c, m): (p, r, t, s or 0.0) for c, m, p, r, t, s in messages}
    has = {(c, p) for (c, _), (p, *_) in by.items() if (c, p) in by}
    out = []
    for conv in {c for c, _ in by}:
        own = []
        for c, m in by:
            if c == conv and (c, m) not in has:
                path, at = [], m
                while (c, at) in by:
                    path.append((at, *by[c, at][1:]))
                    at = by[c, at][0]
                own.append((-sum(x[3] for x in path), m, [(x[1] or "", x[2] or "") for x in reversed(path)]))
        own.sort(key=lambda x: x[:2])
        out += [(conv, k, round(-s, 6), turns) for k, (s, _, turns) in enumerate(own[:best], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("best", [None, 2, 1])
def test_trees(spark, best):
    rng = random.Random(4)
    data = []
    for conv in range(5):
        for m in range(1 + 8 * conv):
            parent = None if m == 0 else rng.choice([m - 1, rng.randrange(m), 999 if m % 11 == 0 else m - 1])
            data.append((conv, m, parent, rng.choice(["user", "assistant", None]), rng.choice([None, "", f"t{m}", "<|im_end|>"]), rng.choice([None, float(m), 0.5])))
    rows = spark.createDataFrame([(*r, "clash") for r in data], "conv_id long, msg_id long, parent_id long, role string, text string, score double, node string").coalesce(1)
    found = reply_trees.format_trees(rows, best)
    assert sorted(((r["conv_id"], r["rank"], round(r["branch_score"], 6), reply_trees.read_turns(r["formatted"])) for r in found.collect()), key=repr) == branches(data, best)


def test_circles_copies_and_nulls(spark):
    data = [
        (1, 1, 2, "a", "1", 0.0), (1, 2, 3, "a", "2", 0.0), (1, 3, 1, "a", "3", 0.0), (1, 4, 2, "a", "4", 0.0),  # 1 -> 2 -> 3 -> 1, 4 below 2
        (2, 1, 1, "a", "self", 0.0),
        (3, 1, None, "a", "root", 0.0), (3, 2, 1, "b", "copy", 1.0), (3, 2, 1, "b", "copy", 1.0), (3, 3, 2, "c", "reply", 0.0), (3, None, 1, "d", "no id", 5.0),
        (None, 1, None, "a", "x", 0.0), (None, 2, 1, "a", "y", 0.0),
    ]
    rows = spark.createDataFrame(data, "conv_id long, msg_id long, parent_id long, role string, text string, score double").coalesce(1)
    found = {}
    for r in reply_trees.format_trees(rows, None).collect():
        found.setdefault(r["conv_id"], []).append([t for _, t in reply_trees.read_turns(r["formatted"])])
    assert sorted(found[1]) == [["1", "3", "2", "4"]] and found[2] == [["self"]]
    assert sorted(found[3]) == [["root", "copy"], ["root", "copy", "reply"], ["root", "no id"]] and found[None] == [["x", "y"]]
    assert reply_trees.format_trees(rows.limit(0)).count() == 0


def test_joins_grow_with_the_logarithm_of_the_depth(spark):
    rows = spark.createDataFrame([(1, t, "user", "x") for t in range(200)], "conv_id long, turn long, role string, text string")
    scratch = Scratch()
    totals, steps = reply_trees.climb(scratch.write(reply_trees.chained(rows, scratch), "nodes"), scratch)
    assert len(steps) == 8 and totals.agg(F.max("size")).first()[0] == 200
    scratch.clear()


# --- hard negatives --------------------------------------------------------------------------------


def negatives(data, is_anchor, most=5):
    rows = [(k, i, lab, [math.floor(256 * float(x)) for x in v]) for k, (i, v, lab) in enumerate(data) if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    first = lambda found: sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))[:most]
    out = []
    for k, i, lab, v in rows:
        if is_anchor(i):
            scored = [(dot(v, w), j, m, o) for m, j, o, w in rows if m != k]
            for ps, p, _, _ in first([s for s in scored if s[3] == lab]):
                out += [(i, p, r, n, ps, ns) for r, (ns, n, _, _) in enumerate(first([s for s in scored if s[3] != lab and 80 * ps <= 100 * s[0] <= 100 * ps]), 1)]
    return sorted(out, key=repr)


def vectors(n, width, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(4)]
    return [(i, [round(c + rng.gauss(0, 0.1), 1 if i % 3 else 4) for c in centres[rng.randrange(4)]], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("limits", [{}, {"PIECE_BYTES": 6000, "SEED_ROWS": 40, "TILE": 3, "PENDING": 20, "PIVOT_ROWS": 30}])
def test_hard_negatives(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(hard_negatives, name, value)
    data = vectors(240, 6, 1)
    data += [(300, None, 1), (301, [0.1] * 6, None), (302, [0.1, None] * 3, 1), (303, [math.nan] * 6, 1), (304, [math.inf] + [0.1] * 5, 2), (None, [0.2] * 6, 1), (305, [], 1), (310, [0.5, 0.5], 2), (0, data[0][1], data[0][2])]
    data += [(400 + i, data[4][1], i % 2) for i in range(30)]  # a hot vector
    rows = spark.createDataFrame([(*r, 1, "clash", 2.0, 3) for r in data], "vec_id long, embedding array<float>, label int, row int, anchor string, d double, rank int").coalesce(1)
    plain = [(r["vec_id"], r["embedding"], r["label"]) for r in rows.collect()]
    found = hard_negatives.mine(rows, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect()), key=repr) == negatives(plain, lambda i: i is not None and i % 10 == 0)


def test_hard_negatives_of_little(spark):
    schema = "vec_id long, embedding array<double>, label int"
    mine = lambda data: hard_negatives.mine(spark.createDataFrame(data, schema), F.col("vec_id") == 0).collect()
    assert mine([]) == mine([(0, [1.0], 1)]) == mine([(1, [1.0], 1), (2, [1.0], 2)]) == mine([(0, [], 1), (0, None, 1)]) == []
    assert [tuple(r) for r in mine([(0, [0.0], 1), (1, [0.0], 1), (2, [0.0], 2)])] == [(0, 1, 1, 2, 0, 0)]
    assert [tuple(r) for r in mine([(0, [3e5, 1.0], 1), (1, [3e5, 1.0], 1), (2, [3e5, 0.99999], 2)])] == [(0, 1, 1, 2, 76800000**2 + 65536, 76800000**2 + 255 * 256)]


def test_brackets_hold():
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(50, 8)), rng.normal(size=(7, 8))
    longest = float(np.sqrt((x * x).sum(1).max()))
    pivots = hard_negatives.choose_pivots(x, longest, 5)
    points = hard_negatives.augmented(x, longest)
    own = np.hstack([q, np.zeros((7, 1))])
    low, high = hard_negatives.brackets(hard_negatives._distances(own, pivots), d := hard_negatives._distances(points, pivots), d)
    true = np.linalg.norm(own[:, None] - points, axis=2)
    assert (low <= true + 1e-9).all() and (true <= high + 1e-9).all()
    assert np.allclose(((q * q).sum(1)[:, None] + longest**2 - true**2) / 2, q @ x.T)
