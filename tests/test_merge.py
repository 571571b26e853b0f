"""Merging against a plain specification, token by token."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from morphlake.functions import tagset as T
from morphlake.operators.dictionary import Dictionary
from morphlake.operators.merge import extended_tags

TAGS = ["NNG", "NNP", "SN", "SC", "EC", "VV+EC", "XR", "SL", "NNBC"]
WORDS = {"ab": "NNG", "abc": "NNP", "bc": "NNG", "an": "NNG", "ac": "MAG", "b": "VV", "cab": "NNG"}


def spec_pass(tokens, most):
    out, i = [], 0
    while i < len(tokens):
        found = None
        for n in range(most, 1, -1):
            if i + n > len(tokens) - 1:
                continue
            run = tokens[i : i + n]
            pattern = "+".join("NNG" if t in T.NOUN_TAGS else t for _, t in run)
            tries = [] if pattern in T.UNMERGED_PATTERNS else ["".join(s for s, _ in run)]
            if pattern in T.SKIP_PATTERNS:
                tries += ["".join("n" if t == "SN" else s for s, t in run), "".join(s for s, t in run if t not in T.SKIPPED_TAGS)]
            found = next(((x, WORDS[x.lower()], n) for x in tries if x.lower() in WORDS), None)
            if found:
                break
        out.append(found[:2] if found else tokens[i])
        i += found[2] if found else 1
    return out


def spec(tokens):
    def retag(rows):
        tags = [WORDS.get(s.lower(), t).split("+")[0] for s, t in rows]
        return [(s, "NNG" if t == "XR" else t) for (s, _), t in zip(rows, tags, strict=True)]

    return retag(spec_pass(spec_pass(retag([(s.strip(), t) for s, t in tokens]), 7), 3))


@pytest.mark.parametrize("limit", [None, 0])  # sent to all tasks, and joined
def test_equals_specification(spark, limit):
    documents = st.lists(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "ab", "-", "1", "A"]), st.sampled_from(TAGS)), max_size=9), min_size=60, max_size=60)
    words = Dictionary.empty(spark)
    for tag in ("NNG", "NNP", "MAG", "VV"):
        words = words.add_words([w for w, t in WORDS.items() if t == tag], tag)

    @settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
    @given(documents)
    def check(docs):
        df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, tokens array<struct<surface:string,tag:string>>")
        found = {r["doc_id"]: [tuple(t) for t in r["tokens"]] for r in extended_tags(df, words, limit=limit).collect()}
        spark.catalog.clearCache()
        assert found == {i: spec(d) for i, d in enumerate(docs)}

    check()


@pytest.mark.parametrize("limit", [None, 0])
def test_tag_of_a_pattern_and_odd_tokens(spark, limit):
    words = Dictionary.empty(spark).add_words(["anb", "ὀδυσσεύςα", "cd"], "NNG")
    patterns = ["NNG+SN+NNG", "SSO+NNG+SSC"]
    docs = [
        (0, [("a", "NNG"), ("7", "SN"), ("B", "NNG"), ("x", "SF")]), (0, [("ὈΔΥΣΣΕΎΣ", "VV"), ("Α", "VV"), ("x", "SF")]), (None, None), (2, []), (3, [(None, "NNG"), ("c", None), ("d", "VV"), (" ", "SC"), ("x", None)]),
        (4, [("(", "SSO"), ("cd", "NNG"), (")", "SSC"), ("x", "SF")]),
    ]
    df = spark.createDataFrame([(*d, [("clash", "NNG")]) for d in docs], "doc_id long, tokens array<struct<surface:string,tag:string>>, row array<struct<surface:string,tag:string>>")
    found = sorted(((r["doc_id"], [tuple(t) for t in r["tokens"]]) for r in extended_tags(df, words, skip_patterns=patterns, limit=limit).collect()), key=repr)
    spark.catalog.clearCache()
    expected = [(0, [("anB", "NNG"), ("x", "SF")]), (0, [("ὈΔΥΣΣΕΎΣ", "VV"), ("Α", "VV"), ("x", "SF")]), (2, []), (3, [("cd", "NNG"), ("x", None)]), (4, [("cd", "NNG"), ("x", "SF")]), (None, [])]
    assert found == sorted(expected, key=repr)


def test_last_token_and_compound_tags(spark):
    words = Dictionary.empty(spark).add_words(["ab"], "NNG")
    docs = spark.createDataFrame([(0, [("a", "MAJ"), ("b", "NNG")]), (1, [("a", "MAJ"), ("b", "NNG"), ("x", "VV+EC")])], "doc_id long, tokens array<struct<surface:string,tag:string>>")
    found = {r["doc_id"]: [tuple(t) for t in r["tokens"]] for r in extended_tags(docs, words).collect()}
    assert found == {0: [("a", "MAJ"), ("b", "NNG")], 1: [("ab", "NNG"), ("x", "VV")]}
