import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, fp string, score string, kept string, digest string"


def _rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "er", "on", "é", "ß", "ción", "a", "st"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() + ("." if i % 9 == 8 else "") for i in range(n))
    shared = prose(40)
    near = prose(120)
    texts = [
        None, "", "   \n\t ", "one", "Two words", "The the THE the", "<|endoftext|> a<|startoftext|>b", shared, shared, near, near.replace("th", "TH", 1), "x" * 450, "ab" * 300, "\n".join(["same line here"] * 40),
        prose(3000) + "\n" + shared, prose(60) + " " + shared + " " + prose(30), shared[5:] + prose(10), "## $$ %% && ** " * 30, "GO!! " * 60, prose(200), prose(200), "日本語 テキスト 한국어", "a\x1cb\x85c　d e",
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(7, shared), (100, None), (None, "no id at all"), (None, None)]
    return [(i, t, "en", "s", None if t is None else len(t), "clash", "clash", "clash", "clash", "clash") for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return [(r[0], r[1]) for r in _rows()]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, copies, columns with clashing names."""
    data = _rows()
    data[3] = data[3][:2] + (None,) * 8
    return spark.createDataFrame(data, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(20)] + [(None, 1, 0), (400, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
