"""Quality rules as weak supervision, in DataFrame functions only.

Rules look at counts of a text and vote good (1), bad (-1) or abstain (0). Each watches one trait, and
several watch traits of the same kind of junk, so votes overlap and contradict each other. The votes
of a document form one of at most 3 ** len(RULES) patterns; a grouped count of the patterns is all
that expectation-maximisation needs. Its hidden classes are good documents and the kinds of junk. It
estimates, without labels, how often each rule is right on each class when it votes, and the
posterior probability that a document is good replaces the demand that it pass every rule.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Characters of words that are not letters, and marks that end a sentence by themselves or before a blank or line end.
OTHERS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»–—…“”„•·©®™°±×"
ENDS, SPACED_ENDS = "。？！।۔", ".?!"
#: Shorter texts fail outright, and every rule abstains on them.
MIN_WORDS = 20


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body or its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Number of words in windows of ``window`` words that occur twice or more in the array.

    Windows are compared by 64-bit hashes. Their positions are sorted only where a hash repeats.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(pairs: Column) -> Column:
            def repeats(pair: Column, k: Column) -> Column:
                same = lambda at: F.coalesce(F.get(pairs, at)["h"] == pair["h"], F.lit(False))
                return same(k - 1) | same(k + 1)

            return F.sort_array(F.transform(F.filter(pairs, repeats), lambda pair: pair["i"]))

        zero = F.struct(F.lit(-window).alias("before"), F.lit(0).alias("total"))
        grow = lambda acc, at: F.struct(at.alias("before"), (acc["total"] + F.least(F.lit(window), at - acc["before"])).alias("total"))
        total = F.aggregate(_let(ordered, positions), zero, grow, lambda acc: acc["total"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total)

    def counted(array: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(array) - (window - 1))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(array, i, F.lit(window))))
        return F.when(F.size(array) < window, F.lit(0)).otherwise(_let(hashes, covered))

    return _let(tokens, counted).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the struct column ``measure`` of the counts that the rules look at."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    chars = F.length(text)
    without = lambda drop: chars - F.length(F.translate(text, drop, ""))
    pairs = [chars - F.length(F.replace(text, F.lit(mark + after), F.lit(after))) for mark in SPACED_ENDS for after in " \n"]
    ends = sum(pairs, without(ENDS)) + F.right(text, F.lit(1)).isin(*SPACED_ENDS).cast("int")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def counts(array: Column) -> Column:
        return F.struct(
            F.size(array).cast("long").alias("n_words"),
            F.length(F.array_join(array, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(array)).cast("long").alias("n_distinct"),
            F.size(F.filter(array, lambda w, i: w == F.get(array, i - 1))).cast("long").alias("n_adjacent"),
            repeated_words(array).alias("n_repeat_words"),
        )

    # The identity keeps the optimiser from taking the struct apart and computing a part at each use.
    return docs.withColumn(
        "measure",
        _let(F.struct(
            _let(words(text), counts).alias("w"),
            without(SYMBOLS).cast("long").alias("n_symbols"),
            (chars - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
            F.regexp_count(text, F.lit("[A-ZÀ-ÖØ-Þ]{3}")).cast("long").alias("n_capitals"),
            without(OTHERS).cast("long").alias("n_others"),
            ends.cast("long").alias("n_ends"),
            _let(lines, lambda array: F.struct(F.size(array).cast("long").alias("n"), (F.size(array) - F.size(F.array_distinct(array))).cast("long").alias("dup"))).alias("lines"),
        ), lambda x: x),
    )


#: Rules in the order of their digits, each with the kind of junk that it watches; None: any kind.
RULES = {
    "symbols": "symbols", "letters": "symbols", "capitals": "shouting", "shouts": "shouting", "adjacent": "repetition", "windows": "repetition", "vocabulary": "repetition",
    "lines": "repetition", "sentences": None,
}
KINDS = ("symbols", "shouting", "repetition")


def _votes() -> dict[str, Column]:
    """Vote of each rule: bad beyond one threshold, good within another, else none."""
    m, w = F.col("measure"), F.col("measure.w")
    n, size = w["n_words"], w["word_chars"]
    other, line_count, dup = m["n_others"], m["lines"]["n"], m["lines"]["dup"]
    sides = {
        "symbols": (m["n_symbols"] * 100 > size * 6, m["n_symbols"] * 100 < size),
        "letters": (other * 100 > size * 20, other * 100 < size * 7),
        "capitals": (m["n_capitals"] * 100 > size * 5, m["n_capitals"] * 100 < size),
        "shouts": (m["n_shouts"] * 5 > n, m["n_shouts"] * 50 < n),
        "adjacent": (w["n_adjacent"] * 100 > n * 15, w["n_adjacent"] * 100 < n * 3),
        "windows": (w["n_repeat_words"] * 100 > n * 15, w["n_repeat_words"] * 100 <= n * 2),
        "vocabulary": (((n <= 1000) & (w["n_distinct"] * 3 < n)) | (w["n_distinct"] * 20 < n), w["n_distinct"] * 2 > n),
        "lines": (dup * 3 > line_count, dup == 0),
        "sentences": ((m["n_ends"] * 2 > n) | ((n >= 50) & (m["n_ends"] * 200 < n)), (m["n_ends"] * 50 > n) & (m["n_ends"] * 5 < n)),
    }
    return {name: F.when(n < MIN_WORDS, 0).when(bad, -1).when(good, 1).otherwise(0) for name, (bad, good) in sides.items()}


def pattern() -> Column:
    """The votes as one number in base 3, the first rule's digit the lowest."""
    votes = _votes()
    total = F.lit(0)
    for k, name in enumerate(RULES):
        total = total + (votes[name] + 1) * 3**k
    return total


def votes_of(code: int, n: int = len(RULES)) -> list[int]:
    return [code // 3**k % 3 - 1 for k in range(n)]


def expected_rates() -> list[list[float]]:
    """Share of bad votes among the votes of each rule, on good documents and on each kind of junk, before any data."""
    on = lambda rule, kind: 0.3 if rule is None else 0.8 if rule == kind else 0.1
    return [[0.05] * len(RULES), *[[on(rule, kind) for rule in RULES.values()] for kind in KINDS]]


def estimate(histogram: dict[int, int], hope: list[list[float]] | None = None, rounds: int = 200, trust: float = 0.01) -> tuple[list[float], list[list[float]]]:
    """Expectation-maximisation over a histogram of vote patterns.

    Returns the shares of the classes, good documents first, and for each class and rule the share of
    bad votes among the votes the rule casts there; a rule's accuracy is one less that on good
    documents, and that itself on junk. Abstaining says nothing. The expected rates count as
    ``trust`` times all voting documents, so a class that is absent keeps its meaning; the shares
    start from nine tenths good. Documents on which all rules abstain are left out; without any
    others, the expected rates are returned.
    """
    hope = hope or expected_rates()
    classes, n = len(hope), len(hope[0])
    rates = [list(x) for x in hope]
    shares = [0.9] + [0.1 / (classes - 1)] * (classes - 1)
    rows = []
    for code, count in sorted(histogram.items()):
        votes = votes_of(code, n)
        if any(votes):
            rows.append(([k for k, v in enumerate(votes) if v < 0], [k for k, v in enumerate(votes) if v > 0], count))
    total = sum(count for _, _, count in rows)
    weight = max(1.0, trust * total)
    for _ in range(rounds if total else 0):
        logs = [(math.log(s), [math.log(x) for x in r], [math.log(1 - x) for x in r]) for s, r in zip(shares, rates, strict=True)]
        size, bad, good = [0.0] * classes, [[0.0] * n for _ in hope], [[0.0] * n for _ in hope]
        for against, for_, count in rows:
            z = [s + sum(b[k] for k in against) + sum(g[k] for k in for_) for s, b, g in logs]
            top = max(z)
            p = [math.exp(x - top) for x in z]
            whole = sum(p)
            for c in range(classes):
                mass = p[c] / whole * count
                size[c] += mass
                for k in against:
                    bad[c][k] += mass
                for k in for_:
                    good[c][k] += mass
        before = rates
        rates = [[(b + weight * h) / (b + g + weight) for b, g, h in zip(*x, strict=True)] for x in zip(bad, good, hope, strict=True)]
        shares = [(x + 1) / (total + classes) for x in size]
        if max(abs(x - y) for r, s in zip(rates, before, strict=True) for x, y in zip(r, s, strict=True)) < 1e-9:
            break
    return shares, rates


def _odds(votes: list[int], model: tuple[list[float], list[list[float]]], junk: int) -> float:
    """Log odds of a kind of junk against good, given the votes."""
    shares, rates = model
    out = math.log(shares[junk] / shares[0])
    for v, good, bad in zip(votes, rates[0], rates[junk], strict=True):
        out += math.log(bad / good) if v < 0 else math.log((1 - bad) / (1 - good)) if v > 0 else 0.0
    return out


def probability_of(code: int, model: tuple[list[float], list[list[float]]]) -> float:
    """Probability that a document with this vote pattern is good."""
    votes = votes_of(code, len(model[1][0]))
    return 1 / (1 + sum(math.exp(min(_odds(votes, model, k), 700.0)) for k in range(1, len(model[0]))))


def posterior(code: Column, model: tuple[list[float], list[list[float]]]) -> Column:
    """:func:`probability_of` as a column."""
    shares, rates = model
    junk = F.lit(0.0)
    for k in range(1, len(shares)):
        odds = F.lit(math.log(shares[k] / shares[0]))
        for i, (good, bad) in enumerate(zip(rates[0], rates[k], strict=True)):
            digit = F.floor(code / 3**i) % 3
            odds = odds + F.when(digit == 0, math.log(bad / good)).when(digit == 2, math.log((1 - bad) / (1 - good))).otherwise(0.0)
        junk = junk + F.exp(odds)
    return 1 / (1 + junk)


def _measured_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that the rules need, without the struct behind them."""
    m, w = F.col("measure"), F.col("measure.w")
    counts = {"n_words": w["n_words"], "word_chars": w["word_chars"], "n_symbols": m["n_symbols"], "n_dup_lines": m["lines"]["dup"], "n_repeat_words": w["n_repeat_words"], "pattern": pattern()}
    return measured(docs).select(*docs.columns, *[c.alias(name) for name, c in counts.items()])


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def _histogram(rows: DataFrame) -> dict[int, int]:
    return {r["pattern"]: r["count"] for r in rows.groupBy("pattern").count().collect()}


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, posterior and kept of every row of ``docs`` (doc_id, text).

    Null texts have no words and fail; repeated rows are each returned and each counted; an empty
    table gives no rows; other columns are not read. The counts are made in one pass over the texts
    and written to the shared folder, then the patterns are counted and every row is judged.
    """
    rows = materialize(_measured_rows(docs.select("doc_id", "text")).drop("text"), "quality-rules")
    good = posterior(F.col("pattern"), estimate(_histogram(rows)))
    return rows.withColumns({"base_failed": _base_failed(), "posterior": good}).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)).drop("pattern")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns and nothing else.

    Rows with null texts fail; repeated rows are each kept or dropped alike; an empty table stays
    empty. The rows are written once to the shared folder beside their vote pattern, so each text is
    measured once and a filter on the verdict cannot pull the measures into itself. Which of the
    patterns are good is decided on the driver, which sees at most 3 ** len(RULES) of them.
    """
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    rows = materialize(_measured_rows(row).select("row", (~_base_failed()).alias("passed"), "pattern"), "quality-rules-rows")
    histogram = _histogram(rows)
    model = estimate(histogram)
    good = sorted(code for code in histogram if probability_of(code, model) >= 0.5)
    return rows.where(F.col("passed") & F.col("pattern").isin(good)).select("row.*")
