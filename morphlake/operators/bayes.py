"""Naive Bayes tone classifier as tables, its training, evaluation and feature choice.

Documents are rows (doc_id, label, features), label 1 or -1, features an array of strings of which
only presence counts; ids tell documents apart. A model is three tables: priors (label, logp),
conditionals (feature, logp_pos, logp_neg, and the counts they come from) and the sizes of the classes.
All of ``by`` are columns that keep several fits apart in one plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import SLICE, bounded_batches
from ..functions.tagset import EPSILON
from ..sources import versions
from . import phrases

GAMMA = 0.5
# Fixed value: what an expectation of zero counts as.
LEAST = 1e-20
#: Splits whose memberships one mask holds.
MASK_BITS = 60


#: Buckets of the high bits of a hash in which the place of a row is found.
BUCKETS = 4096


def split_by_class(docs: DataFrame, ratio: float = 0.7, seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the flag ``train``: the first share of each class in the order of a seeded hash.

    The last row of each share is found from counts of hash buckets and the ids of one bucket, so
    features are neither sorted nor shuffled. Rows of one id and class are on one side.
    """
    seeded = by or (F.lit(seed),)
    ends = _sent(_last_of_share(docs.select(*by, "label", "doc_id", F.xxhash64("doc_id", *seeded).alias("h")), ratio, by))
    own = F.struct(F.xxhash64("doc_id", *seeded).alias("h"), F.col("doc_id"))
    return docs.join(F.broadcast(ends), [*by, "label"], "left").withColumn("train", F.coalesce(own <= F.col("end"), F.lit(False))).drop("end")  # a row a class


def _sent(rows: DataFrame) -> DataFrame:
    """A few ``rows``, found now and not again by each that reads them."""
    return rows.sparkSession.createDataFrame(rows.toArrow(), rows.schema)


def _last_of_share(ids: DataFrame, ratio: float, by: tuple[str, ...]) -> DataFrame:
    """label and ``end``, the last (h, doc_id) of the share, of rows (label, doc_id, h); no row for an empty share."""
    keys = [*by, "label"]
    ids = ids.withColumn("bucket", F.shiftright("h", 52))
    counts = ids.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))  # BUCKETS rows a class at most
    whole = Window.partitionBy(*keys)
    counts = counts.withColumns({"upto": F.sum("n").over(whole.orderBy("bucket")), "wanted": F.floor(F.sum("n").over(whole) * ratio)})
    last = counts.where((F.col("upto") - F.col("n") < F.col("wanted")) & (F.col("wanted") <= F.col("upto")))
    last = last.select(*keys, "bucket", (F.col("wanted") - F.col("upto") + F.col("n")).alias("place"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))
    return ids.join(last, [*keys, "bucket"]).withColumn("at", place).where(F.col("at") == F.col("place")).select(*keys, F.struct("h", "doc_id").alias("end"))


def feature_counts(docs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """feature, n_pos and n_neg: documents of each label that have it."""
    rows = docs.select(*by, "label", F.explode(F.array_distinct("features")).alias("feature"))
    return rows.groupBy(*by, "feature").agg(F.count_if(F.col("label") > 0).alias("n_pos"), F.count_if(F.col("label") < 0).alias("n_neg"))


def label_counts(docs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return docs.groupBy(*by).agg(F.count_if(F.col("label") > 0).alias("all_pos"), F.count_if(F.col("label") < 0).alias("all_neg"))


def priors(docs: DataFrame) -> DataFrame:
    """label and logp by expected-likelihood estimation."""
    n, labels = F.sum("n").over(Window.partitionBy()), F.count("*").over(Window.partitionBy())
    rows = docs.groupBy("label").agg(F.count("*").alias("n"))  # one row a label
    return rows.select("label", F.ln((F.col("n") + GAMMA) / (n + GAMMA * labels)).alias("logp"))


def conditionals(docs: DataFrame, by: tuple[str, ...] = (), sizes: DataFrame | None = None) -> DataFrame:
    """feature, logp_pos, logp_neg, n_pos and n_neg; a feature of every document has one value, others two.

    ``sizes`` is :func:`label_counts` of the documents, if it is known without their features.
    """
    counts, sizes = feature_counts(docs, by), label_counts(docs, by) if sizes is None else sizes
    rows = counts.join(sizes, list(by)) if by else counts.crossJoin(sizes)  # one row of sizes
    bins = F.when((F.col("n_pos") == F.col("all_pos")) & (F.col("n_neg") == F.col("all_neg")), 1).otherwise(2)
    logp = lambda n, size: F.ln((F.col(n) + GAMMA) / (F.col(size) + bins * GAMMA))
    return rows.select(*by, "feature", logp("n_pos", "all_pos").alias("logp_pos"), logp("n_neg", "all_neg").alias("logp_neg"), "n_pos", "n_neg")


def classify(docs: DataFrame, model: DataFrame, sizes: DataFrame, cutoff: float = 1.3, by: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, polarity, intensity, pos_score and neg_score of documents (doc_id, features).

    Features that the model lacks say nothing. ``sizes`` is :func:`label_counts` of the training
    rows. Polarity is zero unless the intensity is beyond the cut-off.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), *by, "doc_id", "features")
    numbered = numbered.select("row", *by, "doc_id", F.explode_outer(F.array_distinct("features")).alias("feature"))
    sums = numbered.join(model, [*by, "feature"], "left").groupBy("row", *by, "doc_id").agg(F.sum("logp_pos").alias("p"), F.sum("logp_neg").alias("n"))
    rows = sums.na.fill(0.0, ["p", "n"])
    rows = rows.join(sizes, list(by)) if by else rows.crossJoin(sizes)  # one row of sizes
    total = F.col("all_pos") + F.col("all_neg") + 2 * GAMMA
    odds = F.col("n") + F.ln((F.col("all_neg") + GAMMA) / total) - F.col("p") - F.ln((F.col("all_pos") + GAMMA) / total)
    pos = 1 / (1 + F.exp(odds))
    rows = rows.withColumn("pos_score", pos).withColumn("neg_score", 1 - F.col("pos_score"))
    high, low = F.greatest("pos_score", "neg_score"), F.least("pos_score", "neg_score")
    rows = rows.withColumn("intensity", high / (low + EPSILON))
    polarity = F.when(F.col("intensity") > cutoff, F.col("pos_score") - F.col("neg_score")).otherwise(0.0)
    return rows.select(*by, "doc_id", polarity.alias("polarity"), "intensity", "pos_score", "neg_score")


def chi_square(n_ii: Column, n_ix: Column, n_xi: Column, n: Column) -> Column:
    """Association of a cell of a 2 x 2 table with its margins."""
    n_ii, n_ix, n_xi, n = (x.cast("double") for x in (n_ii, n_ix, n_xi, n))
    n_io, n_oi = n_xi - n_ii, n_ix - n_ii
    n_oo = n - n_ii - n_io - n_oi
    below = (n_ii + n_io) * (n_ii + n_oi) * (n_io + n_oo) * (n_oi + n_oo)
    return F.try_divide(n * (n_ii * n_oo - n_io * n_oi) ** 2, below)


def word_scores(docs: DataFrame) -> DataFrame:
    """feature, n_pos, n_neg and score of all word occurrences: the two labels' chi-squares together."""
    rows = docs.select("label", F.explode("features").alias("feature"))
    counts = rows.groupBy("feature").agg(F.count_if(F.col("label") > 0).alias("n_pos"), F.count_if(F.col("label") < 0).alias("n_neg"))
    totals = counts.agg(F.sum("n_pos").alias("all_pos"), F.sum("n_neg").alias("all_neg"))
    freq, n = F.col("n_pos") + F.col("n_neg"), F.col("all_pos") + F.col("all_neg")
    value = lambda k: F.coalesce(chi_square(F.col(f"n_{k}"), freq, F.col(f"all_{k}"), n), F.lit(0.0))
    return counts.crossJoin(totals).select("feature", "n_pos", "n_neg", (value("pos") + value("neg")).alias("score"))  # one row of totals


def best_words(docs: DataFrame, ratio: float = 0.2) -> DataFrame:
    """The share of the vocabulary with the highest scores; ties in order of a hash of the word.

    The last score that is taken comes from counts by ranges of score, narrowed until few words are
    left, and of the words with just this score those beyond a hash, found the same way. So no task
    sorts the vocabulary. Its scores are computed once: written to the session's checkpoint folder, or
    where it has none kept by the executors, of which lost ones are made again.
    """
    scores, taken = _scores_taken(docs, ratio)
    return scores.where(taken).drop("h")


def _scores_taken(docs: DataFrame, ratio: float) -> tuple[DataFrame, Column]:
    """:func:`word_scores` with a hash ``h`` of the word, and the condition on them of :func:`best_words`."""
    scores = _once(word_scores(docs).withColumn("h", F.xxhash64("feature")))
    left = int(scores.count() * ratio)
    least, place = _key_of_place(scores, "score", left) if left else (None, 0)
    edge, _ = _key_of_place(scores.where(F.col("score") == F.lit(least)), "h", place) if left else (None, 0)
    score = F.col("score")
    taken = (score > F.lit(least)) | ((score == F.lit(least)) & (F.col("h") >= F.lit(edge))) if left else F.lit(False)
    return scores, taken


def _once(rows: DataFrame) -> DataFrame:
    """``rows`` for several readers, written to the folder of ``spark.checkpoint.dir``, until the driver's JVM ends."""
    spark, context = rows.sparkSession, rows.sparkSession.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if not folder.isDefined():
        return rows.persist()
    path = f"{folder.get()}/bayes-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(rows.schema).parquet(path)


def _left_out(scores: DataFrame, taken: Column) -> np.ndarray | None:
    """The hashes, in order, of the words that are not taken, to be sent to all tasks.

    None if they are more than may be sent, or if one of them is also the hash of a word that is taken;
    among the words of ``scores`` a hash then does not tell which are which.
    """
    rest = scores.where(~taken).select("h")
    if rest.count() * 8 > phrases.SENT_BYTES:
        return None
    both = scores.groupBy("h").agg(F.bool_or(taken).alias("some"), F.bool_and(taken).alias("every")).where("some and not every")
    return np.sort(rest.toArrow()["h"].to_numpy()) if both.isEmpty() else None


def _key_of_place(rows: DataFrame, name: str, left: int, few: int = 1 << 18) -> tuple:
    """The key of place ``left`` in falling order of a column, and that place among equal keys."""
    key = F.col(name)
    while True:
        keys = rows.groupBy(key.alias("k")).count().limit(few + 1).toArrow()
        if keys.num_rows <= few:
            for k, n in sorted(zip(keys["k"].to_pylist(), keys["count"].to_pylist(), strict=True), reverse=True):
                if left <= n:
                    return k, left
                left -= n
        ends = rows.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.percentile_approx(key, [k / 64 for k in range(1, 64)]).alias("bounds")).first()
        bounds = sorted({*ends["bounds"], ends["low"]})
        if len(bounds) == 1:  # nearly all are the least
            bounds.append(ends["high"])
        bucket = F.lit(0)
        for k, x in enumerate(bounds[1:], 1):
            bucket = F.when(key >= F.lit(x), k).otherwise(bucket)
        for b, n in sorted(((r["b"], r["count"]) for r in rows.groupBy(bucket.alias("b")).count().collect()), reverse=True):
            if left <= n:
                break
            left -= n
        rows = rows.where(key >= F.lit(bounds[b]))
        if b + 1 < len(bounds):
            rows = rows.where(key < F.lit(bounds[b + 1]))


def _own_best(docs: DataFrame, best: DataFrame) -> DataFrame:
    """``docs`` with ``own``, those of their features that ``best`` (feature) has, each once, in order; by ids."""
    rows = docs.select("doc_id", F.explode(F.array_distinct("features")).alias("feature")).join(best.select("feature"), "feature", "left_semi")
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("feature")).alias("own"))
    return docs.join(lists, "doc_id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))


def only_best(docs: DataFrame, best: DataFrame) -> DataFrame:
    """Documents with those of their features that ``best`` (feature) has."""
    return _own_best(docs, best).withColumn("features", F.col("own")).drop("own")


def _square_of_pairs(whole: np.ndarray, first: np.ndarray, second: np.ndarray, total: np.ndarray) -> np.ndarray:
    """:func:`chi_square` of counts of pairs, of their words and of all words."""
    with_second, with_first = second - whole, first - whole
    neither = total - whole - with_second - with_first
    below = (whole + with_second) * (whole + with_first) * (with_second + neither) * (with_first + neither)
    above = total * (whole * neither - with_second * with_first) ** 2
    return np.divide(above, below, out=np.zeros_like(above), where=below != 0)


def _deviation(whole: np.ndarray, pairs: tuple[np.ndarray, ...], singles: tuple[np.ndarray, ...], total: np.ndarray) -> np.ndarray:
    """Pearson's sum over the eight cells of a 2 x 2 x 2 table: squared deviation from independence over expectation.

    ``whole`` counts the triple, ``pairs`` its first two, outer two and last two words, ``singles`` its words.
    """
    first, outer, last = pairs
    one, two, three = singles
    cells = {(1, 1, 1): whole, (1, 1, 0): first - whole, (1, 0, 1): outer - whole, (0, 1, 1): last - whole}
    cells[1, 0, 0] = one - whole - cells[1, 1, 0] - cells[1, 0, 1]
    cells[0, 1, 0] = two - whole - cells[1, 1, 0] - cells[0, 1, 1]
    cells[0, 0, 1] = three - whole - cells[1, 0, 1] - cells[0, 1, 1]
    cells[0, 0, 0] = total - sum(cells.values(), 0.0)
    margin = lambda k, v: singles[k] if v else total - singles[k]
    out = 0.0
    for at, cell in cells.items():
        expected = margin(0, at[0]) * margin(1, at[1]) * margin(2, at[2]) / (total * total)
        out = out + (cell - expected) ** 2 / (expected + LEAST)
    return out


def _collocations(column: pa.ListArray, sizes: tuple[int, ...], top: int, kept: Callable[[np.ndarray], np.ndarray] | None = None) -> list[tuple[np.ndarray, pa.Array]]:
    """For each size the n-grams of a column of words that their document's own counts favour, by document and in order
    of their text, and which document each is of.

    Before them, if ``kept`` says of places in the column whether their words count, each document's distinct words that do.
    """
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = column.flatten().dictionary_encode()
    words = coded.dictionary
    in_order = pc.sort_indices(words).to_numpy()  # codes in order of the words, so ties go by code
    rank = np.empty(len(words) + 1, np.int64)
    rank[in_order], rank[-1] = np.arange(len(words)), -1
    code = rank[coded.indices.fill_null(len(words)).to_numpy(zero_copy_only=False)]
    words, n = words.take(pa.array(in_order)), len(words) + 1
    # A space sorts before all else that words have, unless they hold white space themselves.
    by_words = not pc.any(pc.match_substring_regex(words, "[\\x00-\\x20]")).as_py()
    doc, total = np.repeat(np.arange(len(lengths)), lengths), lengths.astype(float)

    def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each distinct key is first, which one each key is, and how often each occurs."""
        _, at, which, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        return at, which, count.astype(float)

    words_at, own, single = counted(doc * n + code + 1)  # a null has the code -1
    of_word = single[own]
    next_to = (doc[:-1] == doc[1:]) & (code[:-1] >= 0) & (code[1:] >= 0)
    start = np.flatnonzero(next_to)
    first, pair, of_pair = counted((doc[start] * n + code[start]) * n + code[start + 1])

    def texts(at: np.ndarray, size: int) -> tuple[np.ndarray, pa.Array]:
        at = at[np.lexsort((*[code[at + k] for k in reversed(range(size))], doc[at]))]
        parts = [words.take(pa.array(code[at + k])) for k in range(size)]
        found, owner = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0], doc[at]
        if not by_words:
            found = found.take(pc.sort_indices(pa.table({"d": owner, "x": found}), [("d", "ascending"), ("x", "ascending")]))
        return owner, found

    out = []
    if kept is not None:
        at = words_at[code[words_at] >= 0]
        out.append(texts(at[kept(at)], 1))
    for size in sizes:
        if size == 2:
            at = start[first]
            value = _square_of_pairs(of_pair, of_word[at], of_word[at + 1], total[doc[at]])
        else:
            place = np.full(len(code) + 1, -1)
            place[start] = pair
            begins = np.flatnonzero((place[:-1] >= 0) & (place[1:] >= 0))
            head, _, whole = counted(place[begins] * n + code[begins + 2] if len(begins) else begins)
            _, around, of_outer = counted((doc[begins] * n + code[begins]) * n + code[begins + 2] if len(begins) else begins)
            at = begins[head]
            pairs = of_pair[place[at]], of_outer[around[head]], of_pair[place[at + 1]]
            value = _deviation(whole, pairs, (of_word[at], of_word[at + 1], of_word[at + 2]), total[doc[at]]) if len(at) else np.zeros(0)
        best = np.lexsort((-value, doc[at]))
        at = at[best]
        begin = np.searchsorted(doc[at], np.arange(len(lengths)))
        out.append(texts(at[np.arange(len(at)) - begin[doc[at]] < top], size))
    return out


def _with_collocations(docs: DataFrame, sizes: tuple[int, ...], top: int, own: str | None = None, left_out: np.ndarray | None = None) -> DataFrame:
    """``docs`` whose features are the best n-grams of each size of its words, after those of the column ``own``, if one
    is named, or its distinct words without those of the hashes ``left_out``, if they are given.

    N-grams are counted within a document, so each is done where it lies, some at a time.
    """
    if left_out is not None:
        own, sent = "own", docs.sparkSession.sparkContext.broadcast(left_out)
        docs = docs.withColumn(own, F.transform("features", lambda w: F.xxhash64(w)))
    place, before, by_hash = docs.columns.index("features"), docs.columns.index(own) if own else None, left_out is not None

    def not_left_out(hashes: np.ndarray) -> np.ndarray:
        rest = sent.value
        return rest[np.minimum(np.searchsorted(rest, hashes), len(rest) - 1)] != hashes if len(rest) else np.ones(len(hashes), bool)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                hashes = part.column(before).flatten().to_numpy() if by_hash else None
                kept = (lambda at, h=hashes: not_left_out(h[at])) if by_hash else None
                found = _collocations(part.column(place), sizes, top, kept)
                if own and not by_hash:
                    lengths = part.column(before).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                    found.insert(0, (np.repeat(np.arange(len(lengths)), lengths), part.column(before).flatten()))
                owner = np.concatenate([d for d, _ in found])
                values = pa.concat_arrays([x.cast(pa.string()) for _, x in found]).take(pa.array(np.argsort(owner, kind="stable")))
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=part.num_rows))])
                columns = [c for i, c in enumerate(part.columns) if i != before]
                columns[names.index("features")] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [f for f in docs.schema.fields if f.name != own]
    names = [f.name for f in fields]
    return bounded_batches(docs).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))


def best_collocations(docs: DataFrame, size: int = 2, top: int = 200) -> DataFrame:
    """Documents (doc_id, features) with the n-grams of two or three words that their own counts favour.

    Both are ranked by Pearson's chi-square: pairs over the four cells of their table, triples over the
    eight of theirs. Ties go in order of the words.
    """
    return _with_collocations(docs, (size,), top)


def feature_maker(docs: DataFrame, kind: str = "word", best_ratio: float = 0.8, top: int = 200) -> Callable[[DataFrame], DataFrame]:
    """What gives documents (doc_id, label, features) the features of a kind, chosen on all of ``docs``.

    ``word`` takes the words as they are, ``best_word`` the best share of the vocabulary, ``best_bigram``
    also the best pairs of words of each document, and ``best_trigram`` the best triples too. It takes
    documents of ``docs``; words that ``docs`` lacks have no score.
    """
    sizes = {"word": (), "best_word": (), "best_bigram": (2,), "best_trigram": (2, 3)}
    if kind not in sizes:
        raise ValueError(f"unknown features {kind}")
    if kind == "word":
        return lambda rows: rows
    scores, taken = _scores_taken(docs, best_ratio)
    left_out = _left_out(scores, taken)
    if left_out is not None:
        return lambda rows: _with_collocations(rows, sizes[kind], top, left_out=left_out)
    best = scores.where(taken)
    if not sizes[kind]:
        return lambda rows: only_best(rows, best)
    return lambda rows: _with_collocations(_own_best(rows, best), sizes[kind], top, "own")


def feature_sets(docs: DataFrame, kind: str = "word", best_ratio: float = 0.8, top: int = 200) -> DataFrame:
    """``docs`` with the features of a kind, as in :func:`feature_maker`."""
    return feature_maker(docs, kind, best_ratio, top)(docs)


def confusion(rows: DataFrame, positive: float = 1, negative: float = -1, compat: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates of rows (actual, predicted); the sign of a prediction is its class, zero is none.

    Rates with an empty divisor are null. With ``compat`` the names of false positives and false
    negatives, and with them precision and recall, are exchanged.
    """
    a, p = F.col("actual"), F.col("predicted")
    count = lambda x, y: F.count_if((a == x) & y)
    cells = rows.groupBy(*by).agg(
        count(positive, p > 0).alias("t_pos"), count(negative, p < 0).alias("t_neg"), count(negative, p > 0).alias("f_pos"), count(positive, p < 0).alias("f_neg"),
        F.corr(a.cast("double"), p.cast("double")).alias("pearson"),
    )
    if compat:
        cells = cells.withColumnsRenamed({"f_pos": "f_neg", "f_neg": "f_pos"})
    c = {k: F.col(k).cast("double") for k in ("t_pos", "t_neg", "f_pos", "f_neg")}
    return cells.select(
        *by, "t_pos", "t_neg", "f_pos", "f_neg", F.try_divide(c["t_pos"] + c["t_neg"], c["t_pos"] + c["t_neg"] + c["f_pos"] + c["f_neg"]).alias("accuracy"),
        F.try_divide(c["t_pos"], c["t_pos"] + c["f_pos"]).alias("pos_precision"), F.try_divide(c["t_pos"], c["t_pos"] + c["f_neg"]).alias("pos_recall"),
        F.try_divide(c["t_neg"], c["t_neg"] + c["f_neg"]).alias("neg_precision"), F.try_divide(c["t_neg"], c["t_neg"] + c["f_pos"]).alias("neg_recall"), "pearson",
    )


def spearman(rows: DataFrame) -> DataFrame:
    """Rank correlation of (actual, predicted). Ranks come from counts of distinct values, summed up by
    ranges of values and then within each, so no task sorts all of them."""

    def ranks(column: str, name: str) -> DataFrame:
        value = F.col(f"v_{name}")
        counts = rows.groupBy(F.col(column).cast("double").alias(f"v_{name}")).agg(F.count("*").alias("n"))
        bounds = sorted({*(counts.agg(F.percentile_approx(value, [k / 256 for k in range(1, 256)], 5000)).first()[0] or [])})
        bucket = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x <= value)) if bounds else F.lit(0)
        counts = counts.withColumn("bucket", bucket)
        before = counts.groupBy("bucket").agg(F.sum("n").alias("m"))  # 256 rows at most
        before = before.select("bucket", (F.sum("m").over(Window.orderBy("bucket")) - F.col("m")).alias("start"))
        within = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counts.withColumn("within", within).join(F.broadcast(before), "bucket")
        return placed.select(value, (F.col("start") + F.col("within") + (F.col("n") + 1) / 2.0).alias(name))

    joined = rows.join(ranks("actual", "a"), F.col("actual").cast("double") == F.col("v_a")).join(ranks("predicted", "p"), F.col("predicted").cast("double") == F.col("v_p"))
    return joined.agg(F.corr("a", "p").alias("spearman"))


def informative_features(model: DataFrame, sizes: DataFrame, cutoff: float = 1.2, compat: bool = False) -> DataFrame:
    """feature, present, ratio and polarity of the values of features whose smoothed probabilities differ
    beyond a ratio, by labels.

    A feature has two values, present and absent. Only labels that have documents with a value are
    compared for it, so what one label alone has, has the ratio 1. A positive value has its ratio, scaled to
    0..1; a negative one the inverse of its ratio, scaled to -1..0 with the most telling at -1. Where all are
    equal the scale is 0. With ``compat`` negative values are scaled by the extremes of the positive ones.
    """
    rows = model.crossJoin(sizes)  # one row of sizes
    both = (F.col("n_pos") == F.col("all_pos")) & (F.col("n_neg") == F.col("all_neg"))
    away = lambda k: F.col(f"all_{k}") - F.col(f"n_{k}")
    absent = lambda k: (away(k) + GAMMA) / (F.col(f"all_{k}") + F.when(both, 1).otherwise(2) * GAMMA)
    seen = lambda n, p: F.when(n > 0, p)
    values = F.array(*[
        F.struct(F.lit(here).alias("present"), *[seen(F.col(f"n_{k}") if here else away(k), F.exp(f"logp_{k}") if here else absent(k)).alias(k) for k in ("pos", "neg")])
        for here in (True, False)
    ])
    rows = rows.select("feature", F.inline(values)).where("pos is not null or neg is not null")
    high, low = F.greatest("pos", "neg") + EPSILON, F.least("pos", "neg") + EPSILON
    up = F.coalesce(F.col("pos") > F.col("neg"), F.col("pos").isNotNull())
    rows = rows.select("feature", "present", (high / low).alias("ratio"), up.alias("up")).where(F.col("ratio") > cutoff)
    rows = rows.withColumn("value", F.when(F.col("up"), F.col("ratio")).otherwise(1 / F.col("ratio")))
    ends = rows.agg(*[f(F.when(F.col("up") == up, F.col("value"))).alias(n) for f, up, n in ((F.min, True, "p0"), (F.max, True, "p1"), (F.min, False, "n0"), (F.max, False, "n1"))])
    scaled = lambda from_, lo, hi: F.coalesce(F.try_divide(F.col("value") - F.col(from_), F.col(hi) - F.col(lo)), F.lit(0.0))
    negative = scaled("p1", "p0", "p1") if compat else scaled("n1", "n0", "n1")
    return rows.crossJoin(ends).select("feature", "present", "ratio", F.when(F.col("up"), scaled("p0", "p0", "p1")).otherwise(negative).alias("polarity"))  # one row of ends


def evaluate(docs: DataFrame, ratio: float = 0.7, seed: int = 0, cutoff: float = 0.0, features: str = "word", best_ratio: float = 0.8) -> DataFrame:
    """Fit on the training share, with features of a kind, and measure on the rest."""
    # Each document's features are made once, for the side that it is on; all else reads labels and ids only.
    docs = docs if features == "word" else _once(docs)
    make, rows = feature_maker(docs, features, best_ratio), split_by_class(docs, ratio, seed)
    train, test = rows.where("train"), rows.where("not train")
    sizes = _sent(label_counts(train.select("label")))
    found = classify(make(test), conditionals(make(train), sizes=sizes), sizes, cutoff)
    return confusion(found.join(test.select("doc_id", F.col("label").alias("actual")), "doc_id").withColumnRenamed("polarity", "predicted"))


def bagging(docs: DataFrame, iterations: int = 20, ratio: float = 0.7, cutoff: float = 0.0, features: str = "word", best_ratio: float = 0.8) -> DataFrame:
    """Metrics of ``iterations`` random splits, a row each.

    A document carries a mask of the splits that it trains, so features are counted for all splits in one
    aggregation and scored for all in one join, as often as they are and not once for every split.
    """
    chosen = feature_sets(docs, features, best_ratio)
    out = None
    for start in range(1, iterations + 1, MASK_BITS):
        rows = _bagged(chosen, list(range(start, min(start + MASK_BITS, iterations + 1))), ratio, cutoff)
        out = rows if out is None else out.union(rows)
    return out


def with_masks(docs: DataFrame, splits: list[int], ratio: float) -> DataFrame:
    """``docs`` with ``mask``: bit k is set if the document trains the split ``splits[k]``, as in :func:`split_by_class`."""
    ids = docs.select("label", "doc_id").withColumn("iteration", F.explode(F.array(*map(F.lit, splits))))
    ends = _last_of_share(ids.withColumn("h", F.xxhash64("doc_id", "iteration")), ratio, ("iteration",))
    ends = ends.groupBy("label").agg(F.collect_list(F.struct("iteration", "end")).alias("ends"))  # an entry a split
    own = lambda e: F.struct(F.xxhash64("doc_id", e["iteration"]).alias("h"), F.col("doc_id")) <= e["end"]
    bit = lambda e: F.when(own(e), F.call_function("shiftleft", F.lit(1).cast("long"), e["iteration"] - splits[0])).otherwise(F.lit(0).cast("long"))
    mask = F.aggregate("ends", F.lit(0).cast("long"), lambda acc, e: acc + bit(e))
    return docs.join(F.broadcast(ends), "label", "left").withColumn("mask", F.coalesce(mask, F.lit(0).cast("long"))).drop("ends")


def _bagged(docs: DataFrame, splits: list[int], ratio: float, cutoff: float) -> DataFrame:
    rows, places = with_masks(docs, splits, ratio), range(len(splits))
    trains = lambda k: F.col("mask").bitwiseAND(F.lit(1 << k)) != 0
    counted = lambda names: [F.count_if(trains(k) & (F.col("label") > 0 if name == names[0] else F.col("label") < 0)).alias(f"{name}_{k}") for name in names for k in places]
    sizes = rows.agg(*counted(("all_pos", "all_neg"))).first().asDict()  # one row
    counts = rows.select("label", "mask", F.explode(F.array_distinct("features")).alias("feature")).groupBy("feature").agg(*counted(("n_pos", "n_neg")))

    def odds(k: int) -> Column:
        """What the feature adds to the log odds against the positive label; nothing where the split has not seen it."""
        pos, neg, all_pos, all_neg = F.col(f"n_pos_{k}"), F.col(f"n_neg_{k}"), sizes[f"all_pos_{k}"], sizes[f"all_neg_{k}"]
        bins = F.when((pos == all_pos) & (neg == all_neg), 1).otherwise(2)
        return F.when(pos + neg > 0, F.ln((neg + GAMMA) / (F.lit(all_neg) + bins * GAMMA)) - F.ln((pos + GAMMA) / (F.lit(all_pos) + bins * GAMMA))).otherwise(0.0)

    model = counts.select("feature", F.array(*map(odds, places)).alias("odds"))
    tested = rows.where(F.col("mask") != (1 << len(splits)) - 1).select(F.monotonically_increasing_id().alias("row"), "label", "mask", "features")
    tested = tested.select("row", "label", "mask", F.explode_outer(F.array_distinct("features")).alias("feature"))
    sums = tested.join(model, "feature", "left").groupBy("row", "label", "mask").agg(*[F.sum(F.get("odds", F.lit(k))).alias(f"odds_{k}") for k in places])

    def outcome(k: int) -> Column:
        prior = F.ln(F.lit((sizes[f"all_neg_{k}"] + GAMMA) / (sizes[f"all_pos_{k}"] + GAMMA)))
        pos = 1 / (1 + F.exp(F.coalesce(F.col(f"odds_{k}"), F.lit(0.0)) + prior))
        intensity = F.greatest(pos, 1 - pos) / (F.least(pos, 1 - pos) + EPSILON)
        predicted = F.when(intensity > cutoff, pos - (1 - pos)).otherwise(0.0)
        return F.struct(F.lit(splits[k]).alias("iteration"), F.col("label").alias("actual"), F.when(~trains(k), predicted).alias("predicted"))

    found = sums.select(F.inline(F.array(*map(outcome, places)))).where("predicted is not null")
    return confusion(found, by=("iteration",))


def bagging_summary(metrics: DataFrame) -> DataFrame:
    """True means of all metrics, and the best iteration: highest accuracy, the first on ties."""
    names = [c for c in metrics.columns if c != "iteration"]
    best = F.max_by("iteration", F.struct("accuracy", -F.col("iteration"))).alias("best_iteration")
    return metrics.agg(best, *[F.avg(c).alias(c) for c in names])


@dataclass(frozen=True)
class Model:
    """A fitted classifier as tables: ``prior`` (label, logp), ``cond`` as of :func:`conditionals`, ``sizes`` as
    of :func:`label_counts`, and the kind of features that its documents need."""

    prior: DataFrame
    cond: DataFrame
    sizes: DataFrame
    features: str = "word"

    def classify(self, docs: DataFrame, cutoff: float = 1.3) -> DataFrame:
        return classify(docs, self.cond, self.sizes, cutoff)

    def informative(self, cutoff: float = 1.2, compat: bool = False) -> DataFrame:
        return informative_features(self.cond, self.sizes, cutoff, compat)

    def save(self, path: str) -> None:
        """As one versioned table, so that a reader never gets parts of two models."""
        parts = [
            self.prior.select(F.lit("prior").alias("part"), F.struct("label", "logp").alias("prior"), F.lit(None).alias("cond"), F.lit(None).alias("sizes"), F.lit(None).alias("features")),
            self.cond.select(F.lit("cond").alias("part"), F.lit(None).alias("prior"), F.struct("feature", "logp_pos", "logp_neg", "n_pos", "n_neg").alias("cond"), F.lit(None).alias("sizes"), F.lit(None).alias("features")),
            self.sizes.select(F.lit("sizes").alias("part"), F.lit(None).alias("prior"), F.lit(None).alias("cond"), F.struct("all_pos", "all_neg").alias("sizes"), F.lit(self.features).alias("features")),
        ]
        versions.write(parts[0].unionByName(parts[1]).unionByName(parts[2]), path, "parquet")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        """The last saved state; it stays that one while it is used."""
        rows = versions.read(spark, path)
        part = lambda name: rows.where(F.col("part") == name).select(f"{name}.*")
        return cls(part("prior"), part("cond"), part("sizes"), rows.where("part = 'sizes'").select("features").first()[0])


def fit(docs: DataFrame, features: str = "word", best_ratio: float = 0.8) -> Model:
    """The model of all documents, with features of a kind."""
    rows, sizes = feature_sets(docs, features, best_ratio), label_counts(docs)  # features change no document's label
    return Model(priors(docs), conditionals(rows, sizes=sizes), sizes, features)
