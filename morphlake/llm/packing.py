"""Packing of documents into padded batches with length buckets of least padding.

A batch is padded to the upper length of its bucket. Dynamic programming over the histogram of all
lengths chooses the upper lengths that minimise the padding in total. Within a bucket, batches take
as many documents as the token budget holds at the upper length.

The histogram has an entry for each length that occurs, so it is as long as the longest text at
most, and 16 bytes an entry reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Documents of a bucket that are numbered together, about.
CHUNK = 4096


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets that give the least padding in total.

    The padding of a bucket over entries i..j satisfies the quadrangle inequality, so the best last
    cut moves one way with j, and halving finds each layer in D log D steps. Of equally good cuts
    the leftmost is taken. An empty histogram has no bounds.
    """
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    n = np.concatenate([[0], np.cumsum([histogram[x] for x in lengths.tolist()])]).astype(np.float64)
    tokens = np.concatenate([[0], np.cumsum([histogram[x] * x for x in lengths.tolist()])]).astype(np.float64)
    d = len(lengths)
    best = np.full(d + 1, np.inf)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, d)):
        layer, cut = np.full(d + 1, np.inf), np.zeros(d + 1, np.int64)
        work = [(1, d, 0, d - 1)]
        while work:
            low, high, first, last = work.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            cost = best[i] + lengths[j - 1] * (n[j] - n[i]) - (tokens[j] - tokens[i])
            k = int(np.argmin(cost))
            layer[j], cut[j] = cost[k], i[k]
            work += [(low, j - 1, first, cut[j]), (j + 1, high, cut[j], last)]
        cuts.append(cut)
        best = layer
        best[0] = 0
    out, j = [], d
    for cut in reversed(cuts):
        if j:
            out.append(int(lengths[j - 1]))
            j = int(cut[j])
    return sorted(out)


def pack(docs: DataFrame, budget: int = 8192, buckets: int = 16) -> DataFrame:
    """doc_id, n_tokens, bucket_tokens, padding and batch_id of every row of ``docs`` (doc_id, text).

    Tokens are words. Null and blank texts have none and are padded like others. A document over the
    budget is a batch of its own; no document is split. Batches are formed within chunks of a bucket
    by a hash of the row, so buckets of any size are numbered in parallel; the last batch of a chunk
    may be short, all others are full. Repeated rows are packed each; an empty table gives no rows;
    other columns are not read. Texts are counted once and their lengths written out.
    """
    rows = materialize(docs.select("doc_id", n_words(F.col("text")).alias("n_tokens")), "packing-lengths")
    found = rows.groupBy("n_tokens").count().toArrow()
    histogram = dict(zip(found["n_tokens"].to_pylist(), found["count"].to_pylist(), strict=True))
    upper = boundaries(histogram, buckets)
    bucket, chunks, fit = F.lit(None).cast("long"), F.lit(1), F.lit(1)
    for low, high in reversed(list(zip([-1, *upper], upper, strict=False))):
        total = sum(c for x, c in histogram.items() if low < x <= high)
        docs_each = max(1, budget // max(1, high))
        inside = F.col("n_tokens") <= high
        bucket = F.when(inside, F.lit(high).cast("long")).otherwise(bucket)
        fit = F.when(inside, F.lit(docs_each)).otherwise(fit)
        chunks = F.when(inside, F.lit(max(1, total // (docs_each * -(-CHUNK // docs_each))))).otherwise(chunks)
    placed = rows.select("doc_id", "n_tokens", bucket.alias("bucket_tokens"), fit.alias("fit"), F.pmod(F.xxhash64("doc_id", "n_tokens"), chunks.cast("long")).alias("chunk"))
    order = Window.partitionBy("bucket_tokens", "chunk").orderBy("doc_id", "n_tokens")
    number = F.floor((F.row_number().over(order) - 1) / F.col("fit"))
    return placed.select("doc_id", "n_tokens", "bucket_tokens", (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"), F.concat_ws("-", "bucket_tokens", "chunk", number).alias("batch_id"))
