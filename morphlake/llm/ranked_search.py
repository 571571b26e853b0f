"""Ranked lexical search over documents in the order of recursive graph bisection.

A bounded sample of documents is bisected again and again so that documents of common terms come to the
same half: each half's degrees of the terms give every document the gain of moving over, and the best
movers of both sides change places until none gains. What is kept of a bisection is what each term says
for either side, so every document of the table finds its leaf, and with it its place in the new order,
row by row. The documents of a leaf are cut into blocks, and the index has a row for each term of each
block with its postings, so all documents and all terms are indexed.

A search gives each block a bound: the sum over the query's terms of the largest share that a document
of the block gets for it. Blocks are visited in falling order of their bounds, ever more at a time, until
no block is left whose bound reaches the score of the last place; blocks that reach just that score are
visited, since ties go by doc_id. So the result is that of scoring all documents.

Null texts have no terms. Rows are told apart by their places in the index, so repeated ids are ranked
each on their own; null ids come last in ties. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, fresh_path, remove, remove_at_exit

#: Documents on which the bisection is fitted, about; its depth; kinds of terms that it tells apart; rounds of exchange.
SAMPLE, DEPTH, KINDS, ROUNDS = 4096, 6, 1 << 15, 12
#: Documents of a block, and the bytes of text from which it is closed before.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Blocks of the first visit; each visit takes four times as many as the one before.
FIRST_VISIT, WIDER = 4, 4
#: Query terms that are sent to all tasks; with more, the index is joined to them by a shuffle. Queries scored together.
SENT_TERMS, TOGETHER = 100_000, 2048

#: Bytes that part terms become blanks, and A-Z small letters; all of those beyond ASCII stay.
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in small letters, in UTF-8."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def kinds_of(terms: list[bytes]) -> np.ndarray:
    return np.fromiter({zlib.crc32(t) % KINDS for t in terms}, np.int32)


def _cost(n: int, degree: np.ndarray) -> np.ndarray:
    return degree * np.log2(n / (degree + 1.0))


def bisect(starts: np.ndarray, kinds: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Which half each document goes to; document k has the kinds from ``starts[k]`` to ``starts[k + 1]``."""
    n = len(starts) - 1
    doc = np.repeat(np.arange(n), np.diff(starts))
    right = np.arange(n) >= n // 2
    for _ in range(rounds):
        degree = [np.bincount(kinds[right[doc] == side], minlength=KINDS).astype(float) for side in (False, True)]
        size = [n // 2, n - n // 2]
        gains = []
        for a, b in ((0, 1), (1, 0)):
            now = _cost(size[a], degree[a]) + _cost(size[b], degree[b])
            moved = _cost(size[a], np.maximum(degree[a] - 1, 0)) + _cost(size[b], degree[b] + 1)
            gains.append(now - moved)
        gain = np.where(right, np.bincount(doc, gains[1][kinds], n), np.bincount(doc, gains[0][kinds], n))
        from_left, from_right = np.flatnonzero(~right), np.flatnonzero(right)
        from_left, from_right = from_left[np.argsort(-gain[from_left], kind="stable")], from_right[np.argsort(-gain[from_right], kind="stable")]
        k = min(len(from_left), len(from_right))
        better = int((gain[from_left[:k]] + gain[from_right[:k]] > 1e-9).sum())
        if not better:
            break
        right[from_left[:better]], right[from_right[:better]] = True, False
    return right


def leanings(documents: list[np.ndarray], depth: int = DEPTH) -> np.ndarray:
    """For each bisection, in the order of a heap, how much each kind of term speaks for the right half; the last
    column is the middle between both halves' sums, which a document has to exceed."""
    table = np.zeros((2**depth - 1, KINDS + 1), np.float32)

    def split(node: int, own: list[np.ndarray]) -> None:
        if node >= len(table) or len(own) < 4:
            return
        starts = np.r_[0, np.cumsum([len(x) for x in own])]
        kinds = np.concatenate(own) if starts[-1] else np.zeros(0, np.int32)
        right = bisect(starts, kinds)
        doc = np.repeat(np.arange(len(own)), np.diff(starts))
        n = (len(own) // 2, len(own) - len(own) // 2)
        left_d, right_d = (np.bincount(kinds[right[doc] == side], minlength=KINDS).astype(float) for side in (False, True))
        more_left, more_right = _cost(n[0], left_d + 1) - _cost(n[0], left_d), _cost(n[1], right_d + 1) - _cost(n[1], right_d)
        table[node, :KINDS] = more_left - more_right
        sums = np.bincount(doc, table[node, kinds].astype(float), len(own))
        table[node, KINDS] = (np.median(sums[right]) + np.median(sums[~right])) / 2
        goes = sums > table[node, KINDS]
        split(2 * node + 1, [x for x, g in zip(own, goes, strict=True) if not g])
        split(2 * node + 2, [x for x, g in zip(own, goes, strict=True) if g])

    split(0, documents)
    return table


def leaf_of(kinds: np.ndarray, table: np.ndarray) -> int:
    node = 0
    while node < len(table):
        node = 2 * node + (2 if table[node, kinds].sum(dtype=float) > table[node, KINDS] else 1)
    return node - len(table)


_FORWARD = "leaf int, piece int, doc_id bigint, terms bigint, words binary, counts binary"
_INDEX = "leaf int, block bigint, term string, at array<int>, tf array<int>, n array<bigint>, doc_id array<bigint>"


def _forward(docs: DataFrame, fitted) -> DataFrame:
    """Each document's leaf, the piece of it that it is dealt to, its number of terms, and its different terms with their counts."""

    def run(batches: Iterator[pa.RecordBatch]):
        table, pieces = fitted.value
        turn = TaskContext.get().partitionId()
        for batch in batches:
            leaves, sizes, words, counts = [], [], [], []
            for text in batch["text"].to_pylist():
                terms = terms_of(text)
                found = Counter(terms)
                leaves.append(leaf_of(kinds_of(list(found)), table) if found else 0)
                sizes.append(len(terms))
                words.append(b" ".join(found))
                counts.append(np.fromiter(found.values(), np.int32, len(found)).tobytes())
            dealt = [(turn + k) % pieces[leaf] for k, leaf in enumerate(leaves)]
            turn += len(leaves)
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), pa.array(dealt, pa.int32()), batch["doc_id"].cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(words, pa.binary()), pa.array(counts, pa.binary())], names=["leaf", "piece", "doc_id", "terms", "words", "counts"])

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(run, _FORWARD)


def _block(leaf: int, number: int, rows: list[tuple]) -> pa.RecordBatch:
    """Index rows of a block: one for its documents, without a term, and one for each of its terms."""
    vocabulary: dict[bytes, int] = {}
    ids = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words.split()), np.int32) for _, _, words, _ in rows]
    term = np.concatenate(ids)
    at = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in ids])
    tf = np.concatenate([np.frombuffer(c, np.int32) for _, _, _, c in rows])
    n = np.array([r[1] for r in rows], np.int64)
    order = np.argsort(term, kind="stable")
    ends = np.r_[0, np.cumsum(np.bincount(term, minlength=len(vocabulary)))]
    first = np.r_[0, ends + len(rows)].astype(np.int32)  # the documents' own row comes before the terms

    def lists(own: np.ndarray, of_terms: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(first), pa.array(np.concatenate([own, of_terms])))

    size = len(vocabulary) + 1
    docs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.full(size, len(rows))].astype(np.int32)), pa.array([r[0] for r in rows], pa.int64()))
    terms = pa.concat_arrays([pa.nulls(1, pa.string()), pa.array(list(vocabulary), pa.binary()).cast(pa.string())])
    zeros = np.zeros(len(rows), np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, leaf, np.int32)), pa.array(np.full(size, number, np.int64)), terms, lists(np.arange(len(rows), dtype=np.int32), at[order]), lists(zeros, tf[order]), lists(n, n[at[order]]), docs],
        names=["leaf", "block", "term", "at", "tf", "n", "doc_id"],
    )


def build_index(docs: DataFrame, path: str, depth: int = DEPTH) -> DataFrame:
    """Write the index of documents (doc_id, text) to a folder, and return it.

    Rows are leaf, block, term, and of each posting the place in the block (at), the occurrences (tf) and
    the document's number of terms (n). A row without a term has all documents of the block, with doc_id.
    """
    spark = docs.sparkSession
    total = docs.count()
    few = max(1, total // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(few)) == 0).select("text")
    bounded_batches(docs)

    def features(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.sort(kinds_of(terms_of(t))) for t in batch["text"].to_pylist()], pa.list_(pa.int32()))], names=["kinds"])

    fitted = [np.array(x, np.int32) for x in sample.mapInArrow(features, "kinds array<int>").toArrow()["kinds"].to_pylist()]
    table = leanings(fitted, depth)
    # A leaf with many documents is dealt out in pieces, by its share of the sample.
    share = np.bincount([leaf_of(x, table) if len(x) else 0 for x in fitted], minlength=2**depth) / max(1, len(fitted))
    pieces = np.maximum(1, np.ceil(share * total / (2 * BLOCK))).astype(int).tolist()
    dealt = _forward(docs, spark.sparkContext.broadcast((table, pieces))).repartition("leaf", "piece").sortWithinPartitions("leaf", "piece", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]):
        number, leaf, held, size = TaskContext.get().partitionId() << 32, None, [], 0
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("leaf", "doc_id", "terms", "words", "counts")]
            for own, *row in zip(*columns, strict=True):
                if held and (own != leaf or len(held) >= BLOCK or size >= BLOCK_BYTES):
                    yield _block(leaf, number, held)
                    number, held, size = number + 1, [], 0
                leaf = own
                held.append(tuple(row))
                size += len(row[2])
        if held:
            yield _block(leaf, number, held)

    dealt.mapInArrow(run, _INDEX).write.parquet(path)
    return spark.read.schema(_INDEX).parquet(path)


def query_terms(queries: DataFrame) -> DataFrame:
    """item_id, term and times of queries (item_id, text); rows of one item_id are one query."""
    kind = queries.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [(i, w.decode(), n) for i, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for w, n in Counter(terms_of(text)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], batch["item_id"].type), pa.array([r[1] for r in found], pa.string()), pa.array([r[2] for r in found], pa.int64())], names=["item_id", "term", "times"])

    rows = bounded_batches(queries.select("item_id", "text")).mapInArrow(run, f"item_id {kind}, term string, times bigint")
    return rows.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _score_blocks(wanted: DataFrame, hits: DataFrame, kind: str, together: int, top: int) -> DataFrame:
    """item_id, doc_id, at and score of the best documents of blocks for rows (block, part, item_id, term, value, least)."""

    def run(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        postings: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        docs = None
        for term, at, share, ids in zip(right["term"].to_pylist(), right["at"].to_pylist(), right["share"].to_pylist(), right["doc_id"].to_pylist(), strict=True):
            if term is None:
                docs = np.array([(1 << 63) - 1 if x is None else x for x in ids], np.int64)
            else:
                postings[term] = (np.array(at), np.array(share, np.int64))
        out: list[tuple] = []
        if docs is not None and len(left):
            left = left.sort_by([("item_id", "ascending")])
            items, terms, values, least = (left[c].to_pylist() for c in ("item_id", "term", "value", "least"))
            edges = [0, *(k for k in range(1, len(items)) if items[k] != items[k - 1]), len(items)]
            for a, b in zip(edges, edges[1:], strict=False):
                sums = np.zeros(len(docs), np.int64)
                for k in range(a, b):
                    if terms[k] in postings:
                        at, share = postings[terms[k]]
                        sums[at] += values[k] * share
                good = np.flatnonzero(sums >= max(1, least[a]))
                good = good[np.lexsort((good, docs[good], -sums[good]))[:top]]
                out += [(items[a], int(docs[g]), int(g), int(sums[g])) for g in good]
        ids = pa.array([None if r[1] == (1 << 63) - 1 else r[1] for r in out], pa.int64())
        return pa.table({"item_id": pa.array([r[0] for r in out], left["item_id"].type), "doc_id": ids, "at": pa.array([r[2] for r in out], pa.int32()), "score": pa.array([r[3] for r in out], pa.int64())})

    pieces = F.sequence(F.lit(0), F.lit(together - 1)) if together > 1 else F.array(F.lit(0))
    hits = hits.withColumn("part", F.explode(pieces)).select("block", "part", "term", "at", "share", "doc_id")
    grouped = wanted.select("block", "part", "item_id", "term", "value", "least").groupBy("block", "part").cogroup(hits.groupBy("block", "part"))
    return grouped.applyInArrow(run, f"item_id {kind}, doc_id bigint, at int, score bigint")


def _share(posting: Column, docs: int, terms: int) -> Column:
    """Share of a posting (tf, n) in whole numbers."""
    whole = lambda x: F.lit(x).cast("long")
    div = lambda x, y: F.call_function("div", x, y)
    tf = posting["tf"].cast("long")
    m = whole(75) + div(whole(25 * docs) * posting["n"], whole(terms))
    return div(whole(1_000_000_000) * tf, whole(1000) * tf + whole(12) * m)


def search(index: DataFrame, queries: DataFrame, top: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents of an index for each query (item_id, text).

    A term's weight w is floor(1000 ln((2N + 2) / (2df + 1))) and its share in a document
    (1000000000 tf) div (1000 tf + 12 m), with m = 75 + (25 n N) div L; the score sums w times share.
    """
    spark, scratch = index.sparkSession, Scratch()
    kind = queries.schema["item_id"].dataType.simpleString()
    facts = index.where("term is null").select(F.explode("n").alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    docs, terms = facts["docs"] or 0, facts["terms"] or 0
    asked = scratch.write(query_terms(queries), "query-terms")
    path = fresh_path(spark, "ranked")
    schema = f"item_id {kind}, rank int, doc_id bigint, score bigint"
    if not docs:
        scratch.clear()
        return spark.createDataFrame([], schema)
    words = asked.select("term").distinct()
    words = F.broadcast(words) if words.count() <= SENT_TERMS else words
    made = F.transform(F.arrays_zip("tf", "n"), lambda x: _share(x, docs, terms))
    own = F.array().cast("array<bigint>")
    hits = index.where("term is not null").join(words, "term", "left_semi").select("block", "term", "at", made.alias("share"), own.alias("doc_id"))
    heads = index.where("term is null").select("block", F.lit(None).cast("string").alias("term"), F.array().cast("array<int>").alias("at"), own.alias("share"), "doc_id")
    hits = scratch.write(hits, "hits")
    weights = hits.groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * docs + 2) / (2 * F.col("df") + 1))).cast("long")
    together = max(1, -(-asked.select("item_id").distinct().count() // TOGETHER))
    valued = scratch.write(asked.join(weights.select("term", weight.alias("w")), "term").select("item_id", "term", (F.col("times") * F.col("w")).alias("value")), "values")
    tops = hits.select("block", "term", F.array_max("share").alias("most"))
    bounds = tops.join(valued, "term").groupBy("item_id", "block").agg(F.sum(F.col("value") * F.col("most")).alias("bound")).where("bound > 0")
    place = Window.partitionBy("item_id").orderBy(F.desc("bound"), "block")
    bounds = scratch.write(bounds.withColumn("place", F.row_number().over(place)), "bounds")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "at")
    found, start, end = None, 0, FIRST_VISIT
    while True:
        open_ = bounds.where(F.col("place") > start).withColumn("least", F.lit(1).cast("long"))
        if found is not None:
            last = found.where(F.col("rank") == top).select(F.col("item_id").alias("item"), F.col("score").alias("last"))
            open_ = open_.join(last, F.col("item_id").eqNullSafe(F.col("item")), "left").drop("item").withColumn("least", F.coalesce("last", "least")).where(F.col("bound") >= F.col("least"))
            if open_.isEmpty():
                break
        visit = open_.where(F.col("place") <= end).select(F.col("item_id").alias("item"), "block", "least")
        wanted = visit.join(valued, F.col("item").eqNullSafe(F.col("item_id"))).withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(together)).cast("int"))
        new = _score_blocks(wanted, hits.unionByName(heads), kind, together, top).withColumn("block", F.lit(end).cast("long"))
        every = new if found is None else found.drop("rank").unionByName(new)
        found = scratch.write(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "found")
        start, end = end, end * WIDER
    found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score").write.parquet(path)
    remove_at_exit(spark, path)
    scratch.clear()
    return spark.read.schema(schema).parquet(path)


def search_documents(docs: DataFrame, queries: DataFrame, top: int = 20) -> DataFrame:
    """:func:`search` over an index of the documents that is made for it and deleted after it."""
    path = fresh_path(docs.sparkSession, "index")
    found = search(build_index(docs, path), queries, top)
    remove(docs.sparkSession, path)
    return found


def index_at(spark: SparkSession, path: str) -> DataFrame:
    """An index that :func:`build_index` has written."""
    return spark.read.schema(_INDEX).parquet(path)
