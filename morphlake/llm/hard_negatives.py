"""Hard negatives: rows of another label that score just below an anchor's positives.

The score of two rows is the inner product of their vectors, rounded down to whole numbers first. To
search by it, a vector x gets one more component, sqrt(M^2 - |x|^2) with M the longest length, and an
anchor q gets a zero: then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so a high score is a small distance. The
distances of all rows to a few pivots are stored once. By the triangle inequality they bracket the
distance of an anchor and a row, and so the score, from both sides; whole blocks of rows are bracketed
by the least and greatest distances inside them first. What the brackets leave is checked exactly.

Anchors go to all tasks in pieces of a bounded size, and each piece reads the stored table twice: for
the positives, then for the negatives between the bounds that these set. Before each, rows chosen by a
hash give a first lower bound; it only makes the brackets cut more and never decides a result.

Rows with a null label or vector, or with a null or non-finite component, take no part. Shorter vectors
count as filled up with zeros. Rows are told apart by a number, so repeated and null ids do no harm: a
repeated row is another row, and null ids come last in ties. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, fresh_path, remove_at_exit

#: Stored distances of each row; rows from which pivots are chosen; rows that give first bounds.
PIVOTS, PIVOT_ROWS, SEED_ROWS = 16, 1024, 8192
#: Bytes of the anchors that are sent to all tasks at once, as they are planned; a piece has half of it on average.
PIECE_BYTES = 32 << 20
#: Anchors whose scores with a batch are held at once; found pairs between two clean-ups.
TILE, PENDING = 512, 400_000
#: Below this, sums of products of doubles are exact.
EXACT = 2.0**53
OPEN = (1 << 62) - 1

_STORED = "row bigint, vec_id bigint, label bigint, anchor boolean, v array<bigint>, norm double, cell int, d array<double>"
_PAIRS = "anchor bigint, slot int, score bigint, vec_id bigint, row bigint"


def quantised(rows: DataFrame, anchor: Column, scale: int = 256) -> DataFrame:
    """row, vec_id, label, anchor, v and norm of the rows that take part; v is floor(scale * x) of each component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    part = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite)
    own = rows.where(F.coalesce(part, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("label").cast("long"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"),
    )
    return own.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of ``width``, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * width and set(column.value_lengths().to_pylist()) <= {width}:
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), flat.dtype)
    for k, x in enumerate(column.to_pylist()):
        out[k, : len(x)] = x
    return out


def choose_pivots(vectors: np.ndarray, longest: float, count: int = PIVOTS) -> np.ndarray:
    """Pivots among augmented vectors: the longest first, then always the one farthest from all before."""
    points = augmented(vectors, longest)
    chosen = [int(np.argmax(np.einsum("ij,ij->i", vectors, vectors)))]
    far = np.linalg.norm(points - points[chosen[0]], axis=1)
    while len(chosen) < min(count, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def augmented(vectors: np.ndarray, longest: float) -> np.ndarray:
    vectors = np.asarray(vectors, float)
    rest = np.sqrt(np.maximum(longest * longest - np.einsum("ij,ij->i", vectors, vectors), 0))
    return np.hstack([vectors, rest[:, None]])


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(points - p, axis=1) for p in pivots], axis=1)


def pivot_table(rows: DataFrame, width: int, longest: float, pivots: np.ndarray, total: int) -> DataFrame:
    """``rows`` with the distances to the pivots, in order of the nearest pivot and the distance to it, so
    that neighbours have like distances. Cells of any size are dealt over several keys."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            d = _distances(augmented(_matrix(batch["v"], width), longest), pivots)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * len(pivots)), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=1).astype(np.int32)), lists], names=[*batch.schema.names, "cell", "d"])

    keys = max(64, total // (len(pivots) * 4096))
    found = bounded_batches(rows).mapInArrow(run, _STORED)
    return found.repartition("cell", F.pmod(F.xxhash64("row"), F.lit(keys))).sortWithinPartitions("cell", F.array_min("d"), "row")


class Piece:
    """Anchors of one piece as arrays, and what is asked of each: ``low`` to ``high`` for every slot."""

    def __init__(self, table: pa.Table, width: int, longest: float, pivots: np.ndarray) -> None:
        self.row, self.vec_id, self.label = (table[c].to_pylist() for c in ("row", "vec_id", "label"))
        self.q = _matrix(table["v"], width)
        flat = np.asarray(self.q, float)
        square = np.einsum("ij,ij->i", flat, flat)
        self.base = square + longest * longest
        self.d = _distances(np.hstack([flat, np.zeros((len(flat), 1))]), pivots)
        self.margin = 1e-6 + 1e-9 * (math.sqrt(square.max(initial=0)) + longest)

    def ask(self, low: np.ndarray, high: np.ndarray, same: bool, most: int) -> tuple:
        return (np.array(self.row), np.array(self.label), self.q, self.base, self.d, self.margin, low, high, same, most)


def brackets(d_anchor: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of anchors (a, p) to points whose pivot distances lie in a range (n, p)."""
    low = np.zeros((len(d_anchor), len(least)))
    high = np.full(low.shape, np.inf)
    for p in range(d_anchor.shape[1]):
        own = d_anchor[:, p, None]
        np.maximum(low, np.maximum(own - greatest[:, p], least[:, p] - own), out=low)
        np.minimum(high, own + greatest[:, p], out=high)
    return low, high


def first_of(key: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores of each key, equal ones by id and row."""
    order = np.lexsort((row, ident, -score, key))
    k = key[order]
    start = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    rank = np.arange(len(k)) - np.maximum.accumulate(np.where(start, np.arange(len(k)), 0)) if len(k) else k
    return order[rank < most]


def _search(stored: DataFrame, asked, width: int, exact: bool) -> DataFrame:
    """anchor (its place in the piece), slot, score, vec_id and row of what each task finds."""

    def run(batches: Iterator[pa.RecordBatch]):
        a_row, a_label, q, base, d_anchor, margin, low, high, same, most = asked.value
        slots = low.shape[1]
        low, lowest, highest = low.copy(), low.min(axis=1, initial=OPEN), high.max(axis=1, initial=-OPEN)
        held = [np.zeros(0, np.int64) for _ in range(4)]
        pending, waiting = [], 0
        number = float if exact else np.int64

        def settle() -> None:
            nonlocal held, pending, waiting, lowest
            parts = [np.concatenate([h, *(x[k] for x in pending)]) for k, h in enumerate(held)]
            take = first_of(*parts, most)
            held, pending, waiting = [x[take] for x in parts], [], 0
            full = np.bincount(held[0], minlength=low.size) >= most  # the last one kept is the bound from now on
            last = np.full(low.size, OPEN)
            np.minimum.at(last, held[0], held[1])
            np.copyto(low, np.where(full.reshape(low.shape), np.maximum(low, last.reshape(low.shape)), low))
            lowest = low.min(axis=1, initial=OPEN)

        for batch in batches:
            x = _matrix(batch["v"], width).astype(number)
            d = _matrix(batch["d"], d_anchor.shape[1])
            ident = batch["vec_id"].fill_null(OPEN).to_numpy(zero_copy_only=False)
            row, label = batch["row"].to_numpy(), batch["label"].to_numpy()
            near = np.sqrt(np.maximum(base - 2.0 * highest, 0)) - margin
            far = np.sqrt(np.maximum(base - 2.0 * lowest, 0)) + margin
            asks = (lowest <= highest) & (base - 2.0 * lowest >= -margin)
            b_low, b_high = brackets(d_anchor, d.min(axis=0)[None], d.max(axis=0)[None])
            alive = np.flatnonzero(asks & (b_low[:, 0] <= far) & (b_high[:, 0] >= near))
            for k in range(0, len(alive), TILE):
                own = alive[k : k + TILE]
                r_low, r_high = brackets(d_anchor[own], d, d)
                open_ = (r_low <= far[own, None]) & (r_high >= near[own, None])
                open_ &= (a_label[own, None] == label) & (a_row[own, None] != row) if same else a_label[own, None] != label
                i, j = np.nonzero(open_)
                if not len(i):
                    continue
                if 8 * len(i) > open_.size:
                    score = (q[own].astype(number) @ x.T)[i, j]
                else:
                    score = np.concatenate([np.einsum("ij,ij->i", q[own[i[s : s + 65536]]].astype(number), x[j[s : s + 65536]]) for s in range(0, len(i), 65536)])
                score = score.astype(np.int64)
                for slot in range(slots):
                    hit = np.flatnonzero((score >= low[own[i], slot]) & (score <= high[own[i], slot]))
                    if len(hit):
                        pending.append((own[i[hit]] * slots + slot, score[hit], ident[j[hit]], row[j[hit]]))
                        waiting += len(hit)
            if waiting > PENDING:
                settle()
        settle()
        for k in range(0, len(held[0]), 65536):
            key, score, ident, row = (h[k : k + 65536] for h in held)
            yield pa.RecordBatch.from_arrays([pa.array(key // slots), pa.array((key % slots).astype(np.int32)), pa.array(score), pa.array(ident, mask=ident == OPEN), pa.array(row)], names=["anchor", "slot", "score", "vec_id", "row"])

    found = stored.mapInArrow(run, _PAIRS)
    most = asked.value[-1]
    place = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most)


def _bounds(first: pa.Table, shape: tuple[int, int], most: int, low: np.ndarray) -> np.ndarray:
    """``low`` raised to the last score of the slots that are full."""
    full = first.filter(pa.compute.equal(first["rank"], most))
    out = low.copy()
    at = (full["anchor"].to_numpy(), full["slot"].to_numpy())
    out[at] = np.maximum(out[at], full["score"].to_numpy())
    return out


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``rows`` has vec_id, embedding and an integer label, and ``anchor`` says which of them are anchors.
    An anchor's positives are its ``positives`` best other rows of its label. For each of them the
    ``negatives`` best rows of other labels are given whose score is ``low`` to ``high`` percent of the
    positive's; equal scores come in order of vec_id.
    """
    import pyarrow.compute  # noqa: F401

    spark, scratch = rows.sparkSession, Scratch()
    bounded_batches(rows)
    own = scratch.write(quantised(rows, anchor, scale), "vectors")
    facts = own.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("v")).alias("width"), F.max("norm").alias("norm"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not facts["n"] or not facts["anchors"]:
        scratch.clear()
        return spark.createDataFrame([], schema)
    width, longest = max(1, facts["width"]), math.sqrt(facts["norm"])
    exact = width * float(facts["most"] or 0) ** 2 < EXACT
    few = max(1, facts["n"] // PIVOT_ROWS)
    sample = own.where(F.pmod(F.xxhash64("row"), F.lit(few)) == 0).select("v").toArrow()
    sample = sample if len(sample) else own.select("v").limit(1).toArrow()
    pivots = choose_pivots(_matrix(sample["v"], width).astype(float), longest)
    stored = scratch.write(pivot_table(own, width, longest, pivots, facts["n"]), "pivots")
    share = max(1, facts["n"] // SEED_ROWS)
    seeds = scratch.write(stored.where(F.pmod(F.xxhash64("row"), F.lit(share)) == 0), "seeds") if share > 1 else None
    pieces = max(1, math.ceil(2 * facts["anchors"] * 8 * (width + len(pivots) + 4 * positives) / PIECE_BYTES)) if facts["anchors"] > 1 else 1
    path = fresh_path(spark, "negatives")
    for k in range(pieces):
        chunk = stored.where("anchor")
        chunk = chunk.where(F.pmod(F.xxhash64("row"), F.lit(pieces)) == k) if pieces > 1 else chunk
        piece = Piece(chunk.select("row", "vec_id", "label", "v").toArrow(), width, longest, pivots)
        n = len(piece.row)

        def ask(least: np.ndarray, greatest: np.ndarray, same: bool, most: int, piece: Piece = piece) -> DataFrame:
            if seeds is not None:
                sent = spark.sparkContext.broadcast(piece.ask(least, greatest, same, most))
                least = _bounds(_search(seeds, sent, width, exact).toArrow(), least.shape, most, least)
                sent.destroy()
            return _search(stored, spark.sparkContext.broadcast(piece.ask(least, greatest, same, most)), width, exact)

        best = ask(np.full((n, 1), -OPEN), np.full((n, 1), OPEN), True, positives).toArrow()
        least, greatest = np.full((n, positives), OPEN), np.full((n, positives), -OPEN)
        ids = np.full((n, positives), OPEN)
        at = (best["anchor"].to_numpy(), best["rank"].to_numpy() - 1)
        score = best["score"].to_numpy()
        least[at], greatest[at], ids[at] = -((-low * score) // 100), (high * score) // 100, best["vec_id"].fill_null(OPEN).to_numpy()
        scores = np.zeros((n, positives), np.int64)
        scores[at] = score
        found = ask(least, greatest, False, negatives)
        names = spark.createDataFrame(pa.table({
            "anchor": np.repeat(np.arange(n), positives), "slot": np.tile(np.arange(positives, dtype=np.int32), n), "anchor_id": pa.array([x for x in piece.vec_id for _ in range(positives)], pa.int64()),
            "positive_id": pa.array(ids.ravel(), mask=ids.ravel() == OPEN), "positive_score": scores.ravel(),
        }))
        out = found.join(names, ["anchor", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.mode("append").parquet(path)
    remove_at_exit(spark, path)
    scratch.clear()
    return spark.read.schema(schema).parquet(path)
