"""Quality probability of texts by a convolutional network over bytes, in numpy.

Bytes are embedded and convolved by learned filters eight bytes wide at every fourth byte. The
document is covered by overlapping chunks of CHUNK bytes; in each chunk every filter keeps its
largest response. The largest and the mean of these over the chunks pass through one hidden layer
to one probability, so any length of text is read in full and in bounded memory.

The network is fitted on the driver on a bounded sample of labelled rows: at most ``sample_rows``
whole texts a class, in the order of a hash of the id, as far as they fit into ``sample_bytes`` bytes
together. A text is left out only if it does not fit into what is left of that. Classes are weighted
back to their share among all training labels, so scores stay probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold

STRIDE, WIDTH, DEPTH, FILTERS, HIDDEN = 4, 8, 8, 32, 16
BLOCK = 64  # bytes; chunks are four blocks long and start every third block
CHUNK, STEP = 4 * BLOCK, 3 * BLOCK
PIECE_CHUNKS = 2048  # chunks of a long text that are held at once
TRAIN_CHUNKS = 128  # chunks of a batch whose responses at all positions are held at once in training, 24 KB each


@dataclass
class Network:
    embed: np.ndarray  # (256, DEPTH)
    filters: np.ndarray  # (WIDTH * DEPTH, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    hidden: np.ndarray  # (2 * FILTERS, HIDDEN)
    hidden_bias: np.ndarray
    out: np.ndarray  # (HIDDEN,)
    out_bias: np.ndarray  # (1,)

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        z = np.tanh(pooled @ self.hidden + self.hidden_bias) @ self.out + self.out_bias[0]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))


def _pieces(data: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """A text as zero-padded runs of bytes, each with its number of filter positions."""
    out, span = [], STEP * PIECE_CHUNKS
    for at in range(0, max(1, len(data)), span):
        rest = len(data) - at
        if at and rest <= CHUNK - STEP:
            break  # the piece before covers it
        positions = max(1, -(-min(rest, span + BLOCK) // STRIDE))
        piece = np.zeros(positions * STRIDE + WIDTH - STRIDE, np.uint8)
        part = data[at : at + len(piece)]
        piece[: len(part)] = part
        out.append((piece, positions))
    return out


def _chunks_of(positions: int) -> np.ndarray:
    """First blocks of the chunks of a piece with so many filter positions."""
    return np.arange(0, max(1, -(-positions * STRIDE // BLOCK) - 1), CHUNK // BLOCK - 1)


def _chunk_maxima(net: Network, pieces: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Filter maxima of all chunks, and how many chunks each piece has."""
    x = net.embed[np.concatenate([p for p, _ in pieces])].reshape(-1, STRIDE * DEPTH)
    half = STRIDE * DEPTH
    y = x[:-1] @ net.filters[:half] + x[1:] @ net.filters[half:]
    per = BLOCK // STRIDE
    block_at, first_block, at, blocks = [], [], 0, 0
    for _, positions in pieces:
        n = -(-positions // per)
        block_at.append(at + per * np.arange(n))
        first_block.append((blocks, n))
        blocks += n
        at += positions + 1  # the padding at the end is one position that no chunk uses
    ends = np.repeat([int(b[0]) + p for b, (_, p) in zip(block_at, pieces, strict=True)], [n for _, n in first_block])
    starts = np.concatenate(block_at)
    stops = np.minimum(starts + per, ends)
    bounds = np.stack([starts, stops], 1).ravel()
    if bounds[-1] >= len(y):
        y = np.concatenate([y, np.full((1, FILTERS), -np.inf, y.dtype)])
    top = np.maximum.reduceat(y, bounds, axis=0)[::2]
    chunk_at = [first + np.arange(0, max(1, n - 1), CHUNK // BLOCK - 1) for first, n in first_block]
    chunk = np.concatenate(chunk_at)
    last = np.repeat([first + n - 1 for first, n in first_block], [len(c) for c in chunk_at])
    best = top[chunk]
    for k in range(1, CHUNK // BLOCK):
        best = np.maximum(best, top[np.minimum(chunk + k, last)])
    return np.maximum(best + net.bias, 0), np.array([len(c) for c in chunk_at])


def pooled(net: Network, texts: list[np.ndarray], budget: int = 500_000) -> np.ndarray:
    """Largest and mean chunk response of each filter, for texts given as byte arrays."""
    top = np.zeros((len(texts), FILTERS), np.float32)
    total = np.zeros((len(texts), FILTERS), np.float64)
    count = np.zeros(len(texts))
    batch: list[tuple[np.ndarray, int]] = []
    owners: list[int] = []
    held = 0

    def flush():
        nonlocal held
        if not batch:
            return
        c, n = _chunk_maxima(net, batch)
        at = np.cumsum(n) - n
        most, summed = np.maximum.reduceat(c, at, axis=0), np.add.reduceat(c.astype(np.float64), at, axis=0)
        for k, owner in enumerate(owners):
            top[owner] = np.maximum(top[owner], most[k])
            total[owner] += summed[k]
            count[owner] += n[k]
        batch.clear()
        owners.clear()
        held = 0

    for i, data in enumerate(texts):
        for piece in _pieces(data):
            batch.append(piece)
            owners.append(i)
            held += len(piece[0])
            if held > budget:
                flush()
    flush()
    return np.concatenate([top, (total / np.maximum(count, 1)[:, None]).astype(np.float32)], 1)


def train(texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.004, seed: int = 7) -> Network:
    """Fit by Adam; only each filter's best position in a chunk has a gradient."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Network(
        rng.normal(0, 0.5, (256, DEPTH)).astype(f32), rng.normal(0, 0.15, (WIDTH * DEPTH, FILTERS)).astype(f32), np.zeros(FILTERS, f32),
        rng.normal(0, 0.15, (2 * FILTERS, HIDDEN)).astype(f32), np.zeros(HIDDEN, f32), rng.normal(0, 0.3, HIDDEN).astype(f32), np.zeros(1, f32),
    )
    # Every chunk as rows of CHUNK + WIDTH - STRIDE bytes; a short last chunk repeats its last position.
    positions, per = CHUNK // STRIDE, BLOCK // STRIDE
    chunks = [sum(len(_chunks_of(n)) for _, n in _pieces(data)) for data in texts]
    grid, k = np.empty((sum(chunks), positions, WIDTH), np.uint8), 0  # filled in place, as it is most of what the driver holds
    for data in texts:
        for piece, n in _pieces(data):
            at = _chunks_of(n) * per
            where = np.minimum(at[:, None] + np.arange(positions), n - 1) * STRIDE
            grid[k : k + len(at)] = piece[where[:, :, None] + np.arange(WIDTH)]
            k += len(at)
    first = np.concatenate([[0], np.cumsum(chunks, dtype=np.int64)])
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in net.arrays()]
    step, steps = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            docs = order[k : k + batch]
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            n = first[docs + 1] - first[docs]
            at = np.cumsum(n) - n
            g = grid[rows]
            best, c, xb = np.empty((len(rows), FILTERS), np.int64), np.empty((len(rows), FILTERS), f32), np.empty((len(rows), FILTERS, WIDTH * DEPTH), f32)
            for s in (slice(r, r + TRAIN_CHUNKS) for r in range(0, len(rows), TRAIN_CHUNKS)):
                x = net.embed[g[s]].reshape(-1, positions, WIDTH * DEPTH)
                y = x @ net.filters
                best[s] = y.argmax(1)
                c[s] = np.maximum(np.take_along_axis(y, best[s][:, None], 1)[:, 0] + net.bias, 0)
                xb[s] = x[np.arange(len(x))[:, None], best[s]]
            top, mean = np.maximum.reduceat(c, at, axis=0), np.add.reduceat(c, at, axis=0) / n[:, None]
            p = np.concatenate([top, mean], 1)
            h = np.tanh(p @ net.hidden + net.hidden_bias)
            z = h @ net.out + net.out_bias[0]
            dz = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels[docs]) * weights[docs] / len(docs)).astype(f32)
            dh = dz[:, None] * net.out * (1 - h * h)
            dp = dh @ net.hidden.T
            within = np.repeat(np.arange(len(docs)), n)
            ties = c == top[within]
            dc = dp[within, FILTERS:] / n[within, None] + dp[within, :FILTERS] * ties / np.maximum(np.add.reduceat(ties, at, axis=0, dtype=f32), 1)[within]
            dc = (dc * (c > 0)).astype(f32)
            d_filters = np.einsum("cfk,cf->kf", xb, dc)
            gb = g[np.arange(len(rows))[:, None], best]  # (chunks, FILTERS, WIDTH)
            d_embed = np.empty_like(net.embed)
            w = net.filters.T.reshape(FILTERS, WIDTH, DEPTH)
            flat = gb.ravel()
            for d in range(DEPTH):
                d_embed[:, d] = np.bincount(flat, (dc[:, :, None] * w[None, :, :, d]).ravel(), 256)
            grads = [d_embed, d_filters, dc.sum(0), p.T @ dh, dh.sum(0), h.T @ dz, dz.sum(keepdims=True)]
            step += 1
            now = rate * min(1, 3 * (1 - step / (steps + 1)))
            for a, (m, v), grad in zip(net.arrays(), moments, grads, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                a -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) + now * 1e-3 * a
    return net


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, sample_rows: int = 2000, sample_bytes: int = 8 << 20, seed: int = 7) -> Network | float:
    """A network from the labelled rows outside fold 0; a constant where these have one class only.

    The driver holds the sample, ``sample_bytes`` a class at most, and some three times that while
    it trains. Texts are measured before they are fetched.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    picked = [(r["doc_id"], r["quality"]) for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()]
    ids = spark.createDataFrame(picked, f"label_id {known.schema['doc_id'].dataType.simpleString()}, quality int")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("label_id"))
    sized = rows.groupBy("doc_id", "quality").agg(F.sum(F.octet_length("text")).alias("size"), F.min(F.xxhash64("doc_id")).alias("h"))  # a row a label, of which there are few
    left, fitting = {0: sample_bytes, 1: sample_bytes}, []
    for r in sorted(sized.collect(), key=lambda r: (r["h"], r["doc_id"])):
        if r["size"] <= left[r["quality"]]:
            left[r["quality"]] -= r["size"]
            fitting.append((r["doc_id"],))
    chosen = spark.createDataFrame(fitting, f"chosen_id {known.schema['doc_id'].dataType.simpleString()}")
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"), "left_semi")
    # Arrow keeps the texts in a few buffers, which go back to the system; as Python strings they would leave its heap at its largest.
    found = rows.select("doc_id", "text", "quality").toArrow()
    order = pc.sort_indices(found, [(c, "ascending") for c in found.column_names]).to_pylist()
    y = np.array(found["quality"].to_pylist(), np.float32)[order]
    if len({*y}) < 2:
        return (counts[1] + 1) / (sum(counts.values()) + 2)
    share = {q: counts[q] / sum(counts.values()) / np.mean(y == q) for q in (0, 1)}
    net = train([np.frombuffer(found["text"][k].as_buffer(), np.uint8) for k in order], y, np.array([share[q] for q in y], np.float32), seed=seed)
    del found
    pa.default_memory_pool().release_unused()
    return net


def _scores(model: Network | float, column) -> np.ndarray:
    texts = [np.frombuffer(x.as_buffer(), np.uint8) for x in column.fill_null("").cast(pa.large_binary())]
    if isinstance(model, float) or not texts:
        return np.full(len(texts), model if isinstance(model, float) else 0.0)
    return model.probability(pooled(model, texts))


def score(docs: DataFrame, model: Network | float, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    Null and empty texts are scored as one chunk of padding; repeated rows are each returned; an
    empty table gives no rows; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(_scores(model, batch.column(1)), pa.float64())], names=["doc_id", "held_out", "score"])

    rows = bounded_batches(docs).select("doc_id", docs["text"].cast("string").alias("text"), (fold("doc_id", folds) == 0).alias("held_out"))
    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """:func:`fit` on the labelled rows, then :func:`score` every document."""
    return score(docs, fit(docs, labels, **options))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all columns and in no new order."""
    model = fit(docs, labels, **options)

    def run(batches):
        for batch in batches:
            text = batch.column(0).field("text").cast(pa.large_string())
            yield batch.filter(pa.array(_scores(model, text) >= threshold))

    rows = bounded_batches(docs).select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, rows.schema).select("row.*")
