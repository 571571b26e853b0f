"""SimHash fingerprints of three-word shingles, linked by multi-index hashing.

A fingerprint has two segments of 32 bits. Fingerprints that differ in two bits or fewer differ in
one bit or less in one of the segments. Every distinct fingerprint enters a table under both its
segments and looks up all values within one bit of them (a Hamming ball of 33); what it meets is
checked at full width. Exact copies and equal fingerprints are one entry, so they add no pairs.

Where more than HOT fingerprints share a segment, looking up would compare all of them with each
other. The fingerprints that meet such a table row are linked another exact way: each names the 65
points within one bit of itself, and those that name the same point, two bits apart at most, are
linked to the smallest of them. That is linear in their number, and gives the same components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import set_join
from .common import Scratch, bounded_batches, materialize, release
from .components import connected_components

SHINGLE, SEED, BITS, DISTANCE = 3, 42, 64, 2
#: Fingerprints in one table row above which the linear way is taken.
HOT = 64
#: Hot keys (16 bytes each) up to which they are sent to every executor.
BROADCAST_KEYS = 50_000
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Bit set where over half of the shingles' XXH64 have it; 0 for a text without words."""
    tokens = (text or "").encode().lower().split()  # lower case and white space of ASCII only
    if not tokens:
        return 0
    if len(tokens) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(tokens) - SHINGLE + 1
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        pairs = zip(starts[at : min(n, at + BLOCK)].tolist(), ends[at + SHINGLE - 1 : min(n, at + BLOCK) + SHINGLE - 1].tolist(), strict=True)
        ones += _ones(np.array([digest(joined[s:e], SEED) for s, e in pairs], "<u8"))
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint, as a signed integer, of shingles whose hashes are given; 0 if there are none."""
    ones = sum((_ones(h[at : at + BLOCK]) for at in range(0, len(h), BLOCK)), np.zeros(BITS, np.int64))
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def _fingerprints(batches):
    for batch in batches:
        values = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values, pa.int64())], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and fp, the fingerprint as a signed 64-bit integer, of every row; row by row."""
    rows = bounded_batches(docs).select("doc_id", docs["text"].cast("string").alias("text"), F.xxhash64(docs["text"].cast("string")).alias("text_hash"))
    return rows.mapInArrow(_fingerprints, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints ``fp`` of ``nodes`` that link."""
    low = F.lit((1 << 32) - 1)
    keys = F.array(F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32)))
    table = nodes.select(F.explode(keys).alias("key"), "fp")
    flips = F.array(F.lit(0), *[F.lit(1 << b) for b in range(32)])
    probes = table.select(F.explode(F.transform(flips, lambda m: m.bitwiseXOR(F.col("key")))).alias("key"), F.col("fp").alias("a"))
    hot = materialize(table.groupBy("key").count().where(F.col("count") > HOT).select("key"), "simhash-hot")
    n_hot = hot.count()
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    if not n_hot:
        return probes.join(table.withColumnRenamed("fp", "b"), "key").where(near & (F.col("a") < F.col("b"))).select("a", "b")
    sent = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
    cold = table.join(sent, "key", "left_anti").withColumnRenamed("fp", "b")
    pairs = probes.join(cold, "key").where(near & (F.col("a") < F.col("b"))).select("a", "b")
    crowded = probes.join(sent, "key", "left_semi").select("a").distinct()
    points = F.array(F.lit(0), *[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)])
    balls = crowded.select(F.explode(F.transform(points, lambda m: m.bitwiseXOR(F.col("a")))).alias("point"), "a")
    least = balls.groupBy("point").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").select("point", "b")
    stars = balls.join(least, "point").where(near & (F.col("a") != F.col("b"))).select("a", "b")
    return pairs.union(stars)


def components(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, text_hash, fp, root of its component, and component_id of every row of ``docs`` (doc_id, text).

    ``scratch`` gets the tables that are written on the way; the result is read from them.
    """
    scratch = scratch or Scratch()
    prints = scratch.write(fingerprints(docs), "simhash-prints")
    nodes = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = scratch.write(rooted.join(ids, "root").select("fp", "root", "component_id"), "simhash-found")
    return prints.join(found, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs`` (doc_id, text).

    Null and blank texts have fingerprint zero, which links like any other. Repeated rows are each
    returned. A null doc_id is never a component's id unless all of its ids are null. An empty
    table gives no rows; other columns are not read.
    """
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The row of ``docs`` with the smallest id of each component, with all columns.

    Rows of one id with texts of different components are each kept in their own; in one component
    the text with the smallest hash stays. Rows of equal id and text are one document: any of them
    stays. Rows without an id cannot be told apart and all stay; an empty table stays empty.

    With ``similarity``, texts link by that Jaccard similarity of their shingles or more: fingerprints
    of these shingles are looked up as above, what meets is compared exactly, and the links that no
    Hamming distance this small finds are joined exactly. Else they link by fingerprints of three-word shingles.
    """
    if similarity is None and shingle != SHINGLE:
        raise ValueError("fingerprints are of three-word shingles; give a similarity")
    scratch = Scratch()
    linked = components(docs, scratch) if similarity is None else set_join.components(docs, shingle, similarity, scratch)
    firsts = linked.where(F.col("doc_id") == F.col("component_id")).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    kept = firsts.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("first"))
    kept = materialize(kept.select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"), "first.n"), "simhash-kept")
    scratch.clear()
    release(docs.sparkSession)
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("row_id"), F.xxhash64(docs["text"].cast("string")).alias("row_hash"))
    same = (F.col("row_id") == F.col("kept_id")) & (F.col("row_hash") == F.col("kept_hash"))
    once = row.join(kept.where("n = 1").hint("shuffle_hash"), same, "left_semi")
    many = row.join(kept.where("n > 1").hint("shuffle_hash"), same, "left_semi").dropDuplicates(["row_id", "row_hash"])
    return once.union(many).union(row.where("row_id is null")).select("row.*")
