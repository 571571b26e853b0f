"""Texts linked by the Jaccard similarity of their word shingles, without loss.

Each text is the set of the hashes of its shingles; equal sets are one node. All sets are put in one
order. Two sets of similarity t or more share one of the first n - ceil(t * n) + 1 elements of each,
so texts meet in lists by these elements. The order puts frequent shingles last: those of a sample,
and after a first pass those whose lists would be long. Any order gives the same links.

Near copies are found before that by their SimHash fingerprints, the majority bits of the same hashes,
through the multi-index tables of :mod:`simhash`; what they find is compared as below, and the lists
compare only texts that are not joined yet. Fingerprints of texts at a lower similarity differ in more
bits than can be looked up, so the lists find the rest; no link depends on a fingerprint.

What meets is first compared by parity sketches: SPARSE bits and more for each element, the parity of
the elements that fall on each. Two sketches differ in at most as many bits as their sets in elements, so
a pair that differs in too many is not similar. What is left, nearly all of it similar, is compared
as whole sets, which are made again for these texts only.

All members of a list are first compared with one that has the fewest elements of its own before the
list's, as the middle of a group of copies has. Only lists whose members are not joined by
that, directly or through others, have pairs of different components compared with each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import Scratch, bounded_batches, release
from .components import connected_components

SEED = 42
#: Texts of the sample, and shingles put last at most (16 bytes each are sent to every executor).
ORDER_TEXTS, ORDER_SHINGLES = 4000, 1_000_000
#: Members of a list from which its element is put last in the second pass.
LONG = 8
SPARSE = 4
#: Texts to compare as whole sets (24 bytes each) up to which their keys are sent to every executor.
BROADCAST_KEYS = 100_000


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of ``size`` words; a shorter text is one run."""
    tokens = (text or "").encode().lower().split()  # lower case and white space of ASCII only
    if not tokens:
        return np.zeros(0, np.int64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    runs = zip(starts.tolist(), ends[min(size, len(tokens)) - 1 :].tolist(), strict=False)
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in runs], np.uint64).view(np.int64))


def _sets(size: int):
    """Sets of the texts of rows (id, text); a repeated id comes once a partition."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            new = {i: t for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if i not in seen}
            seen.update(new)
            found = [shingles(t, size) for t in new.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["id", "h"])

    return run


def prefix_size(n: int, similarity: float) -> int:
    """Elements of a set of ``n`` of which one at least is in every set that is similar."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def sketch(h: np.ndarray) -> np.ndarray:
    """Parity sketch of a set: a power of two of bits, SPARSE at least for each element, in 64-bit words."""
    bits = max(64, SPARSE << max(0, len(h) - 1).bit_length())
    odd = np.bincount((h & (bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def apart(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ, the longer one folded once; at most the number of elements in which their sets do."""
    half = lambda a, n: F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, n + 1, n), lambda u, v: u.bitwiseXOR(v))
    folded = lambda a, n: F.when(F.size(a) > n, half(a, n)).otherwise(a)
    least = F.least(F.size(x), F.size(y))
    differing = F.zip_with(folded(x, least), folded(y, least), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    return F.aggregate(differing, F.lit(0), lambda acc, v: acc + v)


PREFIX = "text_hash long, digest binary, n long, prefix array<long>"
WHOLE = f"{PREFIX}, sketch array<long>, fp long"


def _prefixes(late, size: int, similarity: float, whole: bool):
    """Digest and size of the set of each text, its first elements in the common order, and if ``whole`` its sketch and fingerprint."""

    def run(batches):
        keys, counts = late.value
        for batch in batches:
            digests, sizes, heads, sketches, prints = [], [], [], [], []
            for text in batch.column(2):
                h = shingles(text.as_py(), size)
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                rank = np.where(keys[at] == h, counts[at], 0) if len(keys) else np.zeros(len(h), np.int64)
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                heads.append(h[np.lexsort((h, rank))][: prefix_size(len(h), similarity)])
                if whole:
                    sketches.append(sketch(h))
                    prints.append(simhash.of_hashes(h))
            columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(heads, pa.list_(pa.int64()))]
            more = [pa.array(sketches, pa.list_(pa.int64())), pa.array(prints, pa.int64())] if whole else []
            yield pa.RecordBatch.from_arrays([*columns, *more], names=["doc_id", "text_hash", "digest", "n", "prefix", "sketch", "fp"][: 5 + len(more)])

    return run


def _can_reach(similarity: float, n: Column, at: Column, m: Column, to: Column) -> Column:
    """Whether sets of ``n`` and ``m`` whose first common element is there can be similar.

    What comes before the first common element is in one of the sets only. Pairs that fail this at
    another common element are met at their first one too.
    """
    least = F.lit(similarity / (1 + similarity)) * (n + m) - 1e-6
    most = F.lit((1 - similarity) / (1 + similarity)) * (n + m) + 1e-6
    return (F.least(n, m) >= F.lit(similarity) * F.greatest(n, m) - 1e-6) & (1 + F.least(n - at - 1, m - to - 1) >= least) & (at + to <= most)


def near_duplicates(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id and component_id of every row of ``docs``, as in :func:`components`."""
    return components(docs, shingle, similarity).select("doc_id", "component_id")


def components(docs: DataFrame, shingle: int, similarity: float, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, a hash of the text, root of its component, and component_id, the smallest id it links
    to, of every row of ``docs`` (doc_id, text).

    Null and blank texts have the empty set, which is similar to itself only. Repeated rows are each
    returned. A null doc_id is never a component's id unless all of its ids are null. ``scratch``
    gets the tables that are written on the way; the result is read from them.
    """
    if not 0 < similarity <= 1 or shingle < 1:
        raise ValueError("similarity must be above 0 and at most 1, shingle at least 1")
    spark, scratch = docs.sparkSession, scratch or Scratch()
    passing = Scratch()  # needed here only
    text = docs["text"].cast("string")
    rows = bounded_batches(docs).select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    share = min(1.0, ORDER_TEXTS / max(1, docs.count()))
    some = rows.where(F.pmod("text_hash", F.lit(1 << 20)) < int(share * (1 << 20))).select("text_hash", "text").mapInArrow(_sets(shingle), "id long, h array<long>")
    late = some.select(F.explode("h").alias("h")).groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(ORDER_SHINGLES).toArrow()
    kind = rows.schema["doc_id"].dataType.simpleString()

    def in_order(known: pa.Table, whole: bool) -> DataFrame:
        """Rows with the first elements of their sets, those of the table (h, count) after all others."""
        keys, counts = np.array(known["h"], np.int64), np.array(known["count"], np.int64)
        by_key = np.argsort(keys)
        sent = spark.sparkContext.broadcast((keys[by_key], counts[by_key]))
        return rows.mapInArrow(_prefixes(sent, shingle, similarity, whole), f"doc_id {kind}, {WHOLE if whole else PREFIX}")

    first = in_order(late, False).select("digest", "prefix").groupBy("digest").agg(F.first("prefix").alias("prefix"))
    crowded = first.select(F.explode("prefix").alias("h")).groupBy("h").count().where(F.col("count") > LONG).orderBy(F.desc("count"), "h").limit(ORDER_SHINGLES).toArrow()
    known = pa.concat_tables([late, crowded.cast(late.schema)]).group_by("h").aggregate([("count", "max")]).rename_columns(["h", "count"])
    release(spark)
    heads = passing.write(in_order(known, True), "jaccard-heads")
    of_row = F.struct(F.xxhash64("doc_id").alias("k"), F.col("text_hash").alias("t"))
    nodes = heads.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min(of_row).alias("one"), *[F.first(c).alias(c) for c in ("n", "prefix", "sketch", "fp")])
    nodes = passing.write(nodes.withColumn("id", F.monotonically_increasing_id()), "jaccard-nodes")
    release(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) that are similar: by their sketches, and what is left by their sets."""
        own = Scratch()
        side = lambda c, x: nodes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(x))
        close = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
        most = F.lit((1 - similarity) / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) + 1e-6
        close = own.write(close.where(apart(F.col("x"), F.col("y")) <= most).select("a", "b"), "jaccard-close")
        members = nodes.join(close.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi").select("id", "one.k", "one.t")
        members = own.write(members, "jaccard-members")
        sent = F.broadcast(members) if members.count() <= BROADCAST_KEYS else members.hint("shuffle_hash")
        same = (F.xxhash64("doc_id") == F.col("k")) & (F.col("text_hash") == F.col("t"))
        sets = own.write(rows.join(sent, same).select("id", "text").mapInArrow(_sets(shingle), "id long, h array<long>"), "jaccard-sets")
        both = close.join(sets.select(F.col("id").alias("a"), F.col("h").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("h").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        edges = passing.write(both.where(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b"), "jaccard-edges")
        own.clear()
        release(spark)
        return edges

    # Texts of one fingerprint meet the first of them; the first ones of fingerprints that link meet.
    prints = passing.write(nodes.groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("members")), "jaccard-prints")
    equal = nodes.select("fp", "id").join(prints.where("members > 1"), "fp").where("id <> first_id").select(F.col("first_id").alias("a"), F.col("id").alias("b"))
    of_print = lambda c: prints.select(F.col("fp").alias(c), F.col("first_id").alias(f"first_{c}"))
    linked = simhash.links(prints.select("fp")).distinct().join(of_print("a"), "a").join(of_print("b"), "b")
    linked = linked.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    near = verified(passing.write(equal.union(linked.distinct()), "jaccard-near"))
    joined = passing.write(connected_components(near), "jaccard-joined")
    release(spark)

    # One shuffle of (element, id, size and place) finds the elements that several sets have, and the middle set of each.
    place = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR((1 << 32) - 1 - F.col("n"))
    keys = nodes.select(F.posexplode("prefix").alias("at", "key"), "id", "n").select("key", "id", place.alias("place"))
    group = Window.partitionBy("key")
    lists = keys.withColumns({"members": F.count("*").over(group), "first": F.min(F.struct("place", "id")).over(group)}).where("members > 1")
    at, size = lambda c: F.shiftright(c, 32), lambda c: (1 << 32) - 1 - F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
    lists = passing.write(lists.select("key", "id", size("place").alias("n"), at("place").alias("at"), F.col("first.id").alias("first_id"), size("first.place").alias("first_n"), at("first.place").alias("first_at")), "jaccard-lists")
    release(spark)

    reach_first = _can_reach(similarity, F.col("n"), F.col("at"), F.col("first_n"), F.col("first_at"))
    root_of = lambda c: joined.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    pairs = lists.where((F.col("id") != F.col("first_id")) & reach_first).select(F.col("first_id").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    # What is joined already comes as stars, which few rounds leave alone.
    stars = lambda found: found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    met = connected_components(stars(joined).union(verified(pairs.select("a", "b"))))
    rooted = lists.join(met.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    mixed = passing.write(rooted.join(open_keys, "key", "left_semi").select("key", "id", "n", "at", "root"), "jaccard-open")
    other = mixed.select("key", *[F.col(c).alias(f"other_{c}") for c in ("id", "n", "at", "root")])
    differ = (F.col("id") < F.col("other_id")) & (F.col("root") != F.col("other_root"))
    pairs = mixed.join(other, "key").where(differ & _can_reach(similarity, F.col("n"), F.col("at"), F.col("other_n"), F.col("other_at")))
    edges = stars(met).union(verified(pairs.select(F.col("id").alias("a"), F.col("other_id").alias("b")).distinct()))
    roots = connected_components(edges).withColumnRenamed("node", "id")
    rooted = nodes.select("digest", "least", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = passing.write(rooted.join(ids, "root").select("digest", "root", "component_id"), "jaccard-ids")
    found = scratch.write(heads.select("doc_id", "text_hash", "digest").join(ids, "digest").drop("digest"), "jaccard-found")
    passing.clear()
    release(spark)
    return found
