"""Removal of repeated byte strings through merged Burrows-Wheeler transforms.

A byte goes if it lies in a string of WINDOW bytes that also starts earlier, in a document with a
smaller id or before it in the same one. What goes is decided by the merged transforms alone; hashes
deal out the work so that equal strings always meet, and name strings that are byte for byte the same:

1. Winnowing. Among the k-grams of a window the one with the smallest hash is its anchor, chosen by
   the window's bytes alone, so equal windows have equal anchors. Windows in a row with one anchor
   are one context: the bytes they cover. Contexts whose anchor occurs once in the corpus are dropped.
2. Contexts of one anchor hash and one digest of their bytes are one string with a multiplicity; its
   bytes are taken from the first of them. A string that is alone and occurs once is dropped.
3. Strings whose anchor has no other string are dealt out whole, those that follow each other in one
   document as one. The others are cut into slices of up
   to SLICE windows whose anchors lie alike, and dealt out by the bytes that all windows of a slice
   have in common, so chance repeats of a k-gram are alone and go. Where more than CROWD strings have
   an anchor (the edges of a passage that very many documents hold), each of their windows is made a
   string of its own first, so no group of strings needs to fit into one task.
4. In each task the strings form shards; each shard's Burrows-Wheeler transform is built by itself, and
   the transforms are merged by refining their interleave: the order by h - 1 bytes and the
   transforms' letters give the order by h bytes. Only what can still be repeated is refined on: a
   suffix alone in its interval is settled, as repeated if its string has a multiplicity, else as
   not. What stays together for WINDOW rounds is a repeated string. Suffixes are sorted within their
   shard only, never again.
5. Of each interval all places but the first are cut. Strings with a multiplicity that were found
   repeated as a whole are joined to their other places, and these are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, materialize, release

WINDOW, GRAM = 100, 24
SPAN = WINDOW - GRAM + 1  # k-grams in a window
PIECE = 1 << 22  # windows of a long text that are held at once
TOGETHER = 1 << 16  # bytes of short texts that are hashed side by side
SLICE = 20  # windows
#: Strings of one anchor above which its windows become strings of their own; more in very large
#: corpora, so that there are at most CROWDS such anchors, which every task is told (8 MB).
CROWD, CROWDS = 4096, 1_000_000
SHARD_BYTES, TASK_BYTES = 1 << 18, 1 << 22
RUN = 4096  # windows of strings in a row that are dealt out as one

_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = {n: np.uint64(pow(0x5851F42D4C957F2D, n, 2**64)) for n in (1, 2, 4, 8, 16)}


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    level = {1: _TABLE[data]}
    for n in (1, 2, 4, 8):
        x = level[n]
        level[2 * n] = x[:-n] * _POWERS[n]
        level[2 * n] += x[n:]
    x = level[16][: len(data) - GRAM + 1] * _POWERS[8]
    x += level[8][16:][: len(data) - GRAM + 1]
    x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x


def _least(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the k-grams of some bytes, and where the anchor of each window lies."""
    h = _gram_hashes(part)
    low = np.uint64(0xFFFFFF)
    least = h & ~low
    least |= np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = SPAN - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    least &= low
    return h, least.view(np.int64)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window, and number of windows of each context of a text, with the place of
    the anchor in the first window in the bits from the 16th on."""
    n = len(data) - WINDOW + 1
    out = []
    for at in range(0, max(0, n), PIECE):
        h, where = _least(data[at : min(len(data), at + PIECE + WINDOW - 1)])
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        out.append((h[where[first]].view(np.int64), first + at, np.diff(np.append(first, len(where))) + (where[first] - first << 16)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def anchors_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`anchors` for all texts one after another, and which text each context is of.

    Short texts are hashed side by side, TOGETHER bytes at once; windows across two of them are left out.
    """
    out, at = [tuple(np.zeros(0, np.int64) for _ in range(4))], 0
    while at < len(texts):
        to, held = at + 1, len(texts[at])
        while to < len(texts) and held + len(texts[to]) <= TOGETHER:
            held += len(texts[to])
            to += 1
        if to == at + 1:
            found = anchors(texts[at])
            out.append((*found, np.full(len(found[0]), at, np.int64)))
        elif held >= WINDOW:
            sizes = np.fromiter(map(len, texts[at:to]), np.int64, to - at)
            begins = np.cumsum(sizes) - sizes
            h, where = _least(np.concatenate(texts[at:to]))
            own = np.repeat(np.arange(to - at), np.maximum(sizes - WINDOW + 1, 0))  # the text of each window
            window = np.arange(len(own)) + (begins - (np.cumsum(np.maximum(sizes - WINDOW + 1, 0)) - np.maximum(sizes - WINDOW + 1, 0)))[own]
            where = where[window]
            first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])[: len(where)])
            of = own[first]
            out.append((h[where[first]].view(np.int64), window[first] - begins[of], np.diff(np.append(first, len(where))) + (where[first] - window[first] << 16), of + at))
        at = to
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _texts(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint8) for x in column.fill_null("").cast(pa.large_binary())]


def _anchor_counts(batches):
    for batch in batches:
        h, n = np.unique(anchors_of(_texts(batch.column(0)))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], names=["h", "n"])


CONTEXT = "h long, c long, doc long, tie long, at long, windows long"


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    names = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[kind]) for x, (_, kind) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def _contexts(batches):
    """A row for each context: anchor, digest of its bytes, document, first window, number of windows."""
    for batch in batches:
        texts, digest = _texts(batch.column(2)), xxhash.xxh3_64_intdigest
        h, at, n, of = anchors_of(texts)
        raw, stops = [memoryview(t) for t in texts], at + (n & 0xFFFF) + (WINDOW - 1)
        c = np.array([digest(raw[k][s:e]) for k, s, e in zip(of.tolist(), at.tolist(), stops.tolist(), strict=True)], np.uint64).view(np.int64)
        doc, tie = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        yield _batch([h, c, doc[of], tie[of], at, n], CONTEXT)


def _single_windows(crowded):
    """As :func:`_contexts`, with each window in a context of a crowded anchor as a context of its own."""

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        known = np.sort(np.array(crowded.value, np.int64))
        for batch in batches:
            texts = _texts(batch.column(2))
            h, at, n, of = anchors_of(texts)
            mine = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            n = n[mine] & 0xFFFF
            of, starts = np.repeat(of[mine], n), np.repeat(at[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            raw = [memoryview(t) for t in texts]
            windows = [raw[k][s : s + WINDOW] for k, s in zip(of.tolist(), starts.tolist(), strict=True)]
            both = [np.array([digest(w, seed) for w in windows], np.uint64).view(np.int64) for seed in (1, 2)]
            doc, tie = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            yield _batch([*both, doc[of], tie[of], starts, np.ones(len(starts), np.int64)], CONTEXT)

    return run


def _lists(column: pa.Array, fields: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The structs of each list of a column as tuples; none for a null."""
    flat = column.flatten()
    rows = list(zip(*(flat.field(f).to_numpy(zero_copy_only=False).tolist() for f in fields), strict=True))
    at = 0
    for n in column.value_lengths().fill_null(0).to_pylist():
        yield rows[at : at + n]
        at += n


STRINGS = "key long, doc long, tie long, at long, context long, windows array<int>, several boolean, data binary"


def _strings(batches):
    """Strings of the contexts asked for, from the documents joined with their lists: runs of contexts that
    are alone with their anchors, with the numbers of their windows, and slices of the others.
    ``context`` is where the context, or the first of a run, begins."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        out: list[tuple] = []

        def close(doc, tie, raw, run):
            if run:
                at = run[0][0]
                data = raw[at : run[-1][0] + run[-1][1] + WINDOW - 1]
                out.append((digest(data) >> 1, doc, tie, at, at, [n for _, n in run], True, data))
                run.clear()

        for doc, tie, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2)), _lists(batch.column(3), ("at", "windows", "several", "alone")), strict=True):
            raw, run = text.tobytes(), []
            for at, windows, several, alone in sorted(wanted):
                far, n = windows >> 16, windows & 0xFFFF  # the anchor lies far - n + 1 to far bytes into the windows
                if alone:  # and so several
                    if run and (run[-1][0] + run[-1][1] != at or at + n - run[0][0] > RUN):
                        close(doc, tie, raw, run)
                    run.append((at, n))
                    continue
                p = at + far
                for low in range((far - n + 1) // SLICE * SLICE, far + 1, SLICE):
                    first, last = p - min(far, low + SLICE - 1), p - max(far - n + 1, low)
                    out.append((digest(raw[p - low : p - low - SLICE + 1 + WINDOW], low) >> 1, doc, tie, first, at, None, several, raw[first : last + WINDOW]))
            close(doc, tie, raw, run)
        yield _batch(list(zip(*out, strict=True)) if out else [[]] * 8, STRINGS)


def shard_transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform and suffix array of some strings, each with an end of its own.

    Letters are bytes plus one; 0 is an end. Ends sort before letters and among each other in the
    order of the strings. Suffixes are positions in the strings with their ends, one after another.
    Suffixes are sorted by as many of their first letters as a sort key holds and then by doubling
    prefixes, as far as they are not told apart yet.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, np.int64)
    inner = np.ones(len(text), bool)
    inner[ends] = False
    text[inner] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    left = ends[owner] - np.arange(len(text))  # letters before the end
    used = np.zeros(257, bool)
    used[text] = True
    used[0] = True
    bits, places = int(np.count_nonzero(used) - 1).bit_length(), len(text).bit_length()
    width = max(1, (63 - places) // max(1, bits))  # letters in a sort key, before the place
    dense = (np.cumsum(used) - 1)[text]  # letters in their order, without those that do not occur
    packed = np.zeros(len(text), np.int64)
    for k in range(width):
        packed <<= bits
        n = max(0, len(text) - k)
        packed[:n] |= np.where(left[:n] >= k, dense[k:], 0)
    packed <<= places
    packed |= np.arange(len(text))  # suffixes that end have their order from the strings
    packed.sort()
    order = packed & ((1 << places) - 1)
    packed >>= places
    fresh = np.ones(len(text), bool)
    fresh[1:] = (packed[1:] != packed[:-1]) | (left[order[1:]] < width)
    rank = np.empty(len(text), np.int64)  # place of the first suffix not told apart
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(text)), 0))
    while True:
        open_at = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not len(open_at):
            break
        suffix = order[open_at]
        key = rank[suffix] * len(text) + rank[suffix + width]
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[open_at] = suffix
        new = np.concatenate([[True], key[1:] != key[:-1]])
        fresh[open_at[new]] = True
        rank[suffix] = np.maximum.accumulate(np.where(new, open_at, 0))
        width *= 2
    before = text[np.maximum(order - 1, 0)].astype(np.uint16)
    before[left[order] == sizes[owner[order]]] = 0
    return before, order


def merge_transforms(transforms: list[np.ndarray], weights: np.ndarray, depth: int, rows: np.ndarray | None = None, settle: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Refine the interleave of shard transforms by ``depth`` letters, as far as something is repeated.

    ``weights`` has the multiplicity of the string of each row, all shards' rows one after another;
    ``rows`` those whose suffixes are made longer, letter by letter towards the front, all if not given.
    Returns the rows whose suffix then shares ``depth`` letters with another or has them more than
    once, the interval of each, how many letters are still to come, and for every row the number of
    letters, ``depth`` at most, that its suffix was seen to share. With ``settle``, a suffix alone in
    its interval whose string has a multiplicity is returned at once, with letters to come.
    """
    letters = np.concatenate(transforms)
    if letters.max(initial=0) < 256:
        letters = letters.astype(np.uint8)  # sorts in one pass
    follows = np.empty(len(letters), np.int32)  # row of the suffix that is one letter longer
    at = 0
    for t in transforms:
        follows[at + np.argsort(letters[at : at + len(t)], kind="stable")] = np.arange(at, at + len(t))
        at += len(t)
    shared = np.zeros(len(letters), np.int16)
    rows = np.arange(len(letters), dtype=np.int32) if rows is None else rows
    interval, known, settled = np.zeros(len(rows), np.int32), 0, []
    for h in range(1, depth + 1):
        c = letters[rows]
        by = np.argsort(c, kind="stable")[np.count_nonzero(c == 0) :]  # no letter precedes a whole string
        rows, c, interval = follows[rows[by]], c[by], interval[by]
        if not len(rows):
            break
        fresh = np.concatenate([[True], (c[1:] != c[:-1]) | (interval[1:] != interval[:-1])])
        starts = np.flatnonzero(fresh)
        n = np.diff(np.append(starts, len(rows)))
        single = np.flatnonzero(n == 1)
        several = weights[rows[starts[single]]] > 1
        stays = n > 1
        if settle:
            single = starts[single[several]]
            settled.append((rows[single], np.arange(known, known - len(single), -1) - 1, np.full(len(single), depth - h)))
            known -= len(single)
        else:
            stays[single[several]] = True
        repeated = np.repeat(stays, n)
        rows, interval = rows[repeated], np.cumsum(fresh, dtype=np.int32)[repeated]
        shared[rows] = h
    settled.append((rows, interval, np.zeros(len(rows), np.int64)))
    return (*(np.concatenate(x) for x in zip(*settled, strict=True)), shared)


def repeated_places(strings: list[bytes], weights: list[int], depth: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, offset and interval of each suffix that has ``depth`` letters more than once, counting multiplicities."""
    shards, held = [[]], 0
    for data in strings:
        if held > shard_bytes:
            shards.append([])
            held = 0
        shards[-1].append(data)
        held += len(data) + 1
    both = [shard_transform(x) for x in shards]
    offsets = np.cumsum([0] + [len(b) for b, _ in both])
    suffix = np.concatenate([order + at for (_, order), at in zip(both, offsets, strict=False)])
    sizes = np.array([len(s) + 1 for s in strings])
    begins = np.cumsum(sizes) - sizes
    of_suffix = np.repeat(np.arange(len(strings), dtype=np.int32), sizes)
    of_row = of_suffix[suffix]
    # Suffixes with less than ``depth`` letters before them never get so many.
    rows = np.flatnonzero(suffix - begins[of_row] >= depth).astype(np.int32)
    rows, interval, ahead, _ = merge_transforms([b for b, _ in both], np.array(weights, np.int64)[of_row], depth, rows, True)
    return of_row[rows], suffix[rows] - ahead - begins[of_row[rows]], interval


FOUND = "doc long, tie long, start long, stop long, context long"


def _repeats(strings: dict[bytes, list[tuple]]) -> Iterator[pa.RecordBatch]:
    """Batches FOUND of strings, each with its places (doc, tie, at, context, windows, several).

    A row without a context is an interval to cut. One with a context says how many windows of it
    (``stop``), a string that has other places too, were found repeated.
    """
    places = [v if len(v) == 1 else list({x[:3]: x for x in v}.values()) for v in strings.values()]  # repeated rows have equal places
    weights = [2 if len(p) > 1 or p[0][5] else 1 for p in places]
    string, offset, interval = repeated_places(list(strings), weights)
    if not len(string):
        return
    flat = [x for p in places for x in p]
    doc, tie, at = (np.array([x[k] for x in flat]) for k in range(3))
    sizes = np.array([len(p) for p in places])
    begins = np.cumsum(sizes) - sizes
    n = sizes[string]
    place, offset = np.repeat(begins[string] - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(offset, n)
    start, interval = at[place] + offset, np.repeat(interval, n)
    # Contexts with a multiplicity, each from its offset in its place on.
    parts = []
    for k, x in enumerate(flat):
        if x[5]:
            parts.append((k, 0, x[3]))
            if x[4]:
                parts += [(k, n, x[3] + n) for n in accumulate(x[4][:-1])]
    if parts:
        of, first, context = (np.array(x) for x in zip(*parts, strict=True))
        mine = np.array([x[5] for x in flat])[place]
        which = np.searchsorted(of << 20 | first, place[mine] << 20 | offset[mine], side="right") - 1
        found = np.bincount(which, minlength=len(of))
        hit = np.flatnonzero(found)
        yield _batch([doc[of[hit]], tie[of[hit]], np.zeros(len(hit), np.int64), found[hit], context[hit]], FOUND)
    order = np.lexsort((start, tie[place], doc[place], interval))
    later = np.concatenate([[False], interval[order][1:] == interval[order][:-1]])
    place, start = place[order][later], start[order][later]
    order = np.lexsort((start, tie[place], doc[place]))
    doc, tie, start = doc[place][order], tie[place][order], start[order]
    if len(doc):
        cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] > start[:-1] + 1)]))
        last = np.append(cut[1:], len(doc)) - 1
        yield _batch([doc[cut], tie[cut], start[cut], start[last] + WINDOW, [None] * len(cut)], FOUND)


def _merge_task(batches):
    """STRINGS sorted by key in, FOUND out; keys are taken together up to TASK_BYTES.

    A key whose only string has one place and no others is dropped.
    """
    ready: dict[bytes, list[tuple]] = {}
    group: dict[bytes, list[tuple]] = {}
    out = [_batch([[]] * 5, FOUND)]
    held, last = 0, None

    def close():
        nonlocal held
        if len(group) > 1 or any(v[0][5] or len(v) > 1 for v in group.values()):
            for data, places in group.items():
                if data in ready:
                    ready[data] += places
                else:
                    ready[data] = places
                    held += len(data) + 1
        group.clear()

    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False).tolist() for k in (0, 1, 2, 3, 4, 6)]
        lists = batch.column(5).to_pylist() if batch.column(5).null_count < batch.num_rows else [None] * batch.num_rows
        for key, doc, tie, at, context, several, windows, data in zip(*columns, lists, batch.column(7).to_pylist(), strict=True):
            if key != last:
                close()
                last = key
                if held > TASK_BYTES:
                    out += _repeats(ready)
                    ready, held = {}, 0
                    if sum(map(len, out)) > 50_000:
                        yield pa.concat_batches(out)
                        out = out[:1]
            group.setdefault(data, []).append((doc, tie, at, context, windows, several))
    close()
    if ready:
        out += _repeats(ready)
    yield pa.concat_batches(out)


def tie_of(docs: DataFrame, key: str) -> Column:
    """What tells texts of one ``key`` apart: a hash of the text, or zero if no key has several texts."""
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    hashes = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(text).alias("low"), F.max(text).alias("high"))
    return F.lit(0).cast("long") if hashes.where("low <> high").isEmpty() else text


def repeated_intervals(named: DataFrame) -> DataFrame:
    """doc, tie, start and stop of byte intervals of (doc, tie, text) that cover exactly the bytes to remove; they may overlap."""
    spark = named.sparkSession
    named = bounded_batches(named).where("doc is not null").where(F.octet_length("text") >= WINDOW)
    own = Scratch()
    known = own.write(named.select("text").mapInArrow(_anchor_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("all")).where("all > 1"), "suffix-anchors")
    shared = own.write(named.select("doc", "tie", "text").mapInArrow(_contexts, CONTEXT).join(known, "h"), "suffix-contexts")
    release(spark)
    first = F.min(F.struct("doc", "tie", "at", "windows")).alias("first")
    strings = own.write(shared.groupBy("h", "c").agg(first, F.count("*").alias("n"), F.max("all").alias("all")), "suffix-strings")
    release(spark)
    most = max(CROWD, strings.count() // CROWDS)
    crowded = [r["h"] for r in strings.where("n < all").groupBy("h").count().where(F.col("count") > most).select("h").collect()]
    shared = shared.drop("all")
    if crowded:
        told = spark.createDataFrame([(h,) for h in crowded], "h long")
        windows = own.write(named.select("doc", "tie", "text").mapInArrow(_single_windows(spark.sparkContext.broadcast(crowded)), CONTEXT), "suffix-windows")
        single = windows.groupBy("h", "c").agg(first, F.count("*").alias("n")).where("n > 1").withColumn("all", F.col("n"))
        strings = own.write(strings.join(F.broadcast(told), "h", "left_anti").unionByName(single), "suffix-crowd")
        shared = shared.join(F.broadcast(told), "h", "left_anti").unionByName(windows)
    one = F.struct("first.at", "first.windows", (F.col("n") > 1).alias("several"), (F.col("n") == F.col("all")).alias("alone"))
    lists = strings.groupBy(F.col("first.doc").alias("of"), F.col("first.tie").alias("of_tie")).agg(F.collect_list(one).alias("wanted"))
    joined = named.join(lists.hint("shuffle_hash"), (F.col("doc") == F.col("of")) & (F.col("tie") == F.col("of_tie"))).select("doc", "tie", "text", "wanted")
    merged = own.write(joined.mapInArrow(_strings, STRINGS).repartition("key").sortWithinPartitions("key").mapInArrow(_merge_task, FOUND), "suffix-merged")
    release(spark)
    confirmed = merged.where("context is not null").groupBy("doc", "tie", F.col("context").alias("at")).agg(F.sum("stop").alias("windows"))
    several = strings.where("n > 1").select("h", "c", "first.doc", "first.tie", "first.at", F.col("first.windows").bitwiseAND(F.lit(0xFFFF)).alias("windows"))
    several = own.write(several.join(confirmed, ["doc", "tie", "at", "windows"]).select("h", "c", F.struct("doc", "tie", "at").alias("first"), "windows"), "suffix-several")
    others = shared.select("h", "c", "doc", "tie", "at").join(several, ["h", "c"]).where(F.struct("doc", "tie", "at") != F.col("first"))
    others = others.select("doc", "tie", F.col("at").alias("start"), (F.col("at") + F.col("windows") + WINDOW - 1).alias("stop"))
    found = materialize(others.union(merged.where("context is null").drop("context")), "suffix-intervals")
    own.clear()
    release(spark)
    return found


def _cut(data: np.ndarray, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, how many bytes went, and in how many runs."""
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    kept, at = [], 0
    for s, e in merged:
        kept.append(data[at:s].tobytes())
        at = e
    kept.append(data[at:].tobytes())
    return b"".join(kept), sum(e - s for s, e in merged), len(merged)


def _with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (own_id, text, ...) with spans, the intervals to cut out of each text."""
    rows = docs.withColumn("own_tie", tie_of(docs, "own_id"))
    named = rows.select(F.col("own_id").alias("doc"), F.col("own_tie").alias("tie"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    spans = repeated_intervals(named).groupBy(F.col("doc").alias("of"), F.col("tie").alias("of_tie")).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return rows.join(spans.hint("shuffle_hash"), (F.col("own_id") == F.col("of")) & (F.col("own_tie") == F.col("of_tie")), "left")


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs`` (doc_id, text).

    Null texts count as empty. Rows of one id and equal text are one document, each returned; other
    texts of an id are documents of their own, in the order of a hash. Rows without an id have no place in the order and keep all their bytes. Texts under WINDOW bytes keep
    theirs. An empty table gives no rows; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            rows = [(_cut(data, spans), len(data)) for data, spans in zip(_texts(batch.column(1)), _lists(batch.column(2), ("start", "stop")), strict=True)]
            n = [pa.array([x for x in part], pa.int64()) for part in ([b for _, b in rows], [r[1] for r, _ in rows], [r[2] for r, _ in rows])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *n, pa.array([hashlib.sha256(r[0]).hexdigest() for r, _ in rows], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("own_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _with_spans(rows).select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; all columns and rows stay.

    A cut can fall inside a character; the bytes of it that are left are dropped.
    """

    def run(batches):
        for batch in batches:
            kept = [None if t is None else _cut(data, spans)[0].decode("utf-8", "ignore") for t, data, spans in zip(batch.column(1).is_null().to_pylist(), _texts(batch.column(1)), _lists(batch.column(2), ("start", "stop")), strict=True)]
            text = [None if null else x for null, x in zip(batch.column(1).is_null().to_pylist(), kept, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["row", "text"])

    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[docs[c] for c in rest]).alias("row"), docs["text"].cast("string").alias("text"), docs["doc_id"].cast("long").alias("own_id"), docs["doc_id"].alias("doc_id"))
    kind = rows.schema["row"].dataType.simpleString()
    done = _with_spans(rows).select("row", "text", "spans").mapInArrow(run, f"row {kind}, text string")
    return done.select(*[F.col(f"row.{c}").alias(c) if c != "text" else F.col("text") for c in docs.columns])
