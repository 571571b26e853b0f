"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text is cut into paragraphs (lines; longer ones every PIECE characters), and the distinct 64-bit
digests of these form a set. A digest is added to one cell in each of three parts of a sketch; a
cell holds how many digests it got and the xor of them; 16 bits of a digest check the others. Subtracting
the sketches of two versions cancels what they share. A cell with one digest left gives it away;
taking it out of its other cells lays open more, until all differing digests are recovered.

So that the work stays in proportion to the text, digests are dealt by their hash to a square of
groups, about GROUP digests to a group, and each group has a sketch of its own. A sketch that gets
stuck is made again with twice as many cells, as often as it takes.

A fingerprint is the sketch of every group of its text, each as large as it takes to peel it alone.
So it gives back all its digests, and nothing but two fingerprints is needed to tell how texts differ:
where their squares agree group is subtracted from group, else both are dealt to the larger square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 256
GROUP = 4
#: Cells in each of the three parts of a group's smallest sketch, and how often they may be doubled.
WIDTH, DOUBLINGS = 4, 14
PARTS = 3
#: Ranges of ids of about equal numbers of rows, and the bytes of text from which they are cut further.
RANGES, RANGE_BYTES = 200, 64 << 20


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digests(text: Column) -> Column:
    """The set of paragraph digests of a text, as an array. The low 16 bits check the others."""

    def checked(paragraph: Column) -> Column:
        high = F.xxhash64(paragraph).bitwiseAND(F.lit(~0xFFFF))
        return high.bitwiseOR(_check(high))

    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PIECE}}}"), 0), checked))


def _check(key: Column) -> Column:
    return F.xxhash64(key.bitwiseAND(F.lit(~0xFFFF)), F.lit("check")).bitwiseAND(F.lit(0xFFFF))


def _places(key: Column, width: Column) -> Column:
    """The cell of each part that a digest goes to, in parts of ``width`` cells."""
    return F.array(*[(F.pmod(F.xxhash64(key, F.lit(part), width), width) + width * part).cast("int") for part in range(PARTS)])


def _signed(keys: Column, sign: int, width: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(sign).alias("n"), k.alias("key"), _places(k, width).alias("at")))


def _add(cell: Column, x: Column, sign: int = 1) -> Column:
    return F.struct((cell["n"] + x["n"] * sign).alias("n"), cell["key"].bitwiseXOR(x["key"]).alias("key"))


def sketch(added: Column, width: Column) -> Column:
    """Cells (n, key): the sum of the signs and the xor of the keys of the digests dealt to each.

    The sketch is linear: digests given with sign -1 subtract the sketch of their set.
    """
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"))
    cell = lambda placed, i: F.aggregate(placed, empty, lambda acc, x: F.when(F.array_contains(x["at"], i), _add(acc, x)).otherwise(acc))
    return _let(added, lambda placed: F.transform(F.sequence(F.lit(0), width * PARTS - 1), lambda i: cell(placed, i)))


def peel(cells: Column, width: Column, most: Column) -> Column:
    """(done, ours, theirs) of a difference: whether all was recovered, and the digests of each side.

    Several digests in a cell can look like one that is in neither set. It is taken out, which puts it into its
    other cells, and again from there with the other sign; so what is taken as often with either sign is left out.

    Each round takes out the digests of all pure cells; ``most`` is the largest number of digests in
    which the two sets can differ, the sum of their sizes, and so of rounds.
    """
    none = F.array().cast("array<bigint>")

    def state(cells: Column, ours: Column, theirs: Column, live: Column) -> Column:
        return F.struct(cells.alias("cells"), ours.alias("ours"), theirs.alias("theirs"), live.alias("live"))

    def pure(cells: Column) -> Column:
        checked = lambda x: (F.abs(x["n"]) == 1) & (x["key"].bitwiseAND(F.lit(0xFFFF)) == _check(x["key"]))
        alone = F.filter(cells, lambda x, i: checked(x) & F.array_contains(_places(x["key"], width), i))
        return F.transform(F.array_distinct(alone), lambda x: F.struct(x["n"].alias("n"), x["key"].alias("key"), _places(x["key"], width).alias("at")))

    def taken(s: Column) -> Column:
        def without(found: Column) -> Column:
            less = lambda x, i: F.aggregate(found, x, lambda acc, k: F.when(F.array_contains(k["at"], i), _add(acc, k, -1)).otherwise(acc))
            side = lambda name, sign: F.concat(s[name], F.transform(F.filter(found, lambda k: k["n"] == sign), lambda k: k["key"]))
            return state(F.transform(s["cells"], less), side("ours", 1), side("theirs", -1), F.size(found) > 0)

        return _let(pure(s["cells"]), without)

    clear = lambda found: F.forall(found, lambda x: (x["n"] == 0) & (x["key"] == 0))
    step = lambda s, _: F.when(s["live"], taken(s)).otherwise(s)
    times = lambda keys, k: F.size(F.filter(keys, lambda x: x == k))
    more = lambda a, b: F.filter(F.array_distinct(a), lambda k: times(a, k) > times(b, k))

    def end(s: Column) -> Column:
        again = F.arrays_overlap(s["ours"], s["theirs"])
        side = lambda a, b: F.when(again, more(s[a], s[b])).otherwise(s[a]).alias(a)
        return F.struct(clear(s["cells"]).alias("done"), side("ours", "theirs"), side("theirs", "ours"))

    return F.aggregate(F.array_repeat(F.lit(0), most), state(cells, none, none, F.lit(True)), step, end)


def recovered(ours: Column, theirs: Column) -> Column:
    """(cells, found) of one group: the smallest sketch of the difference that does not get stuck, and its digests."""
    none = F.array().cast("array<bigint>")
    no_cells = F.array().cast("array<struct<n:int,key:bigint>>")
    start = F.struct(no_cells.alias("cells"), F.struct(F.lit(False).alias("done"), none.alias("ours"), none.alias("theirs")).alias("found"))

    def attempt(k: Column) -> Column:
        width = (F.lit(WIDTH) * F.pow(F.lit(2.0), k)).cast("int")
        both = lambda w: F.concat(_signed(ours, 1, w), _signed(theirs, -1, w))
        peeled = lambda w: lambda cells: F.struct(cells.alias("cells"), peel(cells, w, F.size(ours) + F.size(theirs)).alias("found"))
        return _let(width, lambda w: _let(sketch(both(w), w), peeled(w)))

    tried = F.aggregate(F.sequence(F.lit(0), F.lit(DOUBLINGS)), start, lambda acc, k: F.when(acc["found"]["done"], acc).otherwise(attempt(k)))
    stuck = F.raise_error(F.lit("digests that no sketch of any size tells apart")).cast("struct<cells:array<struct<n:int,key:bigint>>,found:struct<done:boolean,ours:array<bigint>,theirs:array<bigint>>>")
    return _let(tried, lambda t: F.when(t["found"]["done"], t).otherwise(stuck))


def square(n: Column) -> Column:
    """Side of the square of groups to which a set of ``n`` digests is dealt."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(n / F.lit(GROUP)))).cast("int")


def by_group(ours: Column, theirs: Column, side: Column) -> Column:
    """:func:`recovered` of every group of two sets, row by row of the square."""

    def dealt(parts: Column) -> Column:
        def outer(s: Column) -> Column:
            def inner(t: Column) -> Column:
                of = lambda keys: F.filter(keys, lambda d: F.pmod(F.shiftrightunsigned(d, 32), parts) == t)
                return lambda a, b: _let(of(a), lambda x: _let(of(b), lambda y: recovered(x, y)))

            of = lambda keys: F.filter(keys, lambda d: F.pmod(F.shiftrightunsigned(d, 16).bitwiseAND(F.lit(0xFFFF)), parts) == s)
            both = lambda a: lambda b: F.transform(F.sequence(F.lit(0), parts - 1), lambda t: inner(t)(a, b))
            return _let(of(ours), lambda a: _let(of(theirs), both(a)))

        return F.flatten(F.transform(F.sequence(F.lit(0), parts - 1), outer))

    return _let(side, dealt)


def difference(ours: Column, theirs: Column) -> Column:
    """Digests (ours, theirs) that one of two sets has and the other lacks."""
    side = lambda found, name: F.flatten(F.transform(found, lambda g: g["found"][name])).alias(name)
    groups = by_group(ours, theirs, square(F.greatest(F.size(ours), F.size(theirs))))
    return _let(groups, lambda found: F.struct(side(found, "ours"), side(found, "theirs")))


def likeness(ours: Column, theirs: Column) -> Column:
    """Twice the shared digests of two sets over the sum of their sizes, from the digests in which they differ."""
    sizes = F.size(ours) + F.size(theirs)

    def share(found: Column) -> Column:
        differing = F.size(found["ours"]) + F.size(found["theirs"])
        return F.when(sizes == 0, F.lit(1.0)).otherwise((sizes - differing) / sizes)

    return _let(difference(ours, theirs), share)


def as_text(keys: Column) -> Column:
    """The fingerprint of a set of digests: groups by ``;``, their cells by ``,``, each its count and its xor in hex."""
    cell = lambda c: F.when((c["n"] == 0) & (c["key"] == 0), "").otherwise(F.concat_ws(".", c["n"].cast("string"), F.lower(F.hex(c["key"]))))
    group = lambda g: F.array_join(F.transform(g["cells"], cell), ",")
    none = F.array().cast("array<bigint>")
    return F.array_join(F.transform(by_group(keys, none, square(F.size(keys))), group), ";")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``key``, by halving."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(bounds[middle]), among(low, middle)).otherwise(among(middle + 1, high))

    return among(0, len(bounds))


def with_next(docs: DataFrame, ranges: int = RANGES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, text and next_text: the text of the row with the next smaller id, of the first row for the last.

    Rows of one id stand in the order of their texts, rows without an id come last. Ids are cut into
    ranges of about equal numbers of rows, and these at even steps into as many as it takes to have
    about ``range_bytes`` of text in each. Each range is sorted by itself, with the first row of the
    next range as a guest after its last, so no task sees all rows. Ids and counts decide the ranges;
    of the texts only the guests, one a range, move apart from their own range.
    """
    lowest = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("key"))
    asked = [k / ranges for k in range(1, ranges)]
    found = rows.agg(F.percentile_approx("key", asked, 10 * ranges).alias("bounds"), F.min("doc_id").cast("long").alias("low"), F.max("key").alias("top"), F.sum(F.octet_length("text")).alias("bytes")).first()
    bounds = sorted({*(found["bounds"] or [])})
    steps = max(1, -(-(found["bytes"] or 0) // (ranges * range_bytes)))
    part = _range_of(F.col("key"), bounds).cast("long")
    if steps > 1 and bounds:
        low, high = [min(found["low"], bounds[0]) if found["low"] is not None else bounds[0], *bounds], [*bounds, found["top"] + 1]
        at = lambda ends: F.get(F.array(*[F.lit(float(x)) for x in ends]), part.cast("int"))
        within = F.floor((F.col("key") - at(low)) / F.greatest(at(high) - at(low), F.lit(1.0)) * steps)
        part = part * steps + F.least(F.greatest(within, F.lit(0)), F.lit(steps - 1))
    placed = rows.withColumn("part", part)
    heads = placed.groupBy("part").agg(F.max("key").alias("head"))  # a row a range, so the window over all of them is small
    order = Window.orderBy(F.desc("part"))
    hosts = heads.select("head", F.coalesce(F.lag("part").over(order), F.min("part").over(Window.partitionBy())).alias("host"))
    guests = placed.join(F.broadcast(hosts), F.col("key") == F.col("head")).select("doc_id", "text", "key", F.col("host").alias("part"), F.lit(1).alias("guest"))
    all_rows = placed.select("doc_id", "text", "key", "part", F.lit(0).alias("guest")).union(guests)
    order = Window.partitionBy("part").orderBy("guest", F.desc("key"), "text")
    return all_rows.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has its last third replaced by the beginning of the next document. Null texts
    count as empty and are like each other; an only row is its own neighbour; repeated rows are each
    returned and neighbours of each other; an empty table gives no rows; other columns are not read.
    """
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third))
    rows = with_next(docs).withColumn("edited", edited)
    keep = lambda x: _let(x, lambda y: y)  # noqa: E731  computed once, not at each use
    rows = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        keep(digests(F.col("text"))).alias("own"), keep(digests(F.col("edited"))).alias("changed"), keep(digests(F.col("next_text"))).alias("other"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("other")).alias("near_next"),
    )

