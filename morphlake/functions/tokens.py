"""Row-local column functions over tagged tokens and n-grams.

A tagged document is an array of (surface, tag); a slash token is ``surface/TAG``; an n-gram joins
slash tokens by ``;``. These functions need no shuffle and no state, so they also run on streams.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tagset as T
from .batches import SLICE, bounded_batches

STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for all its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(column: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(column, STRIP, "")


def pair(surface: Column, tag: Column) -> Column:
    return F.struct(surface.alias("surface"), tag.alias("tag"))


def slash(tokens: Column, delimiter: str = "/", with_tag: bool = True) -> Column:
    return F.transform(tokens, lambda t: F.concat(t["surface"], F.lit(delimiter), t["tag"]) if with_tag else t["surface"])


def morphs(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: t["surface"])


def keep_tags(tokens: Column, tags: Iterable[str]) -> Column:
    return F.filter(tokens, lambda t: t["tag"].isin(*tags))


def drop_tags(tokens: Column, tags: Iterable[str] = T.SYMBOL_TAGS) -> Column:
    return F.filter(tokens, lambda t: ~t["tag"].isin(*tags))


def base_nouns(tokens: Column, tags: Iterable[str] = T.BASE_NOUN_TAGS) -> Column:
    """Surfaces of tokens whose whole tag is a noun tag; compound tags do not count."""
    return morphs(keep_tags(tokens, tags))


def expand_morphs(morphemes: Column, flatten: bool = True) -> Column:
    """Tokens of analysed morphemes; without ``flatten`` an expression ``s/T/*+s/T/*`` gives its parts."""
    whole = lambda m: F.array(pair(m["surface"], m["pos"]))
    if flatten:
        return F.flatten(F.transform(morphemes, whole))
    parts = lambda m: F.transform(F.split(m["expression"], r"\+"), lambda x: pair(F.split_part(x, F.lit("/"), F.lit(1)), F.split_part(x, F.lit("/"), F.lit(2))))
    return F.flatten(F.transform(morphemes, lambda m: F.when(m["expression"].isNull(), whole(m)).otherwise(parts(m))))


def spaced(surfaces: list[str | None], tags: list[str | None], text: str) -> tuple[list, list]:
    """Tokens with (' ', 'SP') where the text has white space between them, found by one walk along the text.

    A token that the text does not go on with stays where it is and moves nothing.
    """
    out_s, out_t, at, size = [], [], 0, len(text)
    for surface, tag in zip(surfaces, tags, strict=True):
        start = at
        while at < size and text[at].isspace():
            at += 1
        if at > start and out_s:
            out_s.append(" ")
            out_t.append("SP")
        out_s.append(surface)
        out_t.append(tag)
        if surface and text.startswith(surface, at):
            at += len(surface)
    return out_s, out_t


def with_spaces(tokens: Column, text: Column) -> Column:
    """:func:`spaced` of tokens and their text, linear in both; null tokens stay null, a null text has no white space."""

    @F.arrow_udf("array<struct<surface:string,tag:string>>")
    def run(tokens: pa.Array, text: pa.Array) -> pa.Array:
        lengths, flat = tokens.value_lengths(), tokens.flatten()
        surfaces, tags, at = flat.field("surface").to_pylist(), flat.field("tag").to_pylist(), 0
        out_s, out_t, ends = [], [], [0]
        for n, own in zip(lengths.to_pylist(), text.to_pylist(), strict=True):
            s, t = spaced(surfaces[at : at + (n or 0)], tags[at : at + (n or 0)], own or "")
            at += n or 0
            out_s += s
            out_t += t
            ends.append(len(out_s))
        values = pa.StructArray.from_arrays([pa.array(out_s, pa.string()), pa.array(out_t, pa.string())], names=["surface", "tag"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=lengths.is_null())

    return run(tokens, text)


def drop_auxiliaries(tokens: Column) -> Column:
    """Slash tokens without auxiliaries, but for the few that turn a meaning around."""
    return F.filter(tokens, lambda t: ~F.split_part(t, F.lit("/"), F.lit(2)).isin(*T.AUXILIARY_TAGS) | t.isin(*T.AUXILIARY_WORDS))


def _from(array: Column, place: int) -> Column:
    """The elements from ``place`` on."""
    return F.slice(array, place + 1, F.size(array)) if place else array


def _runs(first: Column, rest: Column, low: int, high: int, grow, text) -> Column:
    """``text`` of every run of low..high elements, by place and then by length; nulls are left out.

    ``first`` has the runs of one element; ``grow`` makes a run longer by an element of ``rest``, null
    past the end. A run is made once and grown, so the work is linear in the output.
    """

    def level(levels: list[Column], n: int) -> Column:
        if n > high:
            one = F.transform(levels[low - 1], lambda x: F.array(text(x)))
            for more in levels[low:]:
                one = F.zip_with(one, more, lambda a, x: F.concat(a, F.array(text(x))))
            return F.filter(F.flatten(one), lambda x: x.isNotNull())
        return let(F.zip_with(levels[-1], _from(rest, n - 1), grow), lambda x: level([*levels, x], n + 1))

    return level([first], 2)


def ngrams(tokens: Column, low: int = 1, high: int = 3, delimiter: str = ";") -> Column:
    # Bound once: an optimiser that pulls the array's expression into a lambda would compute it at each place.
    return let(tokens, lambda t: _runs(t, t, low, high, lambda a, b: F.concat(a, F.lit(delimiter), b), lambda x: x))


def topic_ngrams(tokens: Column, low: int, high: int, delimiter: str = ";") -> Column:
    """N-grams of slash tokens that begin with a noun, adjective or adverb and hold a noun.

    A token equal to the one before it in the run is left out.
    """
    tag = lambda t: F.split_part(t, F.lit("/"), F.lit(2))

    def described(array: Column) -> Column:
        same = lambda t, i: F.coalesce(t == F.get(array, i - 1), F.lit(False))
        return F.transform(array, lambda t, i: let(tag(t), lambda x: F.struct(t.alias("t"), F.coalesce(x.isin(*T.NGRAM_START_TAGS), F.lit(False)).alias("starts"), (x == "NNG").alias("noun"), same(t, i).alias("same"))))

    def grow(a: Column, b: Column) -> Column:
        longer = F.when(b["same"], a["text"]).otherwise(F.concat(a["text"], F.lit(delimiter), b["t"]))
        return F.struct(F.when(b["t"].isNotNull(), longer).alias("text"), (a["noun"] | b["noun"]).alias("noun"))

    def runs(info: Column) -> Column:
        first = F.transform(info, lambda x: F.struct(F.when(x["starts"], x["t"]).alias("text"), x["noun"].alias("noun")))
        return let(first, lambda x: _runs(x, info, low, high, grow, lambda run: F.when(run["noun"], run["text"])))

    return let(tokens, lambda t: let(described(t), runs))


def longest_only(terms: Column) -> Column:
    """Terms, longest first, without those that are part of the text of one kept before."""
    # A repeated term is part of its first occurrence, so distinct terms give the same result.
    sized = F.transform(F.array_distinct(terms), lambda t, i: F.struct((-F.length(t)).alias("size"), i.alias("at"), t.alias("term")))
    ordered = F.transform(F.sort_array(sized), lambda x: x["term"])
    none = F.array().cast("array<string>")
    return F.aggregate(ordered, none, lambda acc, t: F.when(F.exists(acc, lambda kept: F.contains(kept, t)), acc).otherwise(F.concat(acc, F.array(t))))


def longest_ngrams(words: list[str], high: int, delimiter: str = ";") -> list[str]:
    """:func:`longest_only` of all n-grams of up to ``high`` words, without comparing pairs.

    Every shorter n-gram is part of one of ``high`` words (or of all words, if there are fewer), so
    only these can stay. What is part of a dropped term is part of the one that this is part of, so a
    term stays if no suffix of a term but itself begins with it. Suffixes with fewer delimiters than
    all terms begin with none.
    """
    high = min(high, len(words))
    terms = dict.fromkeys(delimiter.join(words[k : k + high]) for k in range(len(words) - high + 1)) if words else {}
    least = min((t.count(delimiter) for t in terms), default=0)
    suffixes = sorted(t[k:] for t in terms for k in range(len(t.rsplit(delimiter, least)[0]) + 1))
    kept = []
    for t in sorted(terms, key=len, reverse=True):
        after = bisect.bisect_left(suffixes, t) + 1
        if not (after < len(suffixes) and suffixes[after].startswith(t)):
            kept.append(t)
    return kept


def _mapped_lists(rows: DataFrame, column: str, one: Callable[[list], list]) -> DataFrame:
    """doc_id and terms, ``one`` of an array of strings, of every row; a few documents at a time."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                found = [one(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "terms"])

    rows = bounded_batches(rows).select("doc_id", column)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, terms array<string>")


def with_longest_ngrams(rows: DataFrame, high: int) -> DataFrame:
    """doc_id and terms, :func:`longest_ngrams` of the array ``words``, of every row."""
    return _mapped_lists(rows, "words", lambda words: longest_ngrams(words, high))


def phrase_of(term: str) -> str:
    """As :func:`phrase`."""
    parts = [x.split("/") for x in term.split(";")]
    return "".join([x[0] for x in parts]) if all([len(x) == 2 for x in parts]) else term


def with_phrases(rows: DataFrame, low: int = 1, high: int = 3, delimiter: str = ";") -> DataFrame:
    """doc_id and terms, the :func:`phrase` of each of the :func:`ngrams` of the array ``terms``, of every row."""

    def one(tokens: list[str | None]) -> list[str]:
        out, n = [], len(tokens)
        whole = [None if t is None else phrase_of(t) for t in tokens]
        # Where all tokens have one slash, a phrase is the phrases of its tokens side by side.
        plain = [t is not None and delimiter == ";" and ";" not in t and t.count("/") == 1 for t in tokens]
        for i in range(n):
            for j in range(i + low, min(i + high, n) + 1):
                if all(plain[i:j]):
                    out.append("".join(whole[i:j]))
                elif None not in tokens[i:j]:
                    out.append(phrase_of(delimiter.join(tokens[i:j])))
        return out

    return _mapped_lists(rows, "terms", one)


def phrase(term: Column) -> Column:
    """Surfaces of an n-gram without blanks; the term itself if a part has not exactly one slash."""
    parts = F.split(term, ";")
    joined = F.array_join(F.transform(parts, lambda x: F.split_part(x, F.lit("/"), F.lit(1))), "")
    return F.when(F.forall(parts, lambda x: F.size(F.split(x, "/")) == 2), joined).otherwise(term)


def has_final_consonant(word: Column) -> Column:
    """Whether the last syllable has one; for other scripts the same arithmetic on its code point."""
    return F.pmod(F.ascii(F.substring(word, -1, 1)) - 44032, F.lit(28)) != 0


def includes(word: Column, items: Iterable[str], unit_level: bool = False, endswith: bool = False, startswith: bool = False) -> Column:
    """Whether a word in lower case holds, ends with or begins with an item in lower case, or has an
    item as a unit between ``;``."""
    items, word = list(items), F.lower(word)
    if unit_level:
        units = F.split(word, ";")
        if endswith:
            return F.element_at(units, -1).isin(*items)
        return F.get(units, F.lit(0)).isin(*items) if startswith else F.exists(units, lambda u: u.isin(*items))
    test = F.endswith if endswith else F.startswith if startswith else F.contains
    out = F.lit(False)
    for item in items:
        out = out | test(word, F.lit(item.lower()))
    return out


def polarity_of(scores: Column, by_count: bool = True) -> Column:
    """Polarity of an array of scores: by count each is one or minus one by its sign; by value the
    divisor is twice the number of positive ones."""
    up, down = F.filter(scores, lambda x: x > 0), F.filter(scores, lambda x: x < 0)
    if by_count:
        return (F.size(up) - F.size(down)) / (F.size(up) + F.size(down) + F.lit(T.EPSILON))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    return (total(up) + total(down)) / (2 * F.size(up) + F.lit(T.EPSILON))
