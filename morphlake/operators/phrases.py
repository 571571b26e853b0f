"""Dictionaries and vocabularies walked along the tokens of each document in one pass.

A table whose size is checked goes to all tasks, as a set of its entries and of what they begin with. A
walk from a token goes on only while an entry begins with the tokens so far, which for nearly all tokens
ends at the first or second. Tables beyond the limit are not sent; callers then join instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tagset as T
from ..functions.batches import SLICE, bounded_batches

#: Bytes of strings, with ROW_BYTES for each row, up to which a table is sent to all tasks.
SENT_BYTES, ROW_BYTES = 64 << 20, 64


def table_below(rows: DataFrame, limit: int | None = None) -> pa.Table | None:
    """``rows`` on the driver if they are small enough to be sent to all tasks, else None."""
    limit = SENT_BYTES if limit is None else limit
    text = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in rows.dtypes if kind == "string"), F.lit(0).cast("long"))
    size = rows.agg((F.count("*") * ROW_BYTES + F.coalesce(F.sum(text), F.lit(0))).alias("bytes")).first()["bytes"]
    return rows.toArrow() if size <= limit else None


def folded(text: str) -> str:
    """Small letters; the small sigma at the end of a word is written as inside one, so beginnings stay beginnings."""
    return text.lower().replace("ς", "σ")


class Phrases:
    """Tags of dictionary words, and what the words begin with."""

    def __init__(self, tags: dict[str, str]) -> None:
        self.tags = tags
        self._beginnings: set[str] | None = None

    @property
    def beginnings(self) -> set[str]:
        if self._beginnings is None:  # made once in each worker
            self._beginnings = {w[:k] for w in map(folded, self.tags) for k in range(len(w) + 1)}
        return self._beginnings

    def __getstate__(self) -> dict:
        return {"tags": self.tags, "_beginnings": None}

    def retag(self, surfaces: list[str | None], tags: list[str | None]) -> list[str | None]:
        """Tag of the dictionary, else the first part of a compound tag; a root becomes a noun."""
        out = []
        for surface, tag in zip(surfaces, tags, strict=True):
            tag = self.tags.get(surface.lower(), tag) if surface is not None else tag
            tag = tag.split("+", 1)[0] if tag else tag
            out.append("NNG" if tag == "XR" else tag)
        return out

    def merge(self, surfaces: list[str], tags: list[str], most: int, patterns: tuple[str, ...], heads: set[str], skipped: frozenset[str]) -> tuple[list, list]:
        """Tokens after one pass: from each place the longest run of 2 to ``most`` tokens that is a phrase
        becomes one. The last token never takes part. ``heads`` has what ``patterns`` begin with."""
        begun, out_s, out_t, i = self.beginnings, [], [], 0
        low, kinds = [folded(s) if s else "" for s in surfaces], [_noun(t) for t in tags]
        last = len(surfaces) - 1
        while i < last - 1:
            # Nearly all places end here: no word goes on with the next token, no pattern with its tag.
            if low[i] + low[i + 1] in begun or kinds[i] in heads and f"{kinds[i]}+{kinds[i + 1]}" in heads:
                n, text, tag = self._longest(surfaces, tags, low, kinds, i, min(most, last - i), patterns, heads, skipped)
                if n:
                    out_s.append(text)
                    out_t.append(tag)
                    i += n
                    continue
            out_s.append(surfaces[i])
            out_t.append(tags[i])
            i += 1
        return out_s + surfaces[i:], out_t + tags[i:]

    def _longest(self, surfaces, tags, low, kinds, i, most, patterns, heads, skipped) -> tuple[int, str, str]:
        begun, known, hit = self.beginnings, self.tags, (0, "", "")
        begin, shape, whole, patterned = low[i], kinds[i], True, True
        for n in range(2, most + 1):
            begin += low[i + n - 1]
            shape += f"+{kinds[i + n - 1]}"
            whole, patterned = whole and begin in begun, patterned and shape in heads
            if not (whole or patterned):
                break
            found = None
            if whole and shape not in T.UNMERGED_PATTERNS:
                text = "".join([s for s in surfaces[i : i + n] if s])
                found = known.get(text.lower())
            if found is None and patterned and shape in patterns:
                run = list(zip(surfaces[i : i + n], tags[i : i + n], strict=True))
                for text in ("".join("n" if t == "SN" else s or "" for s, t in run), "".join(s or "" for s, t in run if t not in skipped)):
                    if (found := known.get(text.lower())) is not None:
                        break
            if found is not None:
                hit = (n, text, found)
        return hit


def _noun(tag: str | None) -> str:
    return "NNG" if tag in T.NOUN_TAGS else tag or ""


def _token_lists(column: pa.ListArray) -> Iterator[tuple[list, list]]:
    lengths = column.value_lengths().fill_null(0).to_pylist()
    flat = column.flatten()
    surfaces, tags, at = flat.field("surface").to_pylist(), flat.field("tag").to_pylist(), 0
    for n in lengths:
        yield surfaces[at : at + n], tags[at : at + n]
        at += n


def map_tokens(docs: DataFrame, one: Callable[[list, list], tuple[list, list]]) -> DataFrame:
    """``docs`` with ``tokens`` rewritten row by row by ``one`` of the surfaces and the tags; null tokens become none.

    A few documents are taken apart at a time, so memory does not follow the size of a batch.
    """
    place = docs.columns.index("tokens")
    kind = pa.struct([("surface", pa.string()), ("tag", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                surfaces, tags, ends = [], [], [0]
                for s, t in _token_lists(part.column(place)):
                    s, t = one(s, t)
                    surfaces += s
                    tags += t
                    ends.append(len(surfaces))
                flat = pa.StructArray.from_arrays([pa.array(surfaces, pa.string()), pa.array(tags, pa.string())], fields=list(kind))
                columns = list(part.columns)
                columns[place] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    kinds = [(f"`{f.name}`", "array<struct<surface:string,tag:string>>" if k == place else f.dataType.simpleString()) for k, f in enumerate(docs.schema.fields)]
    return bounded_batches(docs).mapInArrow(run, ", ".join(" ".join(x) for x in kinds))


def map_lists(docs: DataFrame, column: str, one: Callable[[list], list]) -> DataFrame:
    """``docs`` with an array of strings replaced by ``one`` of it; null stays null. Output goes on in small batches."""
    place = docs.columns.index(column)

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                columns = list(part.columns)
                columns[place] = pa.array([None if x is None else one(x) for x in columns[place].to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    kinds = [(f"`{f.name}`", "array<string>" if k == place else f.dataType.simpleString()) for k, f in enumerate(docs.schema.fields)]
    return bounded_batches(docs).mapInArrow(run, ", ".join(" ".join(x) for x in kinds))


def _tag(token: str) -> str | None:
    parts = token.split("/", 2)
    return parts[1] if len(parts) > 1 else None


class Runs:
    """Known n-grams of slash tokens, and what they begin with, unit by unit."""

    def __init__(self, terms: Iterable[str], delimiter: str = ";") -> None:
        self.terms, self.delimiter = set(terms), delimiter
        self._beginnings: set[str] | None = None

    @property
    def beginnings(self) -> set[str]:
        if self._beginnings is None:
            parts = (t.split(self.delimiter) for t in self.terms)
            self._beginnings = {self.delimiter.join(p[:k]) for p in parts for k in range(1, len(p) + 1)}
        return self._beginnings

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "delimiter": self.delimiter, "_beginnings": None}


def topic_runs(tokens: list[str | None], low: int, high: int, delimiter: str = ";", known: Runs | None = None) -> list[str]:
    """N-grams as in ``functions.tokens.topic_ngrams``, or only those that are known, by place and then by length."""
    tags = [None if t is None else _tag(t) for t in tokens]
    begun = None if known is None else known.beginnings
    out, n = [], len(tokens)
    for i, text in enumerate(tokens):
        if text is None or tags[i] not in T.NGRAM_START_TAGS or begun is not None and text not in begun:
            continue
        noun = tags[i] == "NNG"
        if low <= 1 and noun and (known is None or text in known.terms):
            out.append(text)
        for j in range(i + 1, min(i + high, n)):
            token = tokens[j]
            if token is None:
                break
            if token != tokens[j - 1]:
                text = f"{text}{delimiter}{token}"
                noun = noun or tags[j] == "NNG"
                if begun is not None and text not in begun:
                    break
            if noun and j - i + 1 >= low and (known is None or text in known.terms):
                out.append(text)
    return out


def known_ngrams(tokens: list[str | None], low: int, high: int, known: Runs) -> list[str]:
    """Those of ``functions.tokens.ngrams`` that are known, by place and then by length."""
    out, n, begun = [], len(tokens), known.beginnings
    for i, text in enumerate(tokens):
        if text not in begun:  # nearly all places end here
            continue
        if low <= 1 and text in known.terms:
            out.append(text)
        for j in range(i + 1, min(i + high, n)):
            if tokens[j] is None:
                break
            text = f"{text}{known.delimiter}{tokens[j]}"
            if text not in begun:
                break
            if j - i + 1 >= low and text in known.terms:
                out.append(text)
    return out


def longest_terms(terms: list[str | None]) -> list[str]:
    """Distinct terms, longest first, without those that are part of the text of another.

    All terms go into one automaton and each is read through it once, so the work is linear in their
    length and in the places where one lies in another. A part of a dropped term is also part of the term
    that this is part of.
    """
    distinct = sorted(dict.fromkeys(t for t in terms if t is not None), key=len, reverse=True)
    if len(distinct) < 2:
        return distinct
    import ahocorasick

    automaton, inside = ahocorasick.Automaton(), {""}
    for t in distinct:
        if t:
            automaton.add_word(t, t)
    automaton.make_automaton()
    for t in distinct:
        inside.update(found for _, found in automaton.iter(t) if len(found) < len(t))
    return [t for t in distinct if t not in inside]
