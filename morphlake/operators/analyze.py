"""Analysers: from text to morphemes and tagged tokens.

An analyser has ``morphemes(text)``, an array of MORPHEME, and ``tagged(text)``, an array of
(surface, tag). The first two need nothing but Spark; the third needs an installed tagger.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import expand_morphs

FEATURES = ("pos", "semantic", "has_jongseong", "reading", "type", "start_pos", "end_pos", "expression")
MORPHEME = "array<struct<surface:string," + ",".join(f"{f}:{'boolean' if f == 'has_jongseong' else 'string'}" for f in FEATURES) + ">>"
#: Entries and connection costs of a dictionary that is sent to every worker; larger ones are refused.
MOST_ENTRIES, MOST_CONNECTIONS = 2_000_000, 10_000_000
UNKNOWN_COST = 12_000


class Analyzer(Protocol):
    def morphemes(self, text: Column) -> Column: ...

    def tagged(self, text: Column) -> Column: ...


def features(values: list[str | None]) -> dict:
    """Eight fields of an analysis: ``*`` is null, the final consonant flag a boolean."""
    out = {name: None if v in (None, "*") else v for name, v in zip(FEATURES, values, strict=True)}
    out["has_jongseong"] = None if out["has_jongseong"] is None else out["has_jongseong"] in (True, "T")
    return out


class PretaggedAnalyzer:
    """For texts that another tool has tagged: ``surface/TAG`` separated by white space."""

    def tagged(self, text: Column) -> Column:
        items = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")
        cut = lambda x: F.length(F.substring_index(x, "/", -1))
        return F.transform(items, lambda x: F.struct(F.substr(x, F.lit(1), F.length(x) - cut(x) - 1).alias("surface"), F.substring_index(x, "/", -1).alias("tag")))

    def morphemes(self, text: Column) -> Column:
        empty = lambda f: F.lit(None).cast("boolean" if f == "has_jongseong" else "string").alias(f)
        return F.transform(self.tagged(text), lambda t: F.struct(t["surface"].alias("surface"), t["tag"].alias("pos"), *[empty(f) for f in FEATURES[1:]]))


def script_class(letter: str) -> str:
    """Tag of unknown letters by kind: digits, Han, Latin and other letters, symbols."""
    if letter.isdigit():
        return "SN"
    if letter.isalpha():
        name = unicodedata.name(letter, "")
        return "SH" if name.startswith("CJK") else "NNG" if name.startswith("HANGUL") else "SL"
    return "SF" if letter in ".?!" else "SC" if letter in ",:;/" else "SSO" if letter in "([{" else "SSC" if letter in ")]}" else "SY"


class Lattice:
    """Cheapest path over dictionary words: costs of words and of neighbouring context ids."""

    def __init__(self, entries: list[tuple], connections: dict[tuple[str, str], int]):
        self.words = defaultdict(list)
        self.longest = 1
        for surface, left, right, cost, *rest in entries:
            self.words[surface].append((left or "", right or "", int(cost), rest))
            self.longest = max(self.longest, len(surface))
        self.connections = connections

    def _edges(self, chunk: str, at: int) -> Iterator[tuple[int, str, str, int, list]]:
        for n in range(1, min(self.longest, len(chunk) - at) + 1):
            for left, right, cost, rest in self.words.get(chunk[at : at + n], ()):
                yield at + n, left, right, cost, rest
        kind = script_class(chunk[at])
        end = at + 1
        while end < len(chunk) and script_class(chunk[end]) == kind and kind not in ("SY", "SSO", "SSC"):
            end += 1
        for stop in {at + 1, end}:
            yield stop, "", "", UNKNOWN_COST + 100 * (stop - at), [kind] + [None] * 7

    def parse(self, text: str | None) -> list[dict]:
        out = []
        for chunk in (text or "").split():
            # best[i][right id] = (cost, from, id there, surface, features); ties go to the path found first
            best: list[dict] = [{} for _ in range(len(chunk) + 1)]
            best[0][""] = (0, None, None, None, None)
            for at in range(len(chunk)):
                if not best[at]:
                    continue
                for end, left, right, cost, rest in self._edges(chunk, at):
                    for before, (so_far, *_) in best[at].items():
                        total = so_far + cost + self.connections.get((before, left), 0)
                        if right not in best[end] or total < best[end][right][0]:
                            best[end][right] = (total, at, before, chunk[at:end], rest)
            at, side, path = len(chunk), min(best[-1], key=lambda k: best[-1][k][0]), []
            while at:
                _, start, before, surface, rest = best[at][side]
                path.append({"surface": surface} | features(rest))
                at, side = start, before
            out += reversed(path)
        return out


class DictionaryAnalyzer:
    """Lattice analysis with entries (``wordlists.USER_FIELDS``) and connection costs (right_id, left_id, cost)."""

    def __init__(self, entries: DataFrame, connections: DataFrame | None = None):
        rows = entries.select("surface", "left_id", "right_id", "cost", *FEATURES).limit(MOST_ENTRIES + 1).collect()
        if len(rows) > MOST_ENTRIES:
            raise ValueError(f"a dictionary for every worker may have {MOST_ENTRIES} entries at most")
        table = [tuple(r) for r in sorted(rows, key=lambda r: tuple(map(str, r)))]
        pairs = connections.select("right_id", "left_id", "cost").limit(MOST_CONNECTIONS + 1).collect() if connections is not None else []
        if len(pairs) > MOST_CONNECTIONS:
            raise ValueError(f"connections for every worker may be {MOST_CONNECTIONS} at most")
        sent = entries.sparkSession.sparkContext.broadcast((table, {(r[0], r[1]): r[2] for r in pairs}))

        @F.pandas_udf(MORPHEME)
        def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            lattice = Lattice(*sent.value)
            for texts in batches:
                yield texts.map(lattice.parse)

        self._parse = parse

    def morphemes(self, text: Column) -> Column:
        return self._parse(text)

    def tagged(self, text: Column, flatten: bool = True) -> Column:
        return expand_morphs(self.morphemes(text), flatten)


class MecabAnalyzer:
    """An installed MeCab through fugashi, one tagger a Python worker; ``options`` are its command line."""

    def __init__(self, options: str = ""):
        import fugashi  # noqa: F401  fails here, not in a task, where it is missing

        @F.pandas_udf(MORPHEME)
        def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import fugashi

            tagger = fugashi.GenericTagger(options)
            for texts in batches:
                yield texts.map(lambda t: [{"surface": w.surface} | features(list(w.feature)[:8]) for w in tagger(t or "")])

        self._parse = parse

    def morphemes(self, text: Column) -> Column:
        return self._parse(text)

    def tagged(self, text: Column, flatten: bool = True) -> Column:
        return expand_morphs(self.morphemes(text), flatten)
