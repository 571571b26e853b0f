"""Maintenance of user dictionaries of a morphological analyser.

Entries have the fields of ``wordlists.USER_FIELDS``; context ids (line_no, id, pos, semantic,
has_jongseong, ...) come in two tables, for the left and for the right side.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import has_final_consonant
from ..sources.wordlists import USER_FIELDS


@dataclass(frozen=True)
class UserDictionary:
    entries: DataFrame
    left_ids: DataFrame
    right_ids: DataFrame

    def with_context_ids(self, entries: DataFrame) -> DataFrame:
        """The first id in file order by (pos, semantic), on the right also by final consonant; else null."""
        left = self.left_ids.groupBy("pos", "semantic").agg(F.min_by("id", "line_no").alias("l"))
        right = self.right_ids.groupBy("pos", "semantic", "has_jongseong").agg(F.min_by("id", "line_no").alias("r"))
        rows = entries.drop("left_id", "right_id").join(left, ["pos", "semantic"], "left").join(right, ["pos", "semantic", "has_jongseong"], "left")
        return rows.withColumnsRenamed({"l": "left_id", "r": "right_id"}).select(*USER_FIELDS)

    def add(self, words: DataFrame, pos: str = "NNP", semantic: str = "*", cost: int = 1000) -> UserDictionary:
        """With the words (surface, and reading or null) of a table; they replace entries of equal surface.

        Of equal surfaces the one with the highest ``line_no`` is taken, if there is such a column, else the
        one with the last reading in order.
        """
        if "reading" not in words.columns:
            words = words.withColumn("reading", F.lit(None).cast("string"))
        last = F.struct("line_no") if "line_no" in words.columns else F.struct(F.coalesce("reading", "surface"))
        words = words.groupBy("surface").agg(F.max_by("reading", last).alias("reading"))
        reading = F.coalesce("reading", "surface")
        new = words.select(
            "surface", F.lit(cost).alias("cost"), F.lit(pos).alias("pos"), F.lit(semantic).alias("semantic"),
            F.when(has_final_consonant(F.col("surface")), "T").otherwise("F").alias("has_jongseong"), reading.alias("reading"),
            *[F.lit("*").alias(f) for f in ("type", "start_pos", "end_pos", "expression")],
        )
        new = self.with_context_ids(new)
        return replace(self, entries=self.entries.join(new.select("surface"), "surface", "left_anti").select(*USER_FIELDS).unionByName(new))

    def adjust_context_ids(self) -> UserDictionary:
        return replace(self, entries=self.with_context_ids(self.entries))

    def adjust_costs(self, cost: int = 1000) -> UserDictionary:
        return replace(self, entries=self.entries.withColumn("cost", F.lit(cost)))
