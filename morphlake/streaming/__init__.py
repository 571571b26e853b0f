"""Streams of documents: row-local operators run on them as they are, without state.

Operators that regroup exploded tokens would need state; on a stream they run a micro-batch at a
time by ``in_batches``. Lexicon scores add up, so documents that arrive in parts are scored as they
grow: ``running_scores`` keeps their sums as the state of one query with a fixed lexicon, and
``score_parts`` writes the sums of each batch with the lexicon as it is then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import lexicon
from ..sources import versions


def read_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def write(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet what has arrived, exactly once, then stop."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_batches(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch operator to each micro-batch; a batch that is run again overwrites its own folder."""

    def run(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_scores(stream: DataFrame, words: DataFrame, by_count: bool = True) -> DataFrame:
    """Scores of the documents of a stream (doc_id, terms) as far as their parts have come, for output mode
    ``update`` or ``complete``. The state is four numbers a document; ``words`` is a static lexicon."""
    return lexicon.from_sums(lexicon.partial_sums(stream, words, by_count), by_count)


def add_parts(parts: DataFrame, words: DataFrame, folder: str, number: int, by_count: bool = True) -> None:
    """Write the sums of a batch of parts (doc_id, terms); a batch that is run again overwrites its own."""
    lexicon.partial_sums(parts, words, by_count).write.mode("overwrite").parquet(f"{folder}/batch={number}")


def score_parts(stream: DataFrame, lexicon_path: str, folder: str, checkpoint: str, by_count: bool = True) -> StreamingQuery:
    """Score the parts of a stream (doc_id, terms), each with the lexicon (term, pos, neg, pol) that its batch finds.

    The lexicon is a versioned table: a batch reads the state of its beginning, the next one that which has
    been written since. :func:`scores` gives the documents' scores.
    """

    def run(batch: DataFrame, number: int) -> None:
        add_parts(batch, versions.read(batch.sparkSession, lexicon_path), folder, number, by_count)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scores(spark: SparkSession, folder: str, by_count: bool = True) -> DataFrame:
    """Scores of all documents from the sums of their parts."""
    sums = spark.read.parquet(folder).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in lexicon.SUMS])
    return lexicon.from_sums(sums, by_count)
