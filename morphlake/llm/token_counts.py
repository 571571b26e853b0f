"""Token counts through a digest cache.

Each text is identified by the digest of its normalised content and the digest of the tokenizer
file. Stored counts are joined by both digests; of the digests that miss, one text each is encoded
and the counts are appended to the cache. Byte-level tokenizers have no normaliser, so normalised
content is the text itself, with null as the empty text.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, materialize, remove_at_exit

CACHE_SCHEMA = "content binary, tokenizer binary, n_tokens long"
#: The pattern by which byte-level tokenizers of this family cut a text.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_COUNTERS: dict[str, object] = {}


def byte_alphabet() -> dict[str, int]:
    """Character by which a byte-level vocabulary file writes each byte: printable Latin-1 bytes
    stand for themselves, the others take the code points from 256 on, in order."""
    kept = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class JsonCounter:
    """Counts the tokens that the tokenizers library finds.

    A byte-level BPE file whose ids follow the order of its merges is encoded by tiktoken, which
    gives the same ids some five times as fast; any other file by the tokenizers library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        plain_added = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in spec["added_tokens"])
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if set(token) <= alphabet.keys()}
        merged = [model["vocab"].get("".join(pair if isinstance(pair, list) else pair.split(" "))) for pair in model["merges"]]
        if (
            model["type"] == "BPE"
            and spec["normalizer"] is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex")
            and not before.get("add_prefix_space")
            and not any(model[k] for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and plain_added
            and len(ranks) == len([t for t in model["vocab"] if t not in added])
            and None not in merged
            and merged == sorted(merged)
        ):
            import tiktoken

            self.fast = tiktoken.Encoding("counter", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def count(self, texts: list[str]) -> list[int]:
        return [self._one(text) for text in texts]

    def _one(self, text: str) -> int:
        if self.fast is not None:
            try:
                return len(self.fast.encode(text, allowed_special="all"))
            except BaseException as error:  # the pattern engine gives up on some huge runs
                if isinstance(error, (KeyboardInterrupt, SystemExit)):
                    raise
        return len(self.library.encode(text, add_special_tokens=False).ids)


class PieceCounter:
    """Counts the pieces of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


def counter(path: str):
    """The counter of a tokenizer file, one per Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path) if path.endswith(".model") else JsonCounter(path)
    return _COUNTERS[path]


def tokenizer_digest(path: str) -> bytes:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).digest()


def _encode(path: str, version: bytes):
    def encode(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = counter(path)
        done: set[bytes] = set()  # of this partition: repeated rows of an owner meet here
        for batch in batches:
            new: dict[bytes, str] = {}
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest not in done:
                    new.setdefault(digest, text)
            done.update(new)
            n = own.count(list(new.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(new), pa.binary()), pa.array([version] * len(new), pa.binary()), pa.array(n, pa.int64())],
                names=["content", "tokenizer", "n_tokens"],
            )

    return encode


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` (doc_id, text).

    Null texts count as empty; repeated rows are each returned, and encoded once where Spark does not
    split their partition; an empty table gives no rows; other columns of ``docs`` are ignored. Distinct texts that the cache under
    ``cache_path`` lacks are encoded once and appended to it when this function is called; without
    a path, a fresh cache is made in the shared folder.

    The texts are shuffled once, by the id that represents a digest, so no group of copies meets in
    one task; all other shuffles carry digests and counts only. The counts are written out before
    they are joined to all copies, so that Spark can split the partition of a digest with many.
    """
    spark = docs.sparkSession
    own_cache, cache_path = not cache_path, cache_path or fresh_path(spark, "token-cache")
    version = tokenizer_digest(tokenizer_path)
    keyed = bounded_batches(docs).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("content")
    )
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    if own_cache:
        remove_at_exit(spark, cache_path)

    def stored():
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == F.lit(version))
        return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    distinct = keyed.groupBy("content").agg(F.min("doc_id").alias("owner"))
    misses = distinct.join(stored().select("content"), "content", "left_anti").withColumnRenamed("content", "missing")
    texts = keyed.join(misses.hint("shuffle_hash"), keyed.doc_id.eqNullSafe(misses.owner) & (keyed.content == misses.missing)).select("content", "text")
    texts.mapInArrow(_encode(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = materialize(stored(), "token-counts")
    return keyed.drop("text").join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
