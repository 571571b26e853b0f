"""Language of web pages by Bayesian fusion of evidence.

Three kinds of evidence are multiplied for each page: the likelihood of its text under hashed byte
trigrams of each language, the likelihood of the language that its markup declares, and a prior of
its address. Rates of declarations and priors come from all other pages: the mean text posterior of
the host is smoothed by that of its domain, this by that of the address suffix, and this by that of
all pages, each sum without the page itself. All sums are grouped aggregations with partial sums
before the shuffle; those of hosts and domains are written out, so that Spark can split the
partition of a host with very many pages when it joins them back.

The trigram tables are learned from all rows of a labelled table (text, lang), for every language in
it. Their size is TRIGRAMS times the number of languages; over LANGUAGES of them are refused.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

TRIGRAMS = 1 << 15
#: Languages up to which the table of log probabilities (64 MB) fits into every task.
LANGUAGES = 256
#: Trigrams that a text counts for at most; neighbouring trigrams are far from independent.
EVIDENCE = 40.0
#: Pages that the level above counts for when a level is smoothed.
STRENGTH = 4.0
#: Share of pages expected to declare their own language, before any are seen; that counts as one page.
RIGHT = 0.5
_DROP = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


def visible_text(source: str | None) -> str:
    """Page source without comments, scripts, styles and tags, entities resolved."""
    return markup.unescape(_DROP.sub(" ", source or ""))


def _buckets(text: str) -> np.ndarray:
    x = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "ignore"), np.uint8).astype(np.int64)
    h = x[:-2] * 7919 + x[1:-1] * 104729 + x[2:] * 1299709
    return (h >> 3) % TRIGRAMS


def _trigram_counts(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in sums:
                sums[lang] = np.zeros(TRIGRAMS, np.int64)
            sums[lang] += np.bincount(_buckets(text or ""), minlength=TRIGRAMS)
        for lang, n in sums.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used), pa.array(n[used])], names=["lang", "bucket", "n"])


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and the log probability of each trigram bucket in each."""
    rows = labelled.where("lang is not null").select("lang", F.col("text").cast("string").alias("text"))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(langs) > LANGUAGES:
        raise ValueError(f"the labelled table has more than {LANGUAGES} languages")
    place = {lang: k for k, lang in enumerate(langs)}
    table = np.full((TRIGRAMS, len(langs)), 0.5)
    counts = rows.mapInArrow(_trigram_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow() if langs else None
    if found is not None and found.num_rows:
        table[found["bucket"].to_numpy(), [place[x] for x in found["lang"].to_pylist()]] += found["n"].to_numpy()
    return langs, np.log(table / table.sum(0))


def _likelihoods(langs: list[str], table: np.ndarray):
    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, len(langs)))
            for k, source in enumerate(batch.column(1).to_pylist()):
                found = _buckets(visible_text(source))
                if len(found) and langs:
                    sums = table[found].sum(0) * min(1.0, EVIDENCE / len(found))
                    p = np.exp(sums - sums.max())
                    out[k] = p / p.sum()
                else:
                    out[k] = 1 / max(1, len(langs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.tolist(), pa.list_(pa.float64()))], names=["row", "text_p"])

    return run


def host_of(url: Column) -> Column:
    """Host name in lower case, without user, port and final dot; empty if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.regexp_replace(host, r"\.$", "")


def domain_of(host: Column) -> Column:
    """The last two labels of a host; three where these are a short label before a country's, as in ``co.uk``."""
    labels = F.split(host, r"\.")
    last = lambda n: F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)))
    shared = (F.length(F.element_at(labels, -1)) == 2) & (F.length(F.try_element_at(labels, F.lit(-2))) <= 3) & (F.size(labels) > 2)
    return F.when(shared, last(3)).otherwise(last(2))


def declared_language(source: Column) -> Column:
    """Primary tag of the lang attribute of the html element, in lower case; null if there is none."""
    found = F.regexp_extract(F.coalesce(source.cast("string"), F.lit("")), r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})\b", 1)
    return F.nullif(F.lower(found), F.lit(""))


def identify(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, host, declared, text_lang, lang and probability of every row of ``pages`` (page_id, url, html).

    A null or empty page has no text or markup evidence and takes the prior of its address; a null or
    odd address has the empty host. Ties go to the language first in order of name. Repeated rows are
    each returned and each count as a page. Without labelled rows no language is known and the
    results are null. An empty table gives no rows; other columns are not read.
    """
    langs, table = train(labelled)
    n = len(langs)
    host = host_of(F.col("url"))
    rows = bounded_batches(pages).select(
        F.struct("page_id", host.alias("host"), domain_of(host).alias("domain"), F.element_at(F.split(host, r"\."), -1).alias("suffix"), declared_language(F.col("html")).alias("declared")).alias("row"),
        F.col("html").cast("string").alias("html"),
    )
    found = rows.mapInArrow(_likelihoods(langs, table), f"row {rows.schema['row'].dataType.simpleString()}, text_p array<double>")
    found = materialize(found.select("row.*", *[F.get("text_p", F.lit(k)).alias(f"p{k}") for k in range(n)]), "language-text")
    if not n:
        return found.select("page_id", "host", "declared", *[F.lit(None).cast("string").alias(c) for c in ("text_lang", "lang")], F.lit(None).cast("double").alias("probability"))
    p = [f"p{k}" for k in range(n)]

    def sums(*keys: str) -> DataFrame:
        name = keys[0] if keys else "all"
        return found.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), *[F.sum(x).alias(f"{name}_{x}") for x in p])

    total = sums().first().asDict()
    joined = found.join(sums("suffix"), "suffix").join(materialize(sums("domain"), "language-domains"), "domain").join(materialize(sums("host"), "language-hosts"), "host")
    level = [F.lit((total[f"all_{x}"] or 0.0)) - F.col(x) for x in p]
    size = F.lit(total["n_all"] - 1)
    level = [(x + STRENGTH / n) / (size + STRENGTH) for x in level]
    for name in ("suffix", "domain", "host"):
        level = [(F.col(f"{name}_{x}") - F.col(x) + STRENGTH * above) / (F.col(f"n_{name}") - 1 + STRENGTH) for x, above in zip(p, level, strict=True)]
    # P(declared | language), without the page itself; declarations of languages that are not told apart are one.
    group = F.when(F.col("declared").isNull(), "none").when(F.col("declared").isin(langs), F.col("declared")).otherwise("other language")
    by_declared = found.groupBy(group.alias("group")).agg(F.array(*[F.sum(x) for x in p]).alias("sums"))  # a row a language and two more
    joined = joined.withColumn("group", group).join(F.broadcast(by_declared), "group")
    before = [F.when(F.col("group") == lang, F.lit(RIGHT)).otherwise((1 - RIGHT) / (n + 1)) for lang in langs]
    said = [(F.get("sums", F.lit(k)) - F.col(x) + before[k]) / (F.lit(total[f"all_{x}"] or 0.0) - F.col(x) + 1.0) for k, x in enumerate(p)]
    joint = joined.select("page_id", "host", "declared", *p, *[(F.greatest(F.col(x), F.lit(1e-12)) * s * F.greatest(prior, F.lit(1e-12))).alias(f"q{k}") for k, (x, s, prior) in enumerate(zip(p, said, level, strict=True))])
    q = [f"q{k}" for k in range(n)]

    def best(columns: list[str]) -> Column:
        top = F.greatest(*columns) if n > 1 else F.col(columns[0])
        return F.coalesce(*[F.when(F.col(c) == top, F.lit(lang)) for c, lang in zip(columns, langs, strict=True)])

    whole = sum((F.col(c) for c in q[1:]), F.col(q[0]))
    return joint.select("page_id", "host", "declared", best(p).alias("text_lang"), best(q).alias("lang"), ((F.greatest(*q) if n > 1 else F.col(q[0])) / whole).alias("probability"))
