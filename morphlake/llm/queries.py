"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import hard_negatives, iblt, language_id, maxent_lm, packing, quality_cnn, quality_rules, ranked_search, reply_trees, simhash, suffix_dedup
from .bpe_codec import encode_documents
from .common import table
from .token_counts import token_counts


def op1_maxent_lm(spark, sf_dir):
    return maxent_lm.score_documents(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents").select("text", "lang"))


def op4_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_bpe_codec(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_quality_cnn(spark, sf_dir):
    return quality_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_iblt(spark, sf_dir):
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark, sf_dir):
    return ranked_search.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_reply_trees(spark, sf_dir):
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return reply_trees.digests(reply_trees.format_chains(rows))


def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


# The parts of operators that SQL can say, each from the operator's own rows.


def lm_counts(spark, sf_dir):
    """Columns of operator 1 that counts decide."""
    rows = op1_maxent_lm(spark, sf_dir)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"))


def rules_counts(spark, sf_dir):
    """Columns of operator 4 that counts decide."""
    return op4_quality_rules(spark, sf_dir).drop("posterior", "kept")


def sketch_likeness(spark, sf_dir):
    """Columns of operator 10 but for the fingerprints, whose hash SQL lacks."""
    rows = op10_iblt(spark, sf_dir)
    return rows.select("doc_id", "n_chars", "edited_sha256", *[F.round(c, 9).alias(c) for c in ("near_edited", "near_next")])


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_maxent_lm": op1_maxent_lm,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_counts": op5_token_counts,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_quality_cnn": op7_quality_cnn,
    "op8_packing": op8_packing,
    "op9_simhash": op9_simhash,
    "op10_iblt": op10_iblt,
    "op11_ranked_search": op11_ranked_search,
    "op12_reply_trees": op12_reply_trees,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": pipeline,
    "lm_counts": lm_counts,
    "rules_counts": rules_counts,
    "sketch_likeness": sketch_likeness,
}

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"
#: The table of crc32, then the remainder of the crc32 of an id as text by ``modulus``.
_CRC = "RECURSIVE bits AS (SELECT range AS i, range AS v, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8), crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8)"
_FOLD = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, x: xor(a >> 8, t[CAST(xor(a, x) & 255 AS INTEGER) + 1])), 4294967295) % {modulus}"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "lm_counts": f"WITH {_CRC}, d AS (SELECT doc_id, {_FOLD.format(modulus=7)} = 2 AS held_out, list_append({_WORDS.replace("coalesce(text, '')", _LOWER)}, '') AS l FROM documents, crc), "
    "t AS (SELECT doc_id, held_out, unnest(l) AS w FROM d), c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w), z AS (SELECT sum(c) AS n, count(*) AS v FROM c) "
    "SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / CAST(n + v + 1 AS DOUBLE))), 5) AS base_score "
    "FROM t LEFT JOIN c USING (w), z GROUP BY doc_id, held_out",
    "op2_suffix_dedup": "WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), d2 AS (SELECT doc_id, x, length(x) // 2 AS n FROM d), "
    "w AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS k FROM d2, unnest(range(n - 99)) AS r(p)), "
    "e AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS place FROM w), r AS (SELECT doc_id, p FROM e WHERE place > 1), "
    "g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM r), i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g), "
    "s AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, run), "
    "cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM s), "
    "k AS (SELECT cut.doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, string_agg(substr(x, CAST(2 * since + 1 AS BIGINT), CAST(2 * (a - since) AS BIGINT)), '' ORDER BY a) AS head, max(b) AS last FROM cut JOIN d2 USING (doc_id) GROUP BY cut.doc_id) "
    "SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM d2 LEFT JOIN k USING (doc_id)",
    "rules_counts": f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS l FROM documents), g AS (SELECT doc_id, p, list_slice(l, p + 1, p + 8) AS run FROM d, unnest(range(len(l) - 7)) AS r(p)), "
    "m AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, run) AS n FROM g) WHERE n > 1), c AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM m, unnest(range(8)) AS r(o) GROUP BY doc_id), "
    "s AS (SELECT doc_id, line FROM d, unnest(string_split(text, chr(10))) AS u(line) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')), "
    "y AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM s GROUP BY doc_id) "
    "SELECT d.doc_id, len(l) AS n_words, length(list_aggregate(l, 'string_agg', '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, "
    "len(l) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(l) AS base_failed FROM d LEFT JOIN c USING (doc_id) LEFT JOIN y USING (doc_id)",
    "sketch_likeness": "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS o FROM d), "
    "e AS (SELECT doc_id, t, o, left(t, length(t) - length(t) // 3) || left(o, length(t) // 3) AS x FROM n), "
    "p AS (SELECT *, list_distinct(regexp_extract_all(t, '[^\\n]{1,256}')) AS a, list_distinct(regexp_extract_all(x, '[^\\n]{1,256}')) AS b, list_distinct(regexp_extract_all(o, '[^\\n]{1,256}')) AS c FROM e) "
    "SELECT doc_id, length(t) AS n_chars, sha256(x) AS edited_sha256, round(CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE 2 * len(list_intersect(a, b)) / CAST(len(a) + len(b) AS DOUBLE) END, 9) AS near_edited, "
    "round(CASE WHEN len(a) + len(c) = 0 THEN 1 ELSE 2 * len(list_intersect(a, c)) / CAST(len(a) + len(c) AS DOUBLE) END, 9) AS near_next FROM p",
    "op11_ranked_search": r"WITH t AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM documents), "
    r"q AS (SELECT item_id, w, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY ALL), "
    "z AS (SELECT count(*) AS docs, CAST(sum(len(l)) AS BIGINT) AS terms FROM t WHERE len(l) > 0), p AS (SELECT k, doc_id, w, count(*) AS tf, any_value(n) AS n FROM (SELECT k, doc_id, len(l) AS n, unnest(l) AS w FROM t) SEMI JOIN q USING (w) GROUP BY k, doc_id, w), "
    "v AS (SELECT w, CAST(floor(1000 * ln((2.0E0 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS v FROM p, z GROUP BY w), "
    "s AS (SELECT item_id, k, doc_id, CAST(sum(times * v * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN p USING (w) JOIN v USING (w), z GROUP BY item_id, k, doc_id), "
    "r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0) SELECT * FROM r WHERE rank <= 20",
    "op12_reply_trees": r"WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, n, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(n, role)) "
    r"SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, "
    r"sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id",
    "op13_hard_negatives": "WITH e AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings "
    "WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
    "s AS (SELECT a.k AS a, a.vec_id AS anchor_id, b.vec_id AS vec_id, b.k AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.k <> b.k), "
    "p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5), "
    "n AS (SELECT p.a, p.b, p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score "
    "FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score) SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5",
}
