"""Documents are worked on where they lie, a few at a time, and give what joins give."""

from pyspark.sql import functions as F

from morphlake.functions import tokens as K
from morphlake.operators import lexicon, rewrite
from morphlake.operators.phrases import map_tokens
from morphlake.plans import catalogue

TERMS = "doc_id long, terms array<string>"
TOKENS = "doc_id long, tokens array<struct<surface:string,tag:string>>"
DOCS = [(1, [("a", "NNG"), ("b", "VV"), (".", "SF"), ("c", None), (None, "NNG"), ("a", "VV")]), (1, [("b", "VV"), ("a", "NNG"), ("b", "VV")]), (2, []), (None, [("a", "MAG"), ("d", "NNG")])]


def plain(rows):
    return sorted((str(r.asDict(recursive=True)) for r in rows.collect()))


def moves(rows):
    return "Exchange" in rows._jdf.queryExecution().executedPlan().toString()


def test_terms_and_scores_move_no_token(spark):
    docs = spark.createDataFrame(DOCS, TOKENS)
    vocab = spark.createDataFrame([("a/NNG",), ("b/VV;a/NNG",), ("a/NNG;b/VV",), ("d/NNG",), (None,)], "term string")
    terms = spark.createDataFrame([(1, ["x", "y", None, "x"]), (1, ["z"]), (2, []), (None, None)], TERMS)
    words = spark.createDataFrame([("x", 1, None, 0.25), ("y", None, -1, -0.5), ("z", None, None, None)], "term string, pos int, neg int, pol double")
    for run in (
        lambda limit: lexicon.general_terms(docs, vocab, limit=limit), lambda limit: lexicon.only_known(terms, words, limit=limit), lambda limit: lexicon.score(terms, words, with_breakdown=True, limit=limit),
        lambda limit: lexicon.score(terms, words, by_count=False, limit=limit),
    ):
        assert plain(run(None)) == plain(run(0)) and not moves(run(None)) and moves(run(0))
    twice = words.union(words.where("term = 'x'"))  # joined, as each entry counts
    assert plain(lexicon.score(terms, twice)) == plain(lexicon.score(terms, twice, limit=0))


def test_postprocessing_moves_no_token(spark):
    docs = spark.createDataFrame(DOCS, TOKENS)
    entries = spark.createDataFrame([("a", "NNG"), ("b", None), ("d", "VV")], "word string, tag string")
    new = entries.withColumns({"new_word": F.when(F.col("word") != "b", F.upper("word")), "new_tag": F.when(F.col("tag").isNotNull(), "NNP")})
    for options in ({"stopwords": entries}, {"passwords": entries}, {"passtags": ("NNG",)}, {"replacements": new}, {"stopwords": entries.where("word = 'd'"), "passwords": entries, "passtags": ("VV", "NNG"), "replacements": new}):
        assert plain(rewrite.postprocessed(docs, **options)) == plain(rewrite.postprocessed(docs, **options, limit=0))
        assert not moves(rewrite.postprocessed(docs, **options))
    double = new.union(new.where("word = 'b'").withColumn("new_word", F.lit("q")))
    assert plain(rewrite.postprocessed(docs, replacements=double)) == plain(rewrite.postprocessed(docs, replacements=double, limit=0))


def test_phrases_in_one_pass(spark):
    docs = spark.createDataFrame([(1, ["a/X", "b/Y", "c", "d/X/Y", "e;f/X", "g/Z"]), (2, []), (3, ["a/X"]), (4, ["a/X", None, "b/Y"])], TERMS)
    for low, high in ((2, 2), (1, 3)):
        assert plain(K.with_phrases(docs, low, high)) == plain(docs.select("doc_id", F.transform(K.ngrams(F.col("terms"), low, high), K.phrase).alias("terms")))


def test_large_row_groups_are_dealt_out(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}"
    spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(f"{path}/documents.parquet")
    monkeypatch.setattr(catalogue, "PART_BYTES", 4 << 10)
    assert catalogue.slashed(spark, path).rdd.getNumPartitions() > 40


def test_batches_are_small(spark):
    fresh = spark.newSession()
    rows = map_tokens(fresh.range(5000).select(F.col("id").alias("doc_id"), F.array(K.pair(F.lit("a"), F.lit("NNG"))).alias("tokens")), lambda s, t: (s, t))
    assert int(fresh.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert rows.count() == 5000
