"""Command line: tag one text with a user dictionary and print its tokens."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="morphlake", description=__doc__)
    parser.add_argument("-t", "--tagger", choices=("extended", "base"), default="extended")
    parser.add_argument("-i", "--input", help="text to tag")
    parser.add_argument("-d", "--dictionary", help="CSV file or folder of dictionary entries")
    parser.add_argument("-w", "--words", help="file of phrases to merge into nouns")
    options = parser.parse_args(arguments)
    if not options.input:
        parser.print_help()
        return 0
    from .operators.analyze import DictionaryAnalyzer
    from .operators.dictionary import Dictionary
    from .operators.merge import extended_tags
    from .sources.wordlists import USER_SCHEMA, load_dictionary, load_user_dictionary

    spark = SparkSession.builder.appName("morphlake").getOrCreate()
    entries = load_user_dictionary(spark, options.dictionary) if options.dictionary else spark.createDataFrame([], USER_SCHEMA)
    docs = spark.createDataFrame([(0, options.input)], "doc_id long, text string").select("doc_id", DictionaryAnalyzer(entries).tagged(F.col("text")).alias("tokens"))
    if options.tagger == "extended":
        words = Dictionary.empty(spark)
        docs = extended_tags(docs, words.add_table(load_dictionary(spark, options.words), "NNG") if options.words else words)
    print([(t["surface"], t["tag"]) for t in docs.first()["tokens"]])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
