"""Readers and writers of word lists, vocabularies, lexicons and user dictionaries.

Every reader returns a DataFrame with a fixed schema; only with ``rewrite`` does it write the list back.
Lines get a number where order or the last of several matters. Saved lists are versioned folders (see
``versions``), which all readers take as they take plain files, so a list may be loaded, changed and saved
under its own name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import strip
from . import versions

USER_FIELDS = ("surface", "left_id", "right_id", "cost", "pos", "semantic", "has_jongseong", "reading", "type", "start_pos", "end_pos", "expression")
POLARITY_SCHEMA = "word string, polarity double, score double, c3 string, c4 string, intensity double"
USER_SCHEMA = ", ".join(f"{f} {'int' if f == 'cost' else 'string'}" for f in USER_FIELDS)
CONTEXT_FIELDS = ("id", "pos", "semantic", "has_jongseong", "reading", "type", "start_pos", "end_pos", "expression")
# Intensity cut-offs and their ceilings by kind of lexicon.
TONE_CUTOFFS = {0: 1.3, 1: 1.1, 3: 1.3, 7: 1.3}
UNCERTAINTY_CUTOFFS = {0: 2.0, 1: 1.3}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line_no, in the order of the file; small text assets only."""
    whole = spark.read.text(versions.current(spark, path), wholetext=True).select(F.split("value", "\r\n|\n|\r").alias("lines"))
    whole = whole.select(F.when(F.element_at("lines", -1) == "", F.slice("lines", 1, F.size("lines") - 1)).otherwise(F.col("lines")).alias("lines"))
    return whole.select(F.posexplode("lines").alias("line_no", "value"))


def _plain(column: Column) -> Column:
    """Stripped, lower-cased, without blanks."""
    return F.replace(F.lower(strip(column)), F.lit(" "), F.lit(""))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(versions.current(spark, path))


def load_dictionary(spark: SparkSession, path: str, rewrite: bool = False) -> DataFrame:
    """Distinct words of a file; a blank line is the empty word. ``rewrite`` writes them back."""
    words = _lines(spark, path).select(_plain(F.col("value")).alias("word")).distinct()
    if rewrite:
        save_wordlist(words, path)
        return load_dictionary(spark, path)
    return words


def load_terms(spark: SparkSession, path: str) -> DataFrame:
    """Distinct terms of a file, stripped and lower-cased; blanks inside them stay."""
    return _lines(spark, path).select(F.lower(strip(F.col("value"))).alias("word")).distinct()


def load_lines(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path).select("line_no", strip(F.col("value")).alias("line"))


def vocab_from(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """Mapping (src, dst) of lines (line_no, value): further fields are dropped, the last of equal src wins."""
    part = lambda n: _plain(F.split_part("value", F.lit(delimiter), F.lit(n)))
    rows = lines.where(F.contains("value", F.lit(delimiter))).select("line_no", part(1).alias("src"), part(2).alias("dst"))
    return rows.groupBy("src").agg(F.max_by("dst", "line_no").alias("dst"))


def load_vocab(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    return vocab_from(numbered_lines(spark, path), delimiter)


def save_vocab(vocab: DataFrame, path: str, delimiter: str = ",") -> None:
    """A line for each pair (src, dst); a null side is written as nothing."""
    line = F.concat(F.coalesce("src", F.lit("")), F.lit(delimiter), F.coalesce("dst", F.lit("")))
    versions.write(vocab.select(line.alias("value")), path, "text")


def save_wordlist(words: DataFrame, path: str) -> None:
    versions.write(words.select(F.coalesce(words[words.columns[0]], F.lit("")).alias("value")), path, "text")


def _uncommented(words: DataFrame, lowercase: bool) -> DataFrame:
    words = words.where(~F.startswith("word", F.lit("#")))
    return words.select(F.lower("word").alias("word")) if lowercase else words


def wordlist_from(lines: DataFrame, lowercase: bool = False, **options) -> DataFrame:
    """First field of each line (value), distinct, without comments; options as in :func:`_listed`."""
    return _uncommented(_listed(lines, **options), lowercase)


def _listed(lines: DataFrame, max_ngram: int | None = None, remove_tag: bool = False, remove_delimiter: bool = False) -> DataFrame:
    """First field of each line (value), distinct.

    Blank lines drop out and, unless tags are removed, lines of one letter. The ``;`` is removed before the length in units is tested, so both options together keep all.
    """
    line = strip(F.col("value"))
    rows = lines.where(F.length(line) > (0 if remove_tag else 1)).select(F.get(F.split(line, r"(?U)\s+"), F.lit(0)).alias("word"))
    if remove_tag:
        rows = rows.select(F.substring_index("word", "/", 1).alias("word"))
    if remove_delimiter:
        rows = rows.select(F.replace("word", F.lit(";"), F.lit("")).alias("word"))
    if max_ngram:
        rows = rows.where(F.size(F.split("word", ";")) <= max_ngram)
    return rows.distinct()


def load_wordlist(spark: SparkSession, path: str, rewrite: bool = False, lowercase: bool = False, **options) -> DataFrame:
    """In order of the words. ``rewrite`` writes them back as they are, comments among them, before small letters are made."""
    words = _listed(_lines(spark, path), **options)
    if rewrite:
        save_wordlist(words, path)
        words = _lines(spark, path).select(F.col("value").alias("word"))
    return _uncommented(words, lowercase).orderBy("word")


def fields_from(lines: DataFrame) -> DataFrame:
    """token and value: the first two fields of each line (line_no, value), the last line of equal tokens; words of one letter are kept."""
    fields = F.split(strip(F.col("value")), r"(?U)\s+")
    rows = lines.select("line_no", F.get(fields, F.lit(0)).alias("token"), F.get(fields, F.lit(1)).alias("second")).where(F.length("token") > 0)
    return rows.groupBy("token").agg(F.max_by("second", "line_no").alias("value"))


def load_fields(spark: SparkSession, path: str) -> DataFrame:
    return fields_from(numbered_lines(spark, path))


def load_wordset(spark: SparkSession, path: str) -> DataFrame:
    return load_fields(spark, path).where(F.length("token") > 1).select("token").distinct()


def polarity_lexicon(rows: DataFrame, kind: int = 0, cutoff: float | None = None, cutoffs: dict[int, float] = TONE_CUTOFFS, ceiling: float = 2.0) -> DataFrame:
    """Lexicon (term, pos, neg, pol) of rows (word, polarity, score, intensity) beyond a cut-off."""
    least = min(ceiling, cutoffs.get(kind, cutoffs[0]) if cutoff is None else cutoff)
    kept = rows.where((F.length("word") > 1) & (F.col("intensity") > least) & (F.col("word") != "word"))
    return kept.select(F.col("word").alias("term"), F.when(F.col("polarity") > 0, 1).alias("pos"), F.when(F.col("polarity") < 0, -1).alias("neg"), F.col("score").alias("pol"))


def uncertainty_lexicon(rows: DataFrame, kind: int = 0, cutoff: float | None = None) -> DataFrame:
    """As :func:`polarity_lexicon`, with the cut-offs and the ceiling of uncertainty lexicons."""
    return polarity_lexicon(rows, kind, cutoff, UNCERTAINTY_CUTOFFS, 3.0)


def load_uncertainty_lexicon(spark: SparkSession, path: str, **options) -> DataFrame:
    return uncertainty_lexicon(spark.read.schema(POLARITY_SCHEMA).csv(path), **options)


def load_polarity_lexicon(spark: SparkSession, path: str, **options) -> DataFrame:
    return polarity_lexicon(spark.read.schema(POLARITY_SCHEMA).csv(path), **options)


def class_lexicon(rows: DataFrame) -> DataFrame:
    """Lexicon of rows (ngram, neg_share, pos_share): by count the sign of the difference, by value the
    difference; equal shares drop out."""
    value = F.col("pos_share") - F.col("neg_share")
    kept = rows.where((F.length("ngram") > 1) & (value != 0))
    return kept.select(F.col("ngram").alias("term"), F.when(value > 0, 1).alias("pos"), F.when(value < 0, -1).alias("neg"), value.alias("pol"))


def load_class_lexicon(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("ngram string, c1 string, c2 string, neg_share double, c4 string, c5 string, pos_share double").csv(path)
    return class_lexicon(raw)


def class_table(rows: DataFrame) -> DataFrame:
    """Rows (line_no, ngram, a share for each class after it) without line numbers, the last of equal n-grams."""
    classes = [c for c in rows.columns if c not in ("line_no", "ngram")]
    last = rows.groupBy("ngram").agg(F.max_by(F.struct(*[F.col(f"`{c}`").cast("double").alias(c) for c in classes]), "line_no").alias("shares"))
    return last.select("ngram", "shares.*")


def load_class_table(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header, ``ngram`` first and a share for each class after it; the last of equal n-grams."""
    raw = spark.read.option("header", True).csv(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return class_table(raw.withColumn("line_no", place).withColumnRenamed(raw.columns[0], "ngram"))


def load_harvard(spark: SparkSession, path: str) -> DataFrame:
    """word, positive and negative of a table with a header (Entry, Positiv, Negativ), which names its own class."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col("Entry").alias("word"), F.coalesce(F.col("Positiv") == "Positiv", F.lit(False)).alias("positive"), F.coalesce(F.col("Negativ") == "Negativ", F.lit(False)).alias("negative"))


def load_finance(spark: SparkSession, path: str) -> DataFrame:
    """word, positive and negative of a table with a header (Word, Positive, Negative), years above zero for members."""
    rows = spark.read.option("header", True).csv(path)
    member = lambda c: F.coalesce(F.col(c).cast("double") > 0, F.lit(False))
    return rows.select(F.col("Word").alias("word"), member("Positive").alias("positive"), member("Negative").alias("negative"))


def load_stoplist(spark: SparkSession, path: str) -> DataFrame:
    """First word of each line of Latin-1 files, lower-cased and stemmed."""
    from ..functions.porter import stem_column

    files = spark.read.format("binaryFile").load(path)
    lines = files.select(F.explode(F.split(F.decode("content", "ISO-8859-1"), "\n")).alias("line"))
    words = lines.select(F.lower(F.regexp_extract("line", r"(?U)(\w+)", 1)).alias("word")).where("word <> ''").distinct()
    return words.select(stem_column("word").alias("stem")).distinct()


def load_user_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Entries of one CSV file or of the ``*.csv`` files of a folder; of equal surfaces the last row is taken."""
    path = versions.current(spark, path)
    reader = spark.read.schema(USER_SCHEMA)
    reader = reader.option("pathGlobFilter", "*.csv") if versions.is_folder(spark, path) else reader
    rows = reader.csv(path).withColumn("file", F.col("_metadata.file_path")).withColumn("place", F.monotonically_increasing_id())
    last = rows.groupBy("surface").agg(F.max_by(F.struct(*[F.col(f) for f in USER_FIELDS]), F.struct("file", "place")).alias("e"))
    return last.select("e.*")


def save_user_dictionary(entries: DataFrame, path: str) -> None:
    versions.write(entries.select(*USER_FIELDS), path, "csv")


def load_context_ids(spark: SparkSession, path: str) -> DataFrame:
    """line_no and the nine fields of lines ``id feature,feature...``."""
    features = F.split(F.split_part("value", F.lit(" "), F.lit(2)), ",")
    rows = numbered_lines(spark, path).where(F.contains("value", F.lit(" ")))
    return rows.select("line_no", F.split_part("value", F.lit(" "), F.lit(1)).alias("id"), *[F.get(features, F.lit(i)).alias(f) for i, f in enumerate(CONTEXT_FIELDS[1:])])
