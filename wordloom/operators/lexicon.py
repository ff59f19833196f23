"""Dictionary ETL: raw entries to word rows, with inflections resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.text import all_empty, all_exchange_pairs, is_single_word, leading_pos, pos_with_dot, split_lines, tags, trim
from wordloom.sources.jdbc import read_source


def clean(raw: DataFrame) -> DataFrame:
    """Single words with something said of them; ``ordinal`` gives the source's order."""
    r = raw.withColumn("word", trim(F.coalesce("word", F.lit(""))))
    return r.filter((F.col("word") != "") & is_single_word(F.col("word")) & ~all_empty(*(F.col(c) for c in ("phonetic", "definition", "translation", "tag", "exchange"))))


#: Columns of a dictionary source, all strings.
SOURCE_COLUMNS = ["word", "phonetic", "definition", "pos", "translation", "exchange", "tag"]


def load_source(spark: SparkSession, dsn: str, table: str = "stardict") -> DataFrame:
    """A dictionary from any data source, with its columns checked; ``ordinal`` is the source's own or the order of reading."""
    raw = read_source(spark, dsn, table)
    if missing := [c for c in SOURCE_COLUMNS if c not in raw.columns]:
        raise ValueError(f"the dictionary lacks the columns {', '.join(missing)}")
    ordinal = F.col("ordinal").cast("long") if "ordinal" in raw.columns else F.monotonically_increasing_id()
    return raw.select(*(F.col(c).cast("string").alias(c) for c in SOURCE_COLUMNS), ordinal.alias("ordinal"))


def inflections(entries: DataFrame) -> DataFrame:
    """``(form, lemma, form_type)``: for each form the first entry that names it; ``0`` pairs and an entry's own word name no form."""
    pairs = entries.select(F.col("word").alias("lemma"), "ordinal", F.posexplode(all_exchange_pairs(F.col("exchange"))).alias("at", "pair"))
    named = pairs.where((F.col("pair.code") != "lemma") & (F.lower("pair.word") != F.lower("lemma"))).select(F.lower("pair.word").alias("form"), "lemma", F.col("pair.code").alias("code"), "ordinal", "at")
    return named.groupBy("form").agg(F.min_by(F.struct("lemma", "code"), F.struct("ordinal", "at")).alias("m")).select("form", F.col("m.lemma").alias("lemma"), F.col("m.code").alias("form_type"))


def meanings(column: str, language: str):
    def one(line):
        p = leading_pos(line)
        return F.struct(pos_with_dot(p["pos"]).alias("pos"), trim(p["rest"]).alias("text"), F.lit(language).alias("language"))

    return F.filter(F.transform(split_lines(F.col(column)), one), lambda m: m["text"] != "")


def build_words(raw: DataFrame) -> DataFrame:
    """Word rows, one for each (language, text, word_type); the last entry wins."""
    entries = clean(raw)
    joined = entries.withColumn("form", F.lower("word")).join(inflections(entries).withColumnRenamed("lemma", "base"), "form", "left")
    bent = F.col("base").isNotNull() & (F.lower("base") != F.col("form"))
    phonetic = trim(F.coalesce("phonetic", F.lit("")))
    rows = joined.select(
        F.col("word").alias("text"), F.lit("en").alias("language"), F.when(bent, F.col("form_type")).otherwise("lemma").alias("word_type"), F.when(bent, F.col("base")).alias("lemma"),
        F.when(phonetic != "", F.array(F.struct(phonetic.alias("ipa"), F.lit("en-US").alias("dialect")))).otherwise(F.array().cast("array<struct<ipa:string,dialect:string>>")).alias("phonetics"),
        F.concat(meanings("definition", "en"), meanings("translation", "zh")).alias("meanings"), tags(F.col("tag")).alias("tags"), "ordinal",
    ).where((F.size("meanings") > 0) | (F.size("phonetics") > 0))
    keys = ["text", "language", "word_type"]
    rest = ["lemma", "phonetics", "meanings", "tags"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ordinal").alias("r"))
    return last.select(*keys, *(F.col("r")[c].alias(c) for c in rest))
