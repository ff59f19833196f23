"""Column functions on words and dictionary lines; all stay in the JVM."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType

# Parts of speech, inflection codes, languages.
POS_TAGS = ["vt", "vi", "adj", "adv", "prep", "pron", "conj", "interj", "int", "num", "art", "aux", "abbr", "pref", "suf", "noun", "n", "v"]
EXCHANGE_CODES = {"p": "past", "d": "pp", "i": "ing", "3": "3sg", "r": "comparative", "t": "superlative", "s": "plural", "0": "lemma", "1": "variant"}
LANGUAGES = ["en", "zh", "es", "fr", "de", "ja", "ko"]
LANGUAGE_ENUM = {"unspecified": "", "english": "en", "chinese": "zh", "spanish": "es", "french": "fr", "german": "de", "japanese": "ja", "korean": "ko"}
POS_LINE = rf"(?i)^({'|'.join(POS_TAGS)})(?=[. \t])\.?\s*(.*)$"


def trim(c: Column) -> Column:
    """Strip white space of any kind (the built-in trim strips spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def equal_fold(c: Column, text: str | Column) -> Column:
    return F.lower(c) == F.lower(F.lit(text) if isinstance(text, str) else text)


def contains_fold(c: Column, text: str) -> Column:
    return F.contains(F.lower(c), F.lower(F.lit(text)))


def is_single_word(c: Column) -> Column:
    return ~c.rlike("[ \t\n,;]")


def all_empty(*cols: Column) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & (trim(F.coalesce(c, F.lit(""))) == "")
    return out


def split_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), trim), lambda x: x != "")


def leading_pos(line: Column) -> Column:
    """Struct of the part of speech that opens a line ('' if none) and the rest."""
    text = trim(line)
    pos = F.lower(F.regexp_extract(text, POS_LINE, 1))
    return F.struct(pos.alias("pos"), F.when(pos == "", text).otherwise(F.regexp_extract(text, POS_LINE, 2)).alias("rest"))


def pos_with_dot(pos: Column) -> Column:
    return F.when(pos == "", "").otherwise(F.concat(F.when(pos == "noun", "n").otherwise(pos), F.lit(".")))


def tags(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit(" ")), r"\s+"), lambda x: x != ""))


def exchange_code(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EXCHANGE_CODES.items() for x in kv])
    return F.coalesce(table[c], c)


def all_exchange_pairs(c: Column) -> Column:
    """Array of (code, word) from ``code:word/code:word``; a pair without a code gets ``other``; blank words go."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "/"), trim), lambda x: x != "")
    coded = lambda x: F.contains(x, F.lit(":"))
    pair = F.transform(parts, lambda x: F.struct(F.when(coded(x), exchange_code(F.substring_index(x, ":", 1))).otherwise("other").alias("code"), F.when(coded(x), trim(F.regexp_replace(x, "^[^:]*:", ""))).otherwise(x).alias("word")))
    return F.filter(pair, lambda x: x["word"] != "")


def exchange_pairs(c: Column) -> Column:
    """``all_exchange_pairs``; of pairs with one code and word, whatever its case, the first stays."""
    keyed = F.transform(all_exchange_pairs(c), lambda x: F.struct(x.alias("pair"), F.concat_ws("|", x["code"], F.lower(x["word"])).alias("key")))
    # an array of one binds the keyed pairs to a name, so they are made once
    first = lambda held: F.filter(held, lambda x, i: F.array_position(held["key"], x["key"]) == i + 1)
    return F.transform(F.get(F.transform(F.array(keyed), first), 0), lambda x: x["pair"])


def normalize_language(c: Column) -> Column:
    return F.when(c.isin(LANGUAGES), c).otherwise("en")


def parse_language(c: Column) -> Column:
    code = F.lower(trim(c))
    return F.when(code.isin(LANGUAGES), code).otherwise("")


def code_or_default(c: Column) -> Column:
    return F.coalesce(F.nullif(trim(c), F.lit("")), F.lit("en"))


def normalize_lemma(c: Column) -> Column:
    return F.nullif(trim(c), F.lit(""))


def language_code(c: Column) -> Column:
    """The code of a language's name (``english`` or ``LANGUAGE_ENGLISH``); '' for names that aren't known."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_ENUM.items() for x in kv])
    return F.coalesce(table[F.regexp_replace(F.lower(trim(c)), "^language_", "")], F.lit(""))


def language_name(c: Column) -> Column:
    """The name of a language's code, ``unspecified`` for others."""
    table = F.create_map(*[F.lit(x) for name, code in LANGUAGE_ENUM.items() if code for x in (code, name)])
    return F.coalesce(table[parse_language(c)], F.lit("unspecified"))


def definition_language(c: Column) -> Column:
    """The language of a definition's text: English unless a known one is named."""
    return F.coalesce(F.nullif(parse_language(F.coalesce(c, F.lit(""))), F.lit("")), F.lit("en"))


WIDTHS = {ByteType: 8, ShortType: 16, IntegerType: 32, LongType: 64}


def narrow(value: int, kind: DataType, name: str) -> Column:
    """A whole number as a column of a width; out of its range is an error."""
    bits = WIDTHS[type(kind)]
    if not -(1 << bits - 1) <= value < 1 << bits - 1:
        raise ValueError(f"{name} value {value} out of range")
    return F.lit(value).cast(kind)


def cache_name(url: str) -> str:
    """Name of a download's cache file: the address's crc32 in hexadecimal and its last part."""
    return f"{zlib.crc32(url.encode()):08x}-{url.rstrip('/').rsplit('/', 1)[-1]}"
