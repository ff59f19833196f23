"""Schemas and keys of the two tables."""

from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampType

_S, _I, _L, _H, _T = StringType(), IntegerType(), LongType(), ShortType(), TimestampType()


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


def _list(**fields: DataType) -> ArrayType:
    return ArrayType(_struct(**fields))


_DEFINITIONS = _list(pos=_S, text=_S, language=_S)
_SENTENCES = _list(text=_S, source=_I, source_ref=_S)
WORDS = _struct(
    id=_L, text=_S, language=_S, word_type=_S, lemma=_S, phonetics=_list(ipa=_S, dialect=_S), meanings=_DEFINITIONS, tags=ArrayType(_S),
    phrases=_list(id=_L, text=_S, language=_S, definitions=_DEFINITIONS, created_at=_T, updated_at=_T), sentences=_SENTENCES, relations=_list(word=_S, relation_type=_I), created_at=_T, updated_at=_T,
)
USER_WORDS = _struct(
    id=_L, user_id=_L, word=_S, language=_S, mastery_listen=_H, mastery_read=_H, mastery_spell=_H, mastery_pronounce=_H, mastery_use=_H, mastery_overall=_I,
    review_last_review_at=_T, review_next_review_at=_T, review_interval_days=_I, review_fail_count=_I, query_count=_L, notes=_S, sentences=_SENTENCES,
    relations=_list(word=_S, relation_type=_I, note=_S, created_by=_S, created_at=_T, updated_at=_T), created_by=_S, created_at=_T, updated_at=_T,
)
TABLES = {"user_words": USER_WORDS, "words": WORDS}
UNIQUE = {"words": [("id",), ("language", "text", "word_type")], "user_words": [("id",)]}
NULLABLE = {"words": {"lemma"}, "user_words": {"notes", "review_last_review_at", "review_next_review_at"}}
