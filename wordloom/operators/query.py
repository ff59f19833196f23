"""List and look-up queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.errors import InvalidInput
from wordloom.functions.text import contains_fold
from wordloom.plans.filterexpr import ResourceSchema, bind_filter, normalize_set
from wordloom.plans.ordering import sort_columns

MAX_PAGE, DEFAULT_PAGE = 10_000, 20


@dataclass(frozen=True)
class Page:
    number: int = 1
    size: int = DEFAULT_PAGE

    def clamp(self) -> Page:
        return Page(max(1, self.number), DEFAULT_PAGE if self.size <= 0 else min(self.size, MAX_PAGE))

    @property
    def offset(self) -> int:
        return (self.number - 1) * self.size


def predicate(slots: dict[str, object], text: str = "text", word_type: str = "word_type") -> Column:
    """The conjunction of the slots that are set; a blank keyword sets nothing."""
    out = F.lit(True)
    if slots.get("keyword"):
        out = out & contains_fold(F.col(text), slots["keyword"])
    if slots.get("word_type"):
        out = out & (F.col(word_type) == slots["word_type"])
    if words := normalize_set(slots.get("words")):
        out = out & F.lower(text).isin([w.lower() for w in words])
    return out


def list_rows(df: DataFrame, schema: ResourceSchema, filter: str = "", order_by: str = "", page: Page = Page(), *, text: str = "text", word_type: str = "word_type", id_column: str = "id", columns: dict[str, str] | None = None, user_id: int | None = None, exact_first: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(page of rows, one-row table ``total``), both lazy and over the same filter.

    Rows whose text is the keyword come first, unless the rows are of one user or ``exact_first`` says otherwise.
    """
    slots = bind_filter(filter, schema)
    exact_first = user_id is None if exact_first is None else exact_first
    found = df.filter(predicate(slots, text, word_type))
    if user_id is not None:
        found = found.filter(F.col("user_id") == user_id)
    boost = F.col(text) == slots["keyword"] if exact_first and slots.get("keyword") else None
    page = page.clamp()
    rows = found.orderBy(*sort_columns(order_by, schema, boost, id_column, columns))
    return (rows.offset(page.offset) if page.offset else rows).limit(page.size), found.agg(F.count(F.lit(1)).alias("total"))


def lookup(words: DataFrame, text: str, language: str = "en") -> DataFrame:
    """The row of a text, lemma rows first, then the smallest id; its forms if it is a lemma.  No row on a miss; a blank text is an error."""
    if not text.strip():
        raise InvalidInput("invalid word text")
    hit = words.where((F.col("text") == text.strip()) & (F.col("language") == (language or "en")))
    hit = hit.orderBy(F.when(F.col("word_type") == "lemma", 0).otherwise(1), "id").limit(1)
    return hit.join(forms_by_lemma(words.where((F.col("lemma") == text.strip()) & (F.col("language") == (language or "en")))), (F.col("word_type") == "lemma") & (hit["text"] == F.col("__lemma")) & (hit["language"] == F.col("__language")), "left").drop("__lemma", "__language")


def lookup_many(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """Look-ups of a table ``(text, language)`` in one plan; a ranked pick per key is pre-aggregated, so hot keys don't gather."""
    keyed = words.join(wanted.distinct(), ["text", "language"], "left_semi")
    best = keyed.groupBy("text", "language").agg(F.min(F.struct(F.when(F.col("word_type") == "lemma", 0).otherwise(1).alias("p"), F.col("id"))).alias("b")).select(F.col("b.id").alias("id"))
    hit = words.join(best, "id", "left_semi")
    return hit.join(forms_by_lemma(words), (F.col("word_type") == "lemma") & (hit["text"] == F.col("__lemma")) & (hit["language"] == F.col("__language")), "left").drop("__lemma", "__language")


def forms_by_lemma(words: DataFrame) -> DataFrame:
    """``(__language, __lemma, forms)``: the inflected rows of each lemma by text."""
    rows = words.where(F.col("lemma").isNotNull() & (F.col("word_type") != "lemma"))
    return rows.groupBy(F.col("language").alias("__language"), F.col("lemma").alias("__lemma")).agg(F.array_sort(F.collect_list(F.struct("text", "word_type"))).alias("forms"))
