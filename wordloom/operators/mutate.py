"""Mutations as keyed rewrites: tables in, the next version out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.errors import ConstraintError, NotFound
from wordloom.functions.text import code_or_default, narrow, normalize_language, normalize_lemma, trim
from wordloom.scratch import materialise


def last_by_key(source: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The last row of each key; a partial aggregate, so a hot key doesn't gather its rows."""
    rest = [c for c in source.columns if c not in keys]
    top = source.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("__row"))
    return top.select(*keys, *(F.col("__row")[c].alias(c) for c in rest))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], policy: str = "update", additive: tuple[str, ...] = (), keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Insert new keys; on a conflict ``update`` takes the source's values (but for ``keep``), ``ignore`` keeps the
    target's, and ``add`` adds the ``additive`` columns.  The source has a row a key."""
    rest = [c for c in target.columns if c not in keys]
    s = source.select(*keys, F.struct(*(F.col(c) if c in source.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in rest)).alias("__s"))
    t = target.select(*keys, F.struct(*rest).alias("__t"))
    both = t.join(s, keys, "full_outer")
    have_t, have_s = F.col("__t").isNotNull(), F.col("__s").isNotNull()

    def pick(c: str) -> Column:
        old, new = F.col("__t")[c], F.col("__s")[c]
        if policy == "ignore" or policy == "update" and c in keep:
            return F.when(have_t, old).otherwise(new)
        if policy == "add":
            return F.when(have_t & have_s, F.coalesce(old, F.lit(0)) + new if c in additive else old).when(have_t, old).otherwise(new)
        return F.when(have_s, new).otherwise(old)

    return both.select(*keys, *(pick(c).alias(c) for c in rest)).select(*target.columns)


def update_where(df: DataFrame, cond: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(cond, F.lit(False))
    return df.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


def append_array(df: DataFrame, cond: Column, column: str, items: list) -> DataFrame:
    return update_where(df, cond, {column: F.concat(F.coalesce(column, F.array().cast(df.schema[column].dataType)), F.array(*map(F.lit, items)).cast(df.schema[column].dataType))})


def delete_where(df: DataFrame, cond: Column) -> DataFrame:
    return df.filter(~F.coalesce(cond, F.lit(False)))


def update_counted(df: DataFrame, cond: Column, values: dict[str, Column]) -> tuple[DataFrame, int]:
    """The updated table and how many rows the condition hits."""
    return update_where(df, cond, values), df.filter(cond).count()


def delete_counted(df: DataFrame, cond: Column) -> tuple[DataFrame, int]:
    """What is left, and how many rows the condition takes away."""
    return delete_where(df, cond), df.filter(cond).count()


def affected(result: tuple[DataFrame, int], what: str = "row") -> DataFrame:
    """The table of a counted mutation; an error if it hit nothing."""
    df, n = result
    if not n:
        raise NotFound(f"{what} not found")
    return df


def with_ids(rows: DataFrame, start: int | Column, order: list[str]) -> DataFrame:
    """Consecutive ids from ``start`` in the given order.

    Ranges are sorted and written once with their partition and place: a plan that is evaluated twice may draw its
    ranges differently.  Partitions are then counted, and rows numbered from their partition's offset.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    parts = materialise(placed, "ids")
    sizes = parts.groupBy("__p").agg(F.count("*").alias("n"))
    base = sizes.withColumn("__base", F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).select("__p", F.coalesce("__base", F.lit(0)).alias("__base"))  # a row a partition
    first = F.lit(start) if isinstance(start, int) else start
    return parts.join(F.broadcast(base), "__p").select((F.col("__base") + F.col("__i") + first).alias("id"), *(c for c in rows.columns if c != "id"))


def next_id(df: DataFrame) -> DataFrame:
    """One row ``next_id``: one more than the largest id."""
    return df.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


def check_constraints(df: DataFrame, keys: list[tuple[str, ...]], lemma_rule: bool = False) -> None:
    for key in keys:
        if not df.groupBy(*key).count().where("count > 1").isEmpty():
            raise ConstraintError(f"duplicate key {key}")
    if lemma_rule and not df.where((F.col("word_type") == "lemma") == F.col("lemma").isNotNull()).isEmpty():
        raise ConstraintError("a lemma row has no lemma, and only a lemma row")


def normalize_words(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): text is required, other rows than lemmas need a lemma, lemma rows have none."""
    r = rows.withColumns({"text": trim(F.coalesce("text", F.lit(""))), "language": code_or_default(F.coalesce("language", F.lit(""))), "word_type": F.coalesce(F.nullif(trim(F.col("word_type")), F.lit("")), F.lit("lemma")), "lemma": normalize_lemma(F.coalesce("lemma", F.lit("")))})
    r = r.withColumn("lemma", F.when(F.col("word_type") != "lemma", F.col("lemma")))
    ok = (F.col("text") != "") & ((F.col("word_type") == "lemma") | F.col("lemma").isNotNull())
    return r.filter(ok), r.filter(~ok)


#: Columns that a collect replaces as a whole, with what stands for an absent value.
MASTERY = {f"mastery_{k}": 0 for k in ("listen", "read", "spell", "pronounce", "overall")}
REVIEW = {"review_last_review_at": None, "review_next_review_at": None, "review_interval_days": 0, "review_fail_count": 0}


def collect_words(user_words: DataFrame, events: DataFrame, now: Column, first_id: int | Column | None = None) -> DataFrame:
    """Fold collect events ``(user_id, word, ordinal, ...)`` into the table, as if they came one by one.

    A hit (the smallest id of that user and exact word) adds to query_count, replaces all of mastery and review by those
    of the last event, and takes the last language and notes that aren't empty; a miss is created.  Events without a word are left out.
    ``first_id``: the first id of new rows; by default one more than the largest.
    """
    have = set(events.columns)
    e = events.withColumn("word", trim(F.col("word"))).filter("word <> ''")
    whole = {c: F.coalesce(c, F.lit(none)) if c in have else F.lit(none) for c, none in (MASTERY | REVIEW).items() if c in user_words.columns}
    whole = {c: v.cast(user_words.schema[c].dataType) for c, v in whole.items()}
    said = {
        "language": F.when(trim(F.coalesce("language", F.lit(""))) != "", normalize_language(F.col("language"))) if "language" in have else F.lit(None).cast("string"),
        "notes": F.nullif(F.col("notes"), F.lit("")) if "notes" in have else F.lit(None).cast("string"),
    }
    e = e.select("user_id", "word", "ordinal", F.struct(*(v.alias(c) for c, v in whole.items())).alias("w"), *(v.alias(c) for c, v in said.items()))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(f"__{c}") for c in said]
    folded = e.groupBy("user_id", "word").agg(F.count("*").alias("__n"), F.max_by("w", "ordinal").alias("__w"), *last)
    first = user_words.groupBy("user_id", "word").agg(F.min("id").alias("id"))
    hits = first.join(folded, ["user_id", "word"])
    old = user_words.join(hits.drop("user_id", "word"), "id", "left")
    hit = F.col("__n").isNotNull()
    changes = {c: F.when(hit, F.col("__w")[c]).otherwise(F.col(c)) for c in whole} | {
        "query_count": F.when(hit, F.coalesce("query_count", F.lit(0)) + F.col("__n")).otherwise(F.col("query_count")),
        "language": F.coalesce("__language", "language"),
        "notes": F.coalesce("__notes", "notes"),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    changed = old.withColumns(changes).select(user_words.columns)
    fresh = folded.join(first, ["user_id", "word"], "left_anti")
    values = {c: F.col("__w")[c] for c in whole} | {"language": F.coalesce("__language", F.lit("en")), "query_count": F.col("__n"), "notes": F.col("__notes"), "created_by": F.lit("user"), "created_at": now, "updated_at": now}
    values |= {c: F.array() for c in ("sentences", "relations") if c in user_words.columns} | ({"mastery_use": F.lit(0)} if "mastery_use" in user_words.columns else {})
    start = first_id if first_id is not None else next_id(user_words).scalar()
    rows = with_ids(fresh.select("user_id", "word", *(v.alias(c) for c, v in values.items())), start, ["user_id", "word"])
    rows = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(user_words.schema[c].dataType).alias(c) for c in user_words.columns))
    return changed.union(rows)


def update_mastery(user_words: DataFrame, id: int, mastery: dict[str, int], now: Column, review: dict | None = None, notes: str | None = None, user_id: int | None = None) -> DataFrame:
    """Replace mastery and review of one row of a user; without a review its times are cleared and its counters zeroed.

    ``user_id``: None for whichever user the row is of.  A row that isn't there is an error, and so is a value out of its column's range.
    """
    review = review or {}
    values = {c: narrow(mastery.get(c.removeprefix("mastery_"), none), user_words.schema[c].dataType, c) for c, none in MASTERY.items() if c in user_words.columns}
    values |= {c: F.lit(review.get(c, none)).cast(user_words.schema[c].dataType) for c, none in REVIEW.items() if c in user_words.columns}
    if notes:
        values["notes"] = F.lit(notes)
    cond = F.col("id") == id
    if user_id is not None:
        cond = cond & (F.col("user_id") == user_id)
    return affected(update_counted(user_words, cond, values | {"updated_at": now}), "user word")
