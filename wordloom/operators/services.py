"""Requests on words and user words, over the snapshots of a store.

A request that can't be met raises: InvalidInput for what it says, NotFound for a row that isn't there, ConstraintError for
a key that is there already.  Creating appends to the table's files; updating and deleting rewrite it.  Several rows of
one request share one rewrite.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from wordloom.errors import InvalidInput, NotFound
from wordloom.functions.text import LANGUAGES, narrow
from wordloom.operators import hooks as H
from wordloom.operators import mutate as M
from wordloom.operators.query import Page, list_rows, lookup
from wordloom.plans.filterexpr import USER_WORDS as USER_WORD_FIELDS
from wordloom.plans.filterexpr import WORDS as WORD_FIELDS
from wordloom.schemas import USER_WORDS, WORDS
from wordloom.sources.store import Store

#: Columns that an update of a word replaces; absent ones are emptied.
WORD_LISTS = ("phonetics", "meanings", "tags", "phrases", "sentences", "relations")


def clock() -> datetime:
    return datetime.now(UTC)


class Service:
    table = ""
    missing = "row not found"

    def __init__(self, store: Store, now: Callable[[], datetime] = clock, mutators: H.Mutators | None = None):
        self.store, self.now, self.mutators = store, now, mutators or H.Mutators()

    def rows(self) -> DataFrame:
        return self.store.read(self.table)

    def one(self, cond: Column) -> Row:
        found = self.rows().where(cond).orderBy("id").take(1)
        if not found:
            raise NotFound(self.missing)
        return found[0]

    def put(self, values: dict) -> Row:
        """Append a row under the next id."""
        schema = self.rows().schema
        new = {f.name: values.get(f.name) for f in schema} | {"id": self.store.next_id(self.table)}

        def act(_: H.Mutation) -> Row:
            row = tuple(new[f.name] for f in schema)
            self.store.append(self.table, self.store.spark.createDataFrame([row], schema))
            return self.one(F.col("id") == new["id"])

        return self.mutators.run(H.Mutation(H.CREATE, self.table, None, frozenset(values)), act)

    def rewrite(self, op: str, cond: Column, values: dict[str, Column] | None) -> int:
        """Update or delete the rows of a condition; none is an error."""

        def act(m: H.Mutation) -> int:
            df, n = M.delete_counted(m.rows, cond) if values is None else M.update_counted(m.rows, cond, values)
            if not n:
                raise NotFound(self.missing)
            self.store.write({self.table: df})
            return n

        return self.mutators.run(H.Mutation(op, self.table, self.rows(), frozenset(values or ())), act)


class WordService(Service):
    """Words: create, update, get, delete, list and look up."""

    table, missing = "words", "word not found"

    @staticmethod
    def checked(word: dict) -> dict:
        text = (word.get("text") or "").strip()
        if not text:
            raise InvalidInput("invalid word text")
        kind = (word.get("word_type") or "").strip() or "lemma"
        lemma = (word.get("lemma") or "").strip() or None
        if kind != "lemma" and not lemma:
            raise InvalidInput("lemma reference required for non-lemma entries")
        language = word.get("language") if word.get("language") in LANGUAGES else "en"
        return word | {"text": text, "language": language, "word_type": kind, "lemma": lemma if kind != "lemma" else None} | {c: word.get(c) or [] for c in WORD_LISTS}

    @staticmethod
    def checked_id(id: int) -> int:
        if not id or id <= 0:
            raise InvalidInput("invalid word id")
        return id

    def create(self, word: dict) -> Row:
        return self.put(self.checked(word) | {"created_at": self.now(), "updated_at": self.now()})

    def create_many(self, words: DataFrame) -> tuple[int, DataFrame]:
        """Append valid rows under consecutive ids, by text; how many, and the rows that are not valid."""
        good, bad = M.normalize_words(words)
        rows = M.with_ids(good, self.store.next_id(self.table), ["text", "language", "word_type"])
        stamp = F.lit(self.now())
        rows = rows.select(*((F.col(f.name) if f.name in rows.columns else F.array() if f.name in WORD_LISTS else F.lit(None)).cast(f.dataType).alias(f.name) for f in WORDS))
        rows = rows.withColumns({c: F.coalesce(c, stamp) for c in ("created_at", "updated_at")})
        return self.store.append(self.table, rows), bad

    def update(self, word: dict) -> Row:
        new = self.checked(word)
        id = self.checked_id(new.get("id") or 0)
        values = {c: F.lit(new[c]) for c in ("text", "language", "word_type", "lemma")} | {c: F.from_json(F.lit(as_json(new[c])), WORDS[c].dataType) for c in WORD_LISTS}
        values = {c: v.cast(WORDS[c].dataType) for c, v in values.items()}
        self.rewrite(H.UPDATE_ONE, F.col("id") == id, values | {"updated_at": F.lit(self.now())})
        return self.get(id)

    def get(self, id: int) -> Row:
        return self.one(F.col("id") == self.checked_id(id))

    def delete(self, id: int) -> None:
        self.rewrite(H.DELETE_ONE, F.col("id") == self.checked_id(id), None)

    def list(self, filter: str = "", order_by: str = "", page: Page = Page()) -> tuple[DataFrame, DataFrame]:
        return list_rows(self.rows(), WORD_FIELDS, filter, order_by, page)

    def lookup(self, text: str, language: str = "en") -> DataFrame:
        return lookup(self.rows(), text, language)


class UserWordService(Service):
    """A user's words: collect, mastery, list and delete."""

    table, missing = "user_words", "user word not found"

    def collect(self, user_id: int, word: dict) -> Row:
        """Find or create; a hit counts one more query and replaces mastery and review."""
        text = (word.get("word") or "").strip()
        if not text:
            raise InvalidInput("invalid user word text")
        now, rows = self.now(), self.rows()
        mine = (F.col("user_id") == user_id) & (F.col("word") == text)
        whole = {c: word.get(c, none) for c, none in (M.MASTERY | M.REVIEW).items()}
        numbers = {c: narrow(v, USER_WORDS[c].dataType, c) for c, v in whole.items() if isinstance(v, int)}
        found = rows.where(mine).orderBy("id").take(1)
        language = (word.get("language") or "").strip()
        if not found:
            new = {"user_id": user_id, "word": text, "mastery_use": 0, "sentences": word.get("sentences") or [], "relations": word.get("relations") or []} | whole
            new |= {"language": word["language"] if language in LANGUAGES else "en", "query_count": word.get("query_count") or 1, "notes": word.get("notes") or None}
            return self.put(new | {"created_by": word.get("created_by") or "user", "created_at": word.get("created_at") or now, "updated_at": now})
        values = {c: numbers.get(c, F.lit(v)).cast(USER_WORDS[c].dataType) for c, v in whole.items()}
        values |= {"query_count": F.lit(found[0].query_count + 1), "updated_at": F.lit(now)}
        if language:
            values["language"] = F.lit(word["language"] if word["language"] in LANGUAGES else "en")
        if word.get("notes"):
            values["notes"] = F.lit(word["notes"])
        self.rewrite(H.UPDATE_ONE, F.col("id") == found[0].id, values)
        return self.get(user_id, found[0].id)

    def collect_many(self, events: DataFrame) -> None:
        """Fold a table of collect events in one rewrite."""
        rows = M.collect_words(self.rows(), events, F.lit(self.now()), self.store.next_id(self.table))
        self.mutators.run(H.Mutation(H.UPDATE, self.table, rows), lambda m: self.store.write({self.table: m.rows}))

    def get(self, user_id: int, id: int) -> Row:
        return self.one((F.col("id") == id) & (F.col("user_id") == user_id))

    def update_mastery(self, user_id: int, id: int, mastery: dict[str, int], review: dict | None = None, notes: str | None = None) -> Row:
        if id <= 0:
            raise NotFound(self.missing)

        def act(m: H.Mutation) -> Row:
            self.store.write({self.table: M.update_mastery(m.rows, id, mastery, F.lit(self.now()), review, notes, user_id)})
            return self.get(user_id, id)

        return self.mutators.run(H.Mutation(H.UPDATE_ONE, self.table, self.rows(), frozenset(M.MASTERY | M.REVIEW)), act)

    def list(self, user_id: int, filter: str = "", order_by: str = "", page: Page = Page()) -> tuple[DataFrame, DataFrame]:
        return list_rows(self.rows(), USER_WORD_FIELDS, filter, order_by, page, text="word", user_id=user_id)

    def delete(self, user_id: int, id: int) -> None:
        if id <= 0:
            raise NotFound(self.missing)
        self.rewrite(H.DELETE_ONE, (F.col("id") == id) & (F.col("user_id") == user_id), None)


def as_json(value: object) -> str:
    import json

    return json.dumps(value, default=lambda x: x.isoformat() if isinstance(x, datetime) else x.asDict(True) if isinstance(x, Row) else str(x))
