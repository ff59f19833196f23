"""A query builder over one table: predicates, projection, order, groups and aggregates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.errors import NotFound, NotSingular
from wordloom.functions.text import contains_fold, equal_fold

PREDICATES: dict[str, Callable] = {
    "eq": lambda c, x: c == x,
    "neq": lambda c, x: c != x,
    "gt": lambda c, x: c > x,
    "gte": lambda c, x: c >= x,
    "lt": lambda c, x: c < x,
    "lte": lambda c, x: c <= x,
    "in": lambda c, xs: c.isin(list(xs)) if xs else F.lit(False),
    "not_in": lambda c, xs: ~c.isin(list(xs)) if xs else F.lit(True),
    "contains": lambda c, x: c.contains(x),
    "has_prefix": lambda c, x: c.startswith(x),
    "has_suffix": lambda c, x: c.endswith(x),
    "equal_fold": equal_fold,
    "contains_fold": contains_fold,
    "is_nil": lambda c: c.isNull(),
    "not_nil": lambda c: c.isNotNull(),
}
AGGREGATES = {"count": lambda c: F.count(F.lit(1)), "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def where(column: str, op: str, *value) -> Column:
    return PREDICATES[op](F.col(column), *value)


def all_of(*preds: Column) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def any_of(*preds: Column) -> Column:
    return reduce(lambda a, b: a | b, preds, F.lit(False))


def none_of(*preds: Column) -> Column:
    return ~any_of(*preds)


def aggregate(fn: str, column: str = "*", name: str | None = None) -> tuple[str, Column]:
    made = AGGREGATES[fn](F.col(column) if column != "*" else F.lit(1))
    return column, made.alias(name or (fn if column == "*" else f"{fn}({column})"))


def asc(*names: str) -> list[Column]:
    return [F.col(n).asc() for n in names]


def desc(*names: str) -> list[Column]:
    return [F.col(n).desc() for n in names]


#: Types of a column's reader.
SCALARS = {"strings": ("string",), "ints": ("byte", "short", "integer", "long"), "float64s": ("float", "double"), "bools": ("boolean",)}


class Query:
    """An immutable query; every step gives a new one.  Hooks are functions of the table that run before any step."""

    def __init__(self, df: DataFrame, hooks: tuple[Callable[[DataFrame], DataFrame], ...] = (), steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()):
        self.df, self.hooks, self.steps = df, hooks, steps

    def _then(self, step: Callable[[DataFrame], DataFrame]) -> Query:
        return Query(self.df, self.hooks, (*self.steps, step))

    def intercept(self, hook: Callable[[DataFrame], DataFrame]) -> Query:
        """A function of the table that is applied before it is read, whenever it was added."""
        return Query(self.df, (*self.hooks, hook), self.steps)

    def check(self, *names: str) -> None:
        for n in names:
            if n not in self.df.columns:
                raise ValueError(f"invalid field {n!r} for query")

    def where(self, *preds: Column) -> Query:
        return self._then(lambda df: df.filter(all_of(*preds)))

    def order(self, *cols: Column) -> Query:
        return self._then(lambda df: df.orderBy(*cols))

    def order_by(self, *names: str, down: bool = False) -> Query:
        """Order by columns, whose names are checked."""
        self.check(*names)
        return self.order(*(desc if down else asc)(*names))

    def limit(self, n: int) -> Query:
        return self._then(lambda df: df.limit(n))

    def offset(self, n: int) -> Query:
        return self._then(lambda df: df.offset(n))

    def select(self, *names: str) -> Query:
        """Some columns, whose names are checked."""
        self.check(*names)
        return self._then(lambda df: df.select(*names))

    def entities(self, *names: str) -> Query:
        """Some columns of whole entities: the id comes first even if it isn't named."""
        return self.select(*dict.fromkeys(("id", *names)))

    def unique(self) -> Query:
        return self._then(lambda df: df.distinct())

    def ids(self) -> DataFrame:
        return self.all().select("id")

    def all(self) -> DataFrame:
        return reduce(lambda df, step: step(df), (*self.hooks, *self.steps), self.df)

    def count(self) -> int:
        return self.all().count()

    def exist(self) -> bool:
        return not self.all().isEmpty()

    def exists(self) -> DataFrame:
        """``exist`` as a table of one row and column, for plans that go on."""
        return self.limit(1).all().agg((F.count(F.lit(1)) > 0).alias("found"))

    def group_by(self, *names: str) -> Groups:
        self.check(*names)
        return Groups(self, names)

    def aggregate(self, *aggs: tuple[str, Column]) -> DataFrame:
        return Groups(self, ()).aggregate(*aggs)

    def first(self):
        if not (rows := self.all().take(1)):
            raise NotFound("no row")
        return rows[0]

    def only(self):
        rows = self.all().take(2)
        if not rows:
            raise NotFound("no row")
        if len(rows) > 1:
            raise NotSingular("more than one row")
        return rows[0]

    def first_id(self) -> int:
        return self._then(lambda df: df.select("id")).first()[0]

    def only_id(self) -> int:
        return self._then(lambda df: df.select("id")).only()[0]

    def values(self, column: str) -> list:
        """A column's values, for small results (the caller limits them)."""
        self.check(column)
        return [r[0] for r in self.all().select(column).collect()]

    def scalars(self, kind: str, column: str) -> list:
        """Values of a column of the kind ``strings``, ``ints``, ``float64s`` or ``bools``; another type is an error."""
        self.check(column)
        if (found := self.df.schema[column].dataType.typeName()) not in SCALARS[kind]:
            raise TypeError(f"{column} is of type {found}, not one of {kind}")
        return self.values(column)

    def scalar(self, kind: str, column: str):
        """The one value of a column: no row and several rows are errors."""
        return self.select(column)._one(kind, column)

    def _one(self, kind: str, column: str):
        Query(self.df).limit(0).scalars(kind, column)
        return self.only()[0]


class Groups:
    def __init__(self, query: Query, names: tuple[str, ...]):
        self.query, self.names = query, names

    def aggregate(self, *aggs: tuple[str, Column]) -> DataFrame:
        """Aggregates by the groups' columns; names of inputs are checked."""
        self.query.check(*(c for c, _ in aggs if c != "*"))
        df = self.query.all()
        return (df.groupBy(*self.names) if self.names else df.groupBy()).agg(*(a for _, a in aggs))
