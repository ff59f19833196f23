"""Hooks around mutations: a hook takes the next mutator and gives one in its place."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame

from wordloom.errors import Rejected

CREATE, UPDATE, UPDATE_ONE, DELETE, DELETE_ONE = "create", "update", "update_one", "delete", "delete_one"


@dataclass(frozen=True)
class Mutation:
    """What is about to happen to a table: the operation, the columns it sets, adds to or clears, and the table as it is."""

    op: str
    table: str
    rows: DataFrame | None = None
    fields: frozenset[str] = field(default_factory=frozenset)
    added: frozenset[str] = field(default_factory=frozenset)
    cleared: frozenset[str] = field(default_factory=frozenset)

    def over(self, rows: DataFrame) -> Mutation:
        return replace(self, rows=rows)


Mutator = Callable[[Mutation], object]
Hook = Callable[[Mutator], Mutator]
Condition = Callable[[Mutation], bool]


def has_op(*ops: str) -> Condition:
    return lambda m: m.op in ops


def has_fields(*names: str) -> Condition:
    return lambda m: m.fields.issuperset(names)


def has_added(*names: str) -> Condition:
    return lambda m: m.added.issuperset(names)


def has_cleared(*names: str) -> Condition:
    return lambda m: m.cleared.issuperset(names)


def every(*conditions: Condition) -> Condition:
    return lambda m: all(c(m) for c in conditions)


def some(*conditions: Condition) -> Condition:
    return lambda m: any(c(m) for c in conditions)


def never(condition: Condition) -> Condition:
    return lambda m: not condition(m)


def when(hook: Hook, condition: Condition) -> Hook:
    """The hook where the condition holds; elsewhere the mutation goes on without it."""

    def wrap(then: Mutator) -> Mutator:
        hooked = hook(then)
        return lambda m: (hooked if condition(m) else then)(m)

    return wrap


def on(hook: Hook, *ops: str) -> Hook:
    return when(hook, has_op(*ops))


def unless(hook: Hook, *ops: str) -> Hook:
    return when(hook, never(has_op(*ops)))


def fail(error: Exception) -> Hook:
    """Let nothing through."""

    def stop(_: Mutation) -> object:
        raise error

    return lambda _: stop


def reject(*ops: str) -> Hook:
    return on(fail(Rejected(f"{', '.join(ops)} is not allowed")), *ops)


def chain(*hooks: Hook) -> Hook:
    """One hook of several; the first one is outermost."""
    return lambda then: reduce(lambda inner, hook: hook(inner), reversed(hooks), then)


class Mutators:
    """Hooks by table, run around whatever is done to it."""

    def __init__(self) -> None:
        self.hooks: dict[str, list[Hook]] = {}

    def use(self, table: str, *hooks: Hook) -> None:
        self.hooks.setdefault(table, []).extend(hooks)

    def run(self, mutation: Mutation, act: Mutator) -> object:
        return chain(*self.hooks.get(mutation.table, ()))(act)(mutation)
