"""A filter language of conjunctions, bound to predicates.

``filter := atom ('&&' atom)*`` with atoms ``field == x``, ``>=``, ``<=``, ``field in ['a', 'b']`` and
``field.startsWith('x')``.  Literals are strings, numbers, string lists and ``timestamp('RFC 3339')``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from wordloom.errors import FilterError

TOKEN = re.compile(
    r"""\s+|(?P<string>[rR]?(?:'{3}(?:\\.|.)*?'{3}|"{3}(?:\\.|.)*?"{3}|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"))"""
    r"""|(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|0[xX][0-9a-fA-F]+[uU]?|\d+[uU]?)"""
    r"""|(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|>=|<=|[-+*/%<>!?:().,\[\]{}])""",
    re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


@dataclass(frozen=True)
class Field:
    """A filterable field: kind ``string``, ``number`` or ``timestamp``; operators to destination slots."""

    kind: str
    slots: dict[str, str]
    coerce: Callable[[object], object] | None = None


@dataclass(frozen=True)
class OrderKey:
    column: str
    nulls_last: bool = True


@dataclass(frozen=True)
class ResourceSchema:
    fields: dict[str, Field]
    order: dict[str, OrderKey] = field(default_factory=dict)
    default: tuple[str, bool] | None = None  # key, descending
    fallback: tuple[str, bool] | None = None


def unquote(raw: str) -> str:
    plain = raw[0] in "rR"
    body = raw[1:] if plain else raw
    n = 3 if body[:3] in ("'''", '"""') else 1
    body = body[n:-n]
    if plain:
        return body

    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "xXuU" and len(x) > 1:
            return chr(int(x[1:], 16))
        if x[0] in "0123" and len(x) == 3:
            return chr(int(x, 8))
        if x in ESCAPES:
            return ESCAPES[x]
        if x in "\\'\"`?":
            return x
        raise FilterError(f"filter: invalid filter: unknown escape \\{x}")

    return re.sub(r"\\(x[0-9a-fA-F]{2}|X[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-3][0-7]{2}|.)", one, body, flags=re.S)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise FilterError(f"filter: invalid filter: unexpected {text[at]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return [*out, ("end", "")]


def parse_time(text: str) -> datetime:
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)T(\d\d:\d\d:\d\d)(\.\d+)?(Z|[+-]\d\d:\d\d)", text)
    if not m:
        raise FilterError(f"filter: timestamp literal {text!r} is not RFC3339")
    try:
        return datetime.fromisoformat(f"{m[1]}T{m[2]}{(m[3] or '')[:7]}{'+00:00' if m[4] == 'Z' else m[4]}").astimezone(UTC)
    except ValueError as e:
        raise FilterError(f"filter: timestamp literal {text!r} is not RFC3339") from e


class Parser:
    """Recursive descent to nodes: ('and', l, r), ('call', name, target, args), ('name', x), ('const', kind, x), ('list', xs)."""

    LEVELS = [("||",), ("&&",), ("==", "!=", ">=", "<=", "<", ">", "in"), ("+", "-"), ("*", "/", "%")]

    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self) -> str:
        return self.tokens[self.at][1]

    def take(self, want: str | None = None) -> tuple[str, str]:
        kind, text = self.tokens[self.at]
        if want is not None and text != want or kind == "end" and want is None:
            raise FilterError(f"filter: invalid filter: expected {want or 'an operand'}, found {text or 'the end'}")
        self.at += 1
        return kind, text

    def parse(self) -> tuple:
        node = self.ternary()
        self.take("")
        return node

    def ternary(self) -> tuple:
        node = self.binary(0)
        if self.peek() == "?":
            self.take()
            a = self.ternary()
            self.take(":")
            return ("call", "?:", None, [node, a, self.ternary()])
        return node

    def binary(self, level: int) -> tuple:
        if level == len(self.LEVELS):
            return self.unary()
        node = self.binary(level + 1)
        while self.peek() in self.LEVELS[level] and self.tokens[self.at][0] != "string":
            op = self.take()[1]
            node = ("call", op, None, [node, self.binary(level + 1)])
        return node

    def unary(self) -> tuple:
        if self.peek() in ("!", "-") and self.tokens[self.at][0] == "op":
            op = self.take()[1]
            inner = self.unary()
            if op == "-" and inner[0] == "const" and inner[1] == "number":
                return ("const", "number", -inner[2])
            return ("call", op, None, [inner])
        return self.postfix()

    def args(self, close: str) -> list[tuple]:
        """Operands up to ``close``; a list may end with a comma, a call may not."""
        out = []
        while self.peek() != close:
            out.append(self.ternary())
            if self.peek() != close:
                self.take(",")
                if close == ")" and self.peek() == close:
                    raise FilterError("filter: invalid filter: expected an operand, found )")
        self.take(close)
        return out

    def postfix(self) -> tuple:
        kind, text = self.take()
        if kind == "string":
            node: tuple = ("const", "string", unquote(text))
        elif kind == "number":
            body = text.rstrip("uU") if not text.lower().startswith("0x") else text.rstrip("uU")
            node = ("const", "number", float(int(body, 16)) if body.lower().startswith("0x") else float(body))
        elif text in ("true", "false", "null"):
            node = ("const", text, None)
        elif kind == "name":
            if self.peek() == "(":
                self.take()
                node = ("call", text, None, self.args(")"))
            else:
                node = ("name", text)
        elif text == "(":
            node = self.ternary()
            self.take(")")
        elif text == "[":
            node = ("list", self.args("]"))
        else:
            raise FilterError(f"filter: invalid filter: unexpected {text}")
        while self.peek() == "." and self.tokens[self.at][0] == "op":
            self.take()
            name = self.take()[1]
            if self.peek() == "(":
                self.take()
                node = ("call", name, node, self.args(")"))
            else:
                node = ("call", "." + name, node, [])
        return node


def conjuncts(node: tuple) -> list[tuple]:
    if node[0] == "call" and node[1] == "&&":
        return [x for part in node[3] for x in conjuncts(part)]
    if node[0] == "call" and node[1] in ("||", "?:", "!"):
        raise FilterError(f"filter: logical operator {node[1]!r} is not supported; only AND is allowed")
    return [node]


def literal(node: tuple) -> tuple[str, object]:
    if node[0] == "const":
        if node[1] in ("string", "number"):
            return node[1], node[2]
        raise FilterError(f"filter: literal type {node[1]} is not supported")
    if node[0] == "list":
        items = []
        for x in node[1]:
            kind, value = literal(x)
            if kind != "string":
                raise FilterError("filter: list literal elements must be strings")
            items.append(value)
        return "list", items
    if node[0] == "call" and node[1] == "timestamp" and node[2] is None:
        if len(node[3]) != 1:
            raise FilterError("filter: timestamp() expects a single string argument")
        if node[3][0][0] != "const":
            raise FilterError("filter: timestamp() argument must be a string literal")
        if node[3][0][1] != "string" or not node[3][0][2]:
            raise FilterError("filter: timestamp() argument must not be empty")
        return "timestamp", parse_time(node[3][0][2])
    raise FilterError("filter: right-hand side must be a literal, list literal, or timestamp() call")


def atom(node: tuple) -> tuple[str, str, str, object]:
    """(field, operator, kind of literal, value)."""
    if node[0] != "call":
        raise FilterError("filter: unsupported expression; expected comparison or function call")
    _, name, target, args = node
    if name in ("==", ">=", "<="):
        left, right = args
    elif name == "in":
        if len(args) != (2 if target is None else 1):
            raise FilterError("filter: in operator expects two operands, or one with a receiver")
        left, right = args if target is None else (args[0], target)
    elif name == "startsWith":
        if len(args) != (2 if target is None else 1):
            raise FilterError("filter: startsWith expects two arguments, or one with a receiver")
        left, right = args if target is None else (target, args[0])
    else:
        raise FilterError(f"filter: function {name!r} is not supported")
    if left[0] != "name":
        raise FilterError("filter: left-hand side must be an identifier")
    kind, value = literal(right)
    if name == "startsWith" and kind != "string":
        raise FilterError("filter: startsWith requires a string literal argument")
    return left[1], name, kind, value


def bind_filter(text: str | None, schema: ResourceSchema) -> dict[str, object]:
    """Values by slot; a slot that is set twice keeps the later value."""
    slots: dict[str, object] = {}
    if not (text or "").strip():
        return slots
    if not schema.fields:
        raise FilterError("filter: filter schema has no fields defined")
    for node in conjuncts(Parser(text).parse()):
        name, op, kind, value = atom(node)
        spec = schema.fields.get(name)
        if spec is None:
            raise FilterError(f"filter: field {name!r} is not allowed")
        if op not in spec.slots:
            raise FilterError(f"filter: operator {op!r} is not allowed for field {name!r}")
        if op == "in" and spec.kind == "string":
            if kind != "list":
                raise FilterError(f"filter: field {name!r}: expected list of string literals")
            if not value:
                raise FilterError(f"filter: field {name!r}: list literal must not be empty")
            if "" in value:
                raise FilterError(f"filter: field {name!r}: list literal must not contain empty strings")
        elif kind != spec.kind:
            raise FilterError(f"filter: field {name!r}: expected {spec.kind} literal")
        try:
            slots[spec.slots[op]] = spec.coerce(value) if spec.coerce else value
        except (ValueError, OverflowError) as e:
            raise FilterError(f"filter: failed to assign field {spec.slots[op]!r}: {e}") from e
    return slots


def to_int(bits: int, signed: bool = True) -> Callable[[float], int]:
    """A coercion that takes whole numbers within the width."""

    def coerce(x: float) -> int:
        if x != int(x):
            raise ValueError(f"cannot assign non-integer value {x} to integer field")
        low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
        if not signed and x < 0:
            raise ValueError(f"cannot assign negative value {x} to unsigned integer field")
        if not low <= x <= high:
            raise OverflowError(f"value {x} overflows integer field")
        return int(x)

    return coerce


def normalize_set(words: list[str] | None) -> list[str]:
    """Trimmed, without blanks, the first spelling of words that differ in case."""
    out: dict[str, str] = {}
    for w in words or ():
        if w.strip():
            out.setdefault(w.strip().lower(), w.strip())
    return list(out.values())


ORDERS = {
    "words": {"id": OrderKey("id", False), "text": OrderKey("text"), "created_at": OrderKey("created_at"), "updated_at": OrderKey("updated_at")},
    "user_words": {"id": OrderKey("id", False), "word": OrderKey("word"), "created_at": OrderKey("created_at"), "updated_at": OrderKey("updated_at"), "mastery_overall": OrderKey("mastery_overall")},
}
# ``startsWith`` shares the keyword's slot: it runs as a search for the text anywhere, without regard to case.
WORDS = ResourceSchema({"keyword": Field("string", {"==": "keyword"}), "word": Field("string", {"startsWith": "keyword", "in": "words"}), "word_type": Field("string", {"==": "word_type"})}, ORDERS["words"], ("created_at", True), ("id", False))
USER_WORDS = ResourceSchema({"keyword": Field("string", {"==": "keyword"}), "word": Field("string", {"startsWith": "keyword", "in": "words"})}, ORDERS["user_words"], ("updated_at", True), ("id", False))
