import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wordloom.errors import FilterError, OrderError
from wordloom.plans.filterexpr import WORDS, Field, ResourceSchema, bind_filter, normalize_set, to_int
from wordloom.plans.ordering import parse_order


def test_slots():
    assert bind_filter("keyword == 'a' && (word in ['x', \"y\"] && word_type == 'lemma')", WORDS) == {"keyword": "a", "words": ["x", "y"], "word_type": "lemma"}
    assert bind_filter("keyword == 'a' && word.startsWith('b')", WORDS) == {"keyword": "b"}
    assert bind_filter("startsWith(word, r'a\\n')", WORDS) == {"keyword": "a\\n"}
    assert bind_filter("", WORDS) == bind_filter(" \t", WORDS) == {}


@pytest.mark.parametrize(
    ("text", "says"),
    [
        ("keyword == 'a' || keyword == 'b'", "only AND is allowed"), ("!(keyword == 'a')", "only AND is allowed"), ("keyword == 'a' ? true : false", "only AND"), ("nope == 'a'", "not allowed"), ("keyword >= 'a'", "not allowed"),
        ("keyword != 'a'", "not supported"), ("keyword.contains('a')", "not supported"), ("'a' == keyword", "left-hand side must be an identifier"), ("keyword == true", "not supported"), ("keyword == 1", "expected string literal"), ("word in []", "must not be empty"),
        ("word in ['']", "empty strings"), ("word in [1]", "elements must be strings"), ("keyword ==", "invalid filter"), ("keyword == 'a", "invalid filter"), ("keyword", "comparison"), ("word.startsWith(keyword)", "right-hand side"),
    ],
)
def test_errors(text, says):
    with pytest.raises(FilterError, match="^filter: .*") as e:
        bind_filter(text, WORDS)
    assert says in str(e.value)


def test_numbers_and_times():
    schema = ResourceSchema({"n": Field("number", {"==": "n"}, to_int(16)), "u": Field("number", {"==": "u"}, to_int(8, False)), "t": Field("timestamp", {">=": "t"})})
    assert bind_filter("n == -12 && u == 0x10", schema) == {"n": -12, "u": 16}
    assert bind_filter("t >= timestamp('2025-01-01T08:00:00.123456789+08:00')", schema)["t"].isoformat() == "2025-01-01T00:00:00.123456+00:00"
    for bad in ("n == 1.5", "n == 40000", "u == -1", "u == 256", "n in ['a']", "t >= timestamp('')", "t >= timestamp('yesterday')", "t >= timestamp('2025-13-01T00:00:00Z')", "t >= 'x'"):
        with pytest.raises(FilterError):
            bind_filter(bad, schema)
    with pytest.raises(FilterError, match="no fields"):
        bind_filter("a == 'b'", ResourceSchema({}))


def test_order():
    assert parse_order("", WORDS) == [("created_at", True), ("id", False)]
    assert parse_order("text DESC, , updated_at", WORDS) == [("text", True), ("updated_at", False)]
    assert parse_order("id", WORDS) == [("id", False), ("text", False)]
    for bad in ("nope", "text sideways", "text asc now", "text, text", "text, id, created_at"):
        with pytest.raises(OrderError):
            parse_order(bad, WORDS)


def test_normalize_set():
    assert normalize_set([" Tree", "tree", "", "Oak "]) == ["Tree", "Oak"]


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_string_literals_round_trip(x):
    quoted = '"' + "".join(c if c.isalnum() and c.isascii() else f"\\U{ord(c):08x}" for c in x) + '"'
    assert bind_filter(f"keyword == {quoted}", WORDS) == {"keyword": x}
