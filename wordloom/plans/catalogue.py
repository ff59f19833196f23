"""Queries that show each operator on the test tables, with their SQL.

``part`` stands for the word list (p_name for the text, p_type for the word type), ``events`` for collect events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from wordloom.functions import text as T
from wordloom.operators import builder as B
from wordloom.operators import lexicon
from wordloom.operators import mutate as M
from wordloom.operators.query import Page, forms_by_lemma, list_rows, lookup_many, predicate
from wordloom.plans import filterexpr as X
from wordloom.plans.ordering import bind, sort_columns
from wordloom.scratch import fresh_path
from wordloom.sources import backup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PARTS = X.ResourceSchema(
    X.WORDS.fields,
    {"id": X.OrderKey("p_partkey", False), "text": X.OrderKey("p_name"), "size": X.OrderKey("p_size"), "price": X.OrderKey("p_retailprice")},
    ("price", True),
    ("id", False),
)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def add(name: str, table: str, fn: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, folder: fn(read(spark, folder, table))
    if sql:
        SQL[name] = sql


def part_filter(name: str, pred: Callable[[], Column], where: str) -> None:
    """Columns are made when a query is, for making them needs a session."""
    add(name, "part", lambda p: B.Query(p).where(pred()).select("p_partkey", "p_name", "p_type", "p_size").all(), f"SELECT p_partkey, p_name, p_type, p_size FROM part WHERE {where}")


for _name, _args, _where in [
    ("eq", ("p_type", "eq", "SMALL"), "p_type = 'SMALL'"), ("neq", ("p_type", "neq", "SMALL"), "p_type <> 'SMALL'"),
    ("gt", ("p_size", "gt", 25), "p_size > 25"), ("gte", ("p_size", "gte", 25), "p_size >= 25"), ("lt", ("p_size", "lt", 25), "p_size < 25"), ("lte", ("p_size", "lte", 25), "p_size <= 25"),
    ("in", ("p_type", "in", ["SMALL", "ECONOMY"]), "p_type IN ('SMALL', 'ECONOMY')"), ("not_in", ("p_type", "not_in", ["SMALL", "ECONOMY"]), "p_type NOT IN ('SMALL', 'ECONOMY')"), ("in_empty", ("p_type", "in", []), "false"),
    ("contains", ("p_name", "contains", "ring"), "contains(p_name, 'ring')"), ("prefix", ("p_name", "has_prefix", "red"), "starts_with(p_name, 'red')"), ("suffix", ("p_name", "has_suffix", "ring"), "ends_with(p_name, 'ring')"),
    ("equal_fold", ("p_name", "equal_fold", "SMALL Ring"), "lower(p_name) = 'small ring'"), ("contains_fold", ("p_name", "contains_fold", "RING"), "contains(lower(p_name), 'ring')"),
]:
    part_filter(f"filter_{_name}", lambda args=_args: B.where(*args), _where)
part_filter("filter_or", lambda: B.any_of(B.where("p_size", "lt", 5), B.where("p_type", "eq", "SMALL")), "p_size < 5 OR p_type = 'SMALL'")
part_filter("filter_and", lambda: B.all_of(B.where("p_size", "lt", 25), B.where("p_type", "eq", "SMALL")), "p_size < 25 AND p_type = 'SMALL'")
part_filter("filter_not", lambda: B.none_of(B.where("p_size", "lt", 25)), "NOT (p_size < 25)")
part_filter("filter_raw_sql", lambda: F.expr("p_size % 7 = 3"), "p_size % 7 = 3")
def _nil() -> Column:
    return F.when(F.col("p_size") > 20, F.col("p_type")).alias("lemma")


add("filter_is_nil", "part", lambda p: p.select("p_partkey", _nil()).where(B.where("lemma", "is_nil")).select("p_partkey"), "SELECT p_partkey FROM part WHERE (CASE WHEN p_size > 20 THEN p_type END) IS NULL")
add("filter_not_nil", "part", lambda p: p.select("p_partkey", _nil()).where(B.where("lemma", "not_nil")), "SELECT p_partkey, p_type AS lemma FROM part WHERE p_size > 20")


def cel(name: str, filter: str, where: str) -> None:
    add(name, "part", lambda p: p.where(predicate(X.bind_filter(filter, PARTS), "p_name", "p_type")).select("p_partkey", "p_name"), f"SELECT p_partkey, p_name FROM part WHERE {where}")


cel("cel_conjunction", "word_type == 'SMALL' && keyword == 'RING'", "p_type = 'SMALL' AND contains(lower(p_name), 'ring')")
cel("cel_in_fold", "word in ['Red Bolt', ' red bolt ', 'small RING']", "lower(p_name) IN ('red bolt', 'small ring')")
FOLDED = "p_name_fold"


def _persisted_fold(p: DataFrame) -> DataFrame:
    """The same words over a written table with a column of folded names, which the scan can filter by."""
    path = f"{fresh_path(p.sparkSession, 'folded')}"
    if not (held := _FOLDED.get(key := (p.sparkSession.sparkContext.applicationId, tuple(p.inputFiles())))):
        p.withColumn(FOLDED, F.lower("p_name")).write.parquet(path)
        held = _FOLDED[key] = path
    words = X.normalize_set(X.bind_filter("word in ['Red Bolt', ' red bolt ', 'small RING']", PARTS)["words"])
    return p.sparkSession.read.parquet(held).where(F.col(FOLDED).isin([w.lower() for w in words])).select("p_partkey", "p_name")


_FOLDED: dict[tuple, str] = {}
add("cel_in_fold_persisted", "part", _persisted_fold, "SELECT p_partkey, p_name FROM part WHERE lower(p_name) IN ('red bolt', 'small ring')")
cel("cel_startswith_contains", "word.startsWith('Ring')", "contains(lower(p_name), 'ring')")
cel("cel_last_slot_wins", "keyword == 'bolt' && word.startsWith('ring')", "contains(lower(p_name), 'ring')")
cel("cel_empty_keyword", "keyword == ''", "true")
cel("cel_blank", "  ", "true")

EVENTS = X.ResourceSchema({"ts": X.Field("timestamp", {">=": "since", "<=": "until"}), "value": X.Field("number", {">=": "least", "<=": "most"}), "user": X.Field("number", {"==": "user"}, X.to_int(64))})


def _event_filter(filter: str) -> Callable[[DataFrame], DataFrame]:
    def run(e: DataFrame) -> DataFrame:
        s, out = X.bind_filter(filter, EVENTS), F.lit(True)
        for slot, column, op in (("since", "ts", "gte"), ("until", "ts", "lte"), ("least", "value", "gte"), ("most", "value", "lte"), ("user", "user_id", "eq")):
            if slot in s:
                x = s[slot]
                out = out & B.PREDICATES[op](F.col(column), F.lit(x.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz") if column == "ts" else x)
        return e.where(out).select("event_id", "user_id")

    return run


add("cel_timestamp_range", "events", _event_filter("ts >= timestamp('2024-01-02T08:00:00+08:00') && ts <= timestamp('2024-01-09T00:00:00.5Z')"), "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts <= TIMESTAMP '2024-01-09 00:00:00.5'")
add("cel_number_range", "events", _event_filter("value >= 10 && value <= 20.5"), "SELECT event_id, user_id FROM events WHERE value >= 10 AND value <= 20.5")
add("cel_int_equality", "events", _event_filter("user == 8"), "SELECT event_id, user_id FROM events WHERE user_id = 8")


def page(name: str, filter: str, order: str, number: int, size: int, where: str, by: str) -> None:
    def run(p: DataFrame) -> DataFrame:
        rows, _ = list_rows(p, PARTS, filter, order, Page(number, size), text="p_name", word_type="p_type", id_column="p_partkey")
        return rows.select("p_partkey", "p_name", "p_retailprice")

    at = Page(number, size).clamp()
    add(name, "part", run, f"SELECT p_partkey, p_name, p_retailprice FROM part WHERE {where} ORDER BY {by} LIMIT {at.size} OFFSET {at.offset}")


_by = "p_retailprice DESC NULLS LAST, p_partkey"
page("page_first", "", "", 1, 25, "true", _by)
page("page_middle", "", "text desc, size", 3, 40, "true", "p_name DESC NULLS LAST, p_size ASC NULLS LAST, p_partkey")
page("page_past_end", "", "", 9999, 100, "true", _by)
page("page_clamped", "", "", 0, 0, "true", _by)
page("cel_conjunction_page", "word_type == 'SMALL' && keyword == 'ring'", "text", 1, 20, "p_type = 'SMALL' AND contains(lower(p_name), 'ring')", "CASE WHEN p_name = 'ring' THEN 0 ELSE 1 END, p_name ASC NULLS LAST, p_partkey")
add("list_total", "part", lambda p: list_rows(p, PARTS, "keyword == 'ring'", text="p_name", word_type="p_type", id_column="p_partkey")[1], "SELECT count(*) AS total FROM part WHERE contains(lower(p_name), 'ring')")


def ranked(name: str, order: str, by: str, boost: str | None = None) -> None:
    """A rank shows the order; windows without a key are for this demonstration on one word type at a time."""

    def run(p: DataFrame) -> DataFrame:
        cols = sort_columns(order, PARTS, F.col("p_name") == boost if boost else None, "p_partkey")
        return p.select("p_partkey", "p_type", F.row_number().over(Window.partitionBy("p_type").orderBy(*cols)).alias("rank"))

    lead = f"CASE WHEN p_name = '{boost}' THEN 0 ELSE 1 END, " if boost else ""
    add(name, "part", run, f"SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY {lead}{by}) AS rank FROM part")


ranked("order_default", "", _by)
ranked("order_two_keys", "text asc, size DESC", "p_name ASC NULLS LAST, p_size DESC NULLS LAST, p_partkey")
ranked("order_desc_tiebreak", "text desc", "p_name DESC NULLS LAST, p_partkey")
ranked("order_exact_first", "size", "p_size ASC NULLS LAST, p_partkey", "small ring")
SIZES = X.ResourceSchema({}, {"s": X.OrderKey("s"), "id": X.OrderKey("p_partkey", False)}, ("s", True), ("id", False))
add(
    "order_nulls_last",
    "part",
    lambda p: p.select("p_partkey", "p_type", F.when(F.col("p_size") > 20, F.col("p_size")).alias("s")).select("p_partkey", F.row_number().over(Window.partitionBy("p_type").orderBy(*sort_columns("s desc", SIZES, None, "p_partkey"))).alias("rank")),
    "SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY CASE WHEN p_size > 20 THEN p_size END DESC NULLS LAST, p_partkey) AS rank FROM part",
)


def _bound(p: DataFrame) -> DataFrame:
    """A request bound in one step."""
    q = bind("word_type == 'SMALL' && keyword == 'ring'", "text desc", PARTS)
    rows = p.where(predicate(q.slots, "p_name", "p_type"))
    return rows.orderBy(*sort_columns(q.order_by, PARTS, None, "p_partkey")).limit(30).select("p_partkey", "p_name")


add("bind_filter_and_order", "part", _bound, "SELECT p_partkey, p_name FROM part WHERE p_type = 'SMALL' AND contains(lower(p_name), 'ring') ORDER BY p_name DESC NULLS LAST, p_partkey LIMIT 30")
add("user_words_list", "events", lambda e: list_rows(e.withColumnRenamed("event_id", "id").withColumnRenamed("event_type", "word").withColumnRenamed("ts", "updated_at"), X.USER_WORDS, "word.startsWith('CL')", "", Page(1, 50), text="word", user_id=8)[0].select("id", "word"), "SELECT event_id AS id, event_type AS word FROM events WHERE user_id = 8 AND contains(lower(event_type), 'cl') ORDER BY ts DESC NULLS LAST, event_id LIMIT 50")


def as_words(p: DataFrame) -> DataFrame:
    """Parts as words: one text in several types, the smallest size counting as the lemma."""
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.lit("en").alias("language"), F.when(F.col("p_size") <= 10, "lemma").otherwise(F.lower("p_type")).alias("word_type"), F.when(F.col("p_size") > 10, F.element_at(F.split("p_name", " "), 2)).alias("lemma"))


_words = "SELECT p_partkey AS id, p_name AS text, CASE WHEN p_size <= 10 THEN 'lemma' ELSE lower(p_type) END AS word_type, CASE WHEN p_size > 10 THEN string_split(p_name, ' ')[2] END AS lemma FROM part"


def _lookup(p: DataFrame) -> DataFrame:
    w = as_words(p)
    return lookup_many(w, w.select("text", "language")).select("id", "text", "word_type")


add("lookup_priority", "part", _lookup, f"SELECT id, text, word_type FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY CASE WHEN word_type = 'lemma' THEN 0 ELSE 1 END, id) AS r FROM ({_words})) WHERE r = 1")


def _forms(p: DataFrame) -> DataFrame:
    rows = forms_by_lemma(as_words(p))
    return rows.select(F.col("__lemma").alias("lemma"), F.array_join(F.transform("forms", lambda f: F.concat(f["text"], F.lit(":"), f["word_type"])), ",").alias("forms"))


add("forms_by_lemma", "part", _forms, f"SELECT lemma, string_agg(text || ':' || word_type, ',' ORDER BY text, word_type) AS forms FROM ({_words}) WHERE lemma IS NOT NULL AND word_type <> 'lemma' GROUP BY lemma")


def _aggs() -> list[tuple[str, Column]]:
    return [B.aggregate("count", name="n"), B.aggregate("sum", "p_size", "sum_size"), B.aggregate("min", "p_size", "min_size"), B.aggregate("max", "p_name", "max_name"), ("p_size", F.round(F.avg("p_size"), 6).alias("mean_size"))]


_agg_sql = "count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sum_size, min(p_size) AS min_size, max(p_name) AS max_name, round(avg(p_size), 6) AS mean_size"
add("agg_by_one", "part", lambda p: B.Query(p).group_by("p_type").aggregate(*_aggs()), f"SELECT p_type, {_agg_sql} FROM part GROUP BY p_type")
add("agg_by_two", "part", lambda p: B.Query(p).group_by("p_type", "p_brand").aggregate(*_aggs()), f"SELECT p_type, p_brand, {_agg_sql} FROM part GROUP BY p_type, p_brand")
add("agg_global", "part", lambda p: B.Query(p).aggregate(*_aggs()), f"SELECT {_agg_sql} FROM part")
add("agg_lines", "lineitem", lambda x: B.Query(x).group_by("l_returnflag", "l_linestatus").aggregate(B.aggregate("count", name="n"), ("l_quantity", F.round(F.sum("l_quantity"), 2).alias("quantity"))), "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL")
add("distinct_select", "part", lambda p: B.Query(p).select("p_type", "p_size").unique().all(), "SELECT DISTINCT p_type, p_size FROM part")
add("count_distinct", "part", lambda p: B.Query(B.Query(p).select("p_name").unique().all()).aggregate(B.aggregate("count", name="n")), "SELECT count(DISTINCT p_name) AS n FROM part")
add("exists_flag", "part", lambda p: B.Query(p).where(B.where("p_size", "gt", 49)).exists(), "SELECT count(*) FILTER (p_size > 49) > 0 AS found FROM part")
add("ids", "part", lambda p: B.Query(as_words(p)).ids(), "SELECT p_partkey AS id FROM part")
add("entities_with_id", "part", lambda p: B.Query(as_words(p)).entities("text").all(), "SELECT p_partkey AS id, p_name AS text FROM part")
add("order_by_fields", "part", lambda p: B.Query(p).order_by("p_name", "p_partkey", down=True).limit(50).select("p_partkey", "p_name").all(), "SELECT p_partkey, p_name FROM part ORDER BY p_name DESC, p_partkey DESC LIMIT 50")
add("intercepted", "part", lambda p: B.Query(p).select("p_partkey").limit(100_000_000).intercept(lambda df: df.where("p_size > 10")).all(), "SELECT p_partkey FROM part WHERE p_size > 10")
add("next_id_watermark", "part", lambda p: M.next_id(p.select(F.col("p_partkey").alias("id"))), "SELECT max(p_partkey) + 1 AS next_id FROM part")
add("table_count", "events", lambda e: B.Query(e).aggregate(B.aggregate("count", name="n")), "SELECT count(*) AS n FROM events")

add("split_lines", "documents", lambda d: d.select("doc_id", F.posexplode(T.split_lines(F.col("text"))).alias("pos", "line")), "SELECT doc_id, i - 1 AS pos, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents))")
_pos = "|".join(T.POS_TAGS)
add(
    "leading_pos", "part", lambda p: p.select("p_partkey", T.leading_pos(F.concat(F.element_at(F.array(*map(F.lit, ["n. ", "VT ", "adj.", "noun. ", "nothing"])), (F.col("p_size") % 5 + 1).cast("int")), "p_name")).alias("x")).select("p_partkey", T.pos_with_dot(F.col("x.pos")).alias("pos"), F.col("x.rest").alias("rest")),
    "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'n.' WHEN 1 THEN 'vt.' WHEN 2 THEN 'adj.' WHEN 3 THEN 'n.' ELSE '' END AS pos, CASE WHEN p_size % 5 = 4 THEN 'nothing' || p_name ELSE p_name END AS rest FROM part",
)
add("tags_dedup", "part", lambda p: p.select("p_partkey", F.array_join(T.tags(F.concat_ws(",", "p_type", "p_name", "p_type")), "|").alias("tags")), "SELECT p_partkey, p_type || '|' || replace(p_name, ' ', '|') AS tags FROM part")
add(
    "exchange_pairs", "part", lambda p: p.select("p_partkey", F.explode(T.exchange_pairs(F.concat(F.lit("p:"), "p_name", F.lit("/0: /s:"), "p_type", F.lit("/x:y:z/"), "p_brand"))).alias("x")).select("p_partkey", "x.code", "x.word"),
    "SELECT p_partkey, unnest(['past', 'plural', 'x', 'other']) AS code, unnest([p_name, p_type, 'y:z', p_brand]) AS word FROM part",
)
add("single_word_filter", "part", lambda p: p.where(T.is_single_word(F.col("p_name"))).select("p_partkey"), "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_name, '[ \\t\\n,;]')")
add("single_word_type", "part", lambda p: p.where(T.is_single_word(F.col("p_type"))).select("p_partkey"), "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_type, '[ \\t\\n,;]')")
add("trim_unicode", "part", lambda p: p.select("p_partkey", T.trim(F.concat(F.lit("\t \n"), "p_name", F.lit(" \t"))).alias("name")), "SELECT p_partkey, p_name AS name FROM part")
add("language_normalize", "documents", lambda d: d.select("doc_id", T.normalize_language(F.upper("lang")).alias("strict"), T.parse_language(F.concat(F.lit(" "), F.upper("lang"))).alias("parsed"), T.code_or_default(F.lit(" ")).alias("blank")), "SELECT doc_id, 'en' AS strict, lang AS parsed, 'en' AS blank FROM documents")
add("json_field_extract", "events", lambda e: e.select("event_id", backup.parsed(F.get_json_object("props", "$.k"), LongType()).alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")


def _entries(d: DataFrame) -> DataFrame:
    """Documents as dictionary entries: every line is a form that the entry names."""
    lines = F.transform(T.split_lines(F.col("text")), lambda x: F.concat(F.lit("p:"), F.replace(x, F.lit("/"), F.lit(" "))))
    return d.select(F.concat(F.lit("w"), "doc_id").alias("word"), F.col("doc_id").alias("ordinal"), F.array_join(lines, "/").alias("exchange"))


add(
    "first_wins_inflection",
    "documents",
    lambda d: lexicon.inflections(_entries(d)).groupBy("lemma", "form_type").agg(F.count("*").alias("forms")),
    "WITH l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: lower(regexp_replace(replace(x, '/', ' '), '^\\s+|\\s+$', '', 'g')))) AS form FROM documents), f AS (SELECT form, min(doc_id) AS owner FROM l WHERE form <> '' GROUP BY form) SELECT 'w' || owner AS lemma, 'past' AS form_type, count(*) AS forms FROM f GROUP BY owner",
)


def _dictionary(p: DataFrame) -> DataFrame:
    """Parts as a dictionary: an even part is a base that names its plural, the odd part after it."""
    k = F.col("p_partkey")
    base = F.concat(F.lit("w"), F.floor(k / 2))
    odd = k % 2 == 1
    raw = p.select(
        k.alias("ordinal"), F.when(odd, F.concat(base, F.lit("s"))).otherwise(base).alias("word"), F.col("p_brand").alias("phonetic"), F.concat(F.lit("n. "), "p_name", F.lit("\nVT to "), F.lower("p_type")).alias("definition"), F.lit(" ").alias("translation"),
        F.lit("zk gk,zk").alias("tag"), F.when(odd, F.lit("0:x")).otherwise(F.concat(F.lit("s:"), base, F.lit("s/s:"), F.upper(base), F.lit("S/1:"), base)).alias("exchange"),
    )
    words = lexicon.build_words(raw)
    return words.select("text", "language", "word_type", "lemma", F.array_join("tags", "|").alias("tags"), F.array_join(F.transform("meanings", lambda m: F.concat(m["pos"], m["text"])), "|").alias("meanings"), F.col("phonetics")[0]["ipa"].alias("ipa"))


add(
    "dictionary_words",
    "part",
    _dictionary,
    "SELECT CASE WHEN p_partkey % 2 = 1 THEN 'w' || (p_partkey // 2) || 's' ELSE 'w' || (p_partkey // 2) END AS text, 'en' AS language, CASE WHEN p_partkey % 2 = 1 AND p_partkey - 1 IN (SELECT p_partkey FROM part) THEN 'plural' ELSE 'lemma' END AS word_type, CASE WHEN p_partkey % 2 = 1 AND p_partkey - 1 IN (SELECT p_partkey FROM part) THEN 'w' || (p_partkey // 2) END AS lemma, 'zk|gk' AS tags, 'n.' || p_name || '|vt.to ' || lower(p_type) AS meanings, p_brand AS ipa FROM part",
)


def _sides(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each user did, and the same under the next user's number, so that both sides have rows of their own."""
    folded = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("created_at"))
    return folded, folded.select((F.col("user_id") + 1).alias("user_id"), "event_type", (F.col("n") + 10).alias("n"), "created_at")


_sides_sql = "WITH t AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS created_at FROM events GROUP BY ALL), s AS (SELECT user_id + 1 AS user_id, event_type, n + 10 AS n, created_at FROM t) SELECT coalesce(t.user_id, s.user_id) AS user_id, coalesce(t.event_type, s.event_type) AS event_type, {n} AS n, coalesce(t.created_at, s.created_at) AS created_at FROM t FULL JOIN s ON t.user_id = s.user_id AND t.event_type = s.event_type"
for _policy, _n in (("update", "coalesce(s.n, t.n)"), ("ignore", "coalesce(t.n, s.n)"), ("add", "CASE WHEN t.n IS NULL THEN s.n ELSE t.n + coalesce(s.n, 0) END")):
    add(f"upsert_{_policy}", "events", lambda e, policy=_policy: M.upsert(*_sides(e), ["user_id", "event_type"], policy, ("n",)), _sides_sql.format(n=_n))
add("update_where", "part", lambda p: M.update_where(p.select("p_partkey", "p_type", "p_size"), F.col("p_size") > 25, {"p_type": F.lit("BIG")}), "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'BIG' ELSE p_type END AS p_type, p_size FROM part")
add("append_array", "part", lambda p: M.append_array(p.select("p_partkey", F.split("p_name", " ").alias("tags")), F.col("p_partkey") % 2 == 0, "tags", ["new"]).select("p_partkey", F.array_join("tags", "|").alias("tags")), "SELECT p_partkey, replace(p_name, ' ', '|') || CASE WHEN p_partkey % 2 = 0 THEN '|new' ELSE '' END AS tags FROM part")
add("delete_where", "part", lambda p: M.delete_where(p.select("p_partkey", "p_size"), F.col("p_size") > 25), "SELECT p_partkey, p_size FROM part WHERE NOT (p_size > 25)")
add("insert_ids", "part", lambda p: M.with_ids(p.select("p_name", "p_partkey"), 1000, ["p_partkey"]), "SELECT 999 + row_number() OVER (ORDER BY p_partkey) AS id, p_name, p_partkey FROM part")


USERS = "id long, user_id long, word string, language string, mastery_overall int, query_count long, notes string, created_by string, created_at timestamp, updated_at timestamp"


def _collected(e: DataFrame) -> DataFrame:
    return e.select("user_id", F.col("event_type").alias("word"), F.col("event_id").alias("ordinal"), F.lit("").alias("language"), F.get_json_object("props", "$.k").alias("notes"), F.floor("value").cast("int").alias("mastery_overall"))


def _collect(e: DataFrame, users: DataFrame) -> DataFrame:
    rows = M.collect_words(users, _collected(e), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return rows.select("id", "user_id", "word", "language", "query_count", "notes", "mastery_overall", "created_by")


add("collect_fold", "events", lambda e: _collect(e, e.sparkSession.createDataFrame([], USERS)), "SELECT row_number() OVER (ORDER BY user_id, event_type) AS id, user_id, event_type AS word, 'en' AS language, count(*) AS query_count, arg_max(json_extract_string(props, '$.k'), event_id) AS notes, CAST(floor(arg_max(value, event_id)) AS INTEGER) AS mastery_overall, 'user' AS created_by FROM events GROUP BY user_id, event_type")


def _collect_again(e: DataFrame) -> DataFrame:
    """Into a table that has every user's word but sign-ups, and a word that nobody collects."""
    known = e.where("event_type <> 'signup'").groupBy("user_id", F.col("event_type").alias("word")).agg(F.min("event_id").alias("id"))
    other = e.agg((F.max("event_id") + 1).alias("id")).select("id", F.lit(-1).cast("long").alias("user_id"), F.lit("unseen").alias("word"))
    users = known.unionByName(other).select("id", "user_id", "word", F.lit("fr").alias("language"), F.lit(7).alias("mastery_overall"), F.lit(5).cast("long").alias("query_count"), F.lit("old").alias("notes"), F.lit("x").alias("created_by"), *(F.lit("2020-01-01").cast("timestamp").alias(c) for c in ("created_at", "updated_at")))
    return _collect(e, users)


add(
    "collect_existing",
    "events",
    _collect_again,
    "WITH f AS (SELECT user_id, event_type AS word, min(event_id) AS first, count(*) AS n, arg_max(json_extract_string(props, '$.k'), event_id) AS notes, CAST(floor(arg_max(value, event_id)) AS INTEGER) AS overall FROM events GROUP BY ALL), m AS (SELECT max(event_id) + 1 AS top FROM events) SELECT first AS id, user_id, word, 'fr' AS language, n + 5 AS query_count, notes, overall AS mastery_overall, 'x' AS created_by FROM f WHERE word <> 'signup' UNION ALL SELECT top, -1, 'unseen', 'fr', 5, 'old', 7, 'x' FROM m UNION ALL SELECT top + row_number() OVER (ORDER BY user_id), user_id, word, 'en', n, notes, overall, 'user' FROM f, m WHERE word = 'signup'",
)


add(
    "backup_hash",
    "events",
    lambda e: e.select(F.sha2(backup.record("events", e), 256).alias("line_hash")),
    """SELECT sha256('{"type":"events","payload":{"event_id":' || event_id || ',"ts":"' || regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0*$', '') || 'Z","user_id":' || user_id || ',"event_type":"' || event_type || '","value":' || value || ',"props":' || to_json(props) || '}}') AS line_hash FROM events""",
)


def _exported(e: DataFrame, table: str = "events") -> str:
    path = fresh_path(e.sparkSession, "backup")
    backup.export({table: e}, path)
    return path


def _round_trip(e: DataFrame) -> DataFrame:
    return backup.import_tables(e.sparkSession, _exported(e), {"events": e.limit(0)})["events"]


def _import(e: DataFrame) -> DataFrame:
    """All events into a table that has their doubles under twice the number, half of which are in the backup."""
    target = e.select((F.col("event_id") * 2).alias("event_id"), "ts", "user_id", F.lit("old").alias("event_type"), "value", "props")
    return backup.import_tables(e.sparkSession, _exported(e), {"events": target})["events"]


add("backup_roundtrip", "events", _round_trip, "SELECT event_id, ts, user_id, event_type, value, props FROM events")
add("backup_import", "events", _import, "SELECT event_id, ts, user_id, event_type, value, props FROM events UNION ALL SELECT event_id * 2, ts, user_id, 'old', value, props FROM events WHERE event_id * 2 NOT IN (SELECT event_id FROM events)")
add("backup_export", "events", lambda e: backup.read_records(e.sparkSession, _exported(e)).select("type", F.coalesce(F.get_json_object("payload", "$.event_id").cast("long"), F.lit(-1)).alias("event_id")), "SELECT 'events' AS type, event_id FROM events UNION ALL SELECT 'meta', -1")


def _words(p: DataFrame):
    """A fresh store with a lemma row for every name, and a row for every name and type."""
    from wordloom.operators.services import WordService
    from wordloom.sources.store import Store

    words = WordService(Store(p.sparkSession, fresh_path(p.sparkSession, "store")))
    names = p.select(F.col("p_name").alias("text"), F.lit("lemma").alias("word_type"), F.lit(None).cast("string").alias("lemma"))
    types = p.select(F.col("p_name").alias("text"), F.lower("p_type").alias("word_type"), F.element_at(F.split("p_name", " "), 2).alias("lemma"))
    words.create_many(names.union(types).distinct().withColumn("language", F.lit("")))
    return words


_stored = "(SELECT row_number() OVER (ORDER BY text, word_type) AS id, * FROM (SELECT DISTINCT p_name AS text, 'lemma' AS word_type, NULL AS lemma FROM part UNION SELECT p_name, lower(p_type), string_split(p_name, ' ')[2] FROM part))"
_columns = ("id", "text", "language", "word_type", "lemma")


def _updated(p: DataFrame) -> DataFrame:
    words = _words(p)
    words.update({"id": 2, "text": " changed ", "language": "xx", "word_type": "past", "lemma": "change"})
    return words.rows().select(*_columns)


def _deleted(p: DataFrame) -> DataFrame:
    words = _words(p)
    words.delete(3)
    return words.rows().select(*_columns)


add("service_create", "part", lambda p: _words(p).rows().select(*_columns), f"SELECT id, text, 'en' AS language, word_type, lemma FROM {_stored}")
add("service_list", "part", lambda p: _words(p).list("keyword == 'RING' && word_type == 'lemma'", "text desc")[0].select(*_columns), f"SELECT id, text, 'en' AS language, word_type, lemma FROM {_stored} WHERE contains(lower(text), 'ring') AND word_type = 'lemma' ORDER BY text DESC, id LIMIT 20")
add("service_update", "part", _updated, f"SELECT id, CASE WHEN id = 2 THEN 'changed' ELSE text END AS text, 'en' AS language, CASE WHEN id = 2 THEN 'past' ELSE word_type END AS word_type, CASE WHEN id = 2 THEN 'change' ELSE lemma END AS lemma FROM {_stored}")
add("service_delete", "part", _deleted, f"SELECT id, text, 'en' AS language, word_type, lemma FROM {_stored} WHERE id <> 3")


def _users(e: DataFrame):
    from wordloom.operators.services import UserWordService
    from wordloom.sources.store import Store

    users = UserWordService(Store(e.sparkSession, fresh_path(e.sparkSession, "store")))
    users.collect_many(_collected(e))
    return users


_user_columns = ("id", "user_id", "word", "query_count", "mastery_read", "mastery_overall")
_user_sql = "(SELECT row_number() OVER (ORDER BY user_id, event_type) AS id, user_id, event_type AS word, count(*) AS query_count, CAST(0 AS SMALLINT) AS mastery_read, CAST(floor(arg_max(value, event_id)) AS INTEGER) AS mastery_overall FROM events GROUP BY user_id, event_type)"


def _mastered(e: DataFrame) -> DataFrame:
    users = _users(e)
    row = users.rows().where("id = 5").first()
    users.update_mastery(row.user_id, 5, {"read": 3, "overall": 180})
    return users.rows().select(*_user_columns)


def _user_deleted(e: DataFrame) -> DataFrame:
    users = _users(e)
    users.delete(users.rows().where("id = 6").first().user_id, 6)
    return users.rows().select(*_user_columns)


add("service_collect", "events", lambda e: _users(e).rows().select(*_user_columns), f"SELECT * FROM {_user_sql}")
add("service_mastery", "events", _mastered, f"SELECT id, user_id, word, query_count, CASE WHEN id = 5 THEN CAST(3 AS SMALLINT) ELSE mastery_read END AS mastery_read, CASE WHEN id = 5 THEN 180 ELSE mastery_overall END AS mastery_overall FROM {_user_sql}")
add("service_user_delete", "events", _user_deleted, f"SELECT * FROM {_user_sql} WHERE id <> 6")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
