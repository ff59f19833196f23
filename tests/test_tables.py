import pytest
from pyspark.sql import functions as F

from wordloom.errors import BackupError, ConstraintError, NotFound, NotSingular
from wordloom.functions import text as T
from wordloom.operators import mutate as M
from wordloom.operators.builder import Query, aggregate, where
from wordloom.operators.lexicon import build_words
from wordloom.operators.query import lookup
from wordloom.schemas import USER_WORDS, WORDS
from wordloom.sources.backup import export, import_tables, select_tables
from wordloom.sources.jdbc import resolve
from wordloom.sources.store import Store


def words(spark, *rows):
    full = [{f.name: None for f in WORDS} | {"language": "en", "word_type": "lemma", "phonetics": [], "meanings": [], "tags": [], "phrases": [], "sentences": [], "relations": []} | r for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in WORDS) for r in full], WORDS).withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})


def test_leading_pos(spark):
    cases = [("n. a tree", "n.", "a tree"), ("VT to run", "vt.", "to run"), ("noun. thing", "n.", "thing"), ("number one", "", "number one"), ("adj.\tbig", "adj.", "big"), ("  v", "", "v")]
    df = spark.createDataFrame([(a,) for a, _, _ in cases], "x string").select(T.leading_pos(F.col("x")).alias("p"))
    assert [tuple(r) for r in df.select(T.pos_with_dot(F.col("p.pos")), "p.rest").collect()] == [(b, c) for _, b, c in cases]


def test_lookup_and_forms(spark):
    df = words(spark, {"id": 1, "text": "go"}, {"id": 2, "text": "went", "word_type": "past", "lemma": "go"}, {"id": 3, "text": "gone", "word_type": "pp", "lemma": "go"})
    (hit,) = lookup(df, " go ").collect()
    assert (hit.id, [f.text for f in hit.forms]) == (1, ["gone", "went"])
    (bent,) = lookup(df, "went").collect()
    assert bent.forms is None
    assert lookup(df, "Go").isEmpty()


def test_builder(spark):
    q = Query(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, t string"))
    assert q.where(where("t", "eq", "b")).count() == 2 and q.where(where("t", "in", [])).count() == 0
    assert q.group_by("t").aggregate(aggregate("sum", "id", "s")).collect().__len__() == 2
    assert q.intercept(lambda d: d.where("id > 1")).count() == 2
    with pytest.raises(NotFound):
        q.where(where("id", "gt", 9)).first()
    with pytest.raises(NotSingular):
        q.only()
    with pytest.raises(ValueError, match="invalid field"):
        q.select("nope")


def test_lexicon(spark):
    raw = spark.createDataFrame([(1, "go", "gou", "v. move\nn. a try", "vi. 去", "zk gk,zk", "p:went/d:gone"), (2, "went", "wt", "", "", "", ""), (3, "two words", "x", "y", "", "", ""), (4, "empty", "", "", "", "", ""), (5, "Gone", "g", "v. left", "", "", "0:go")], "ordinal int, word string, phonetic string, definition string, translation string, tag string, exchange string")
    got = {r.text: r for r in build_words(raw).collect()}
    assert set(got) == {"go", "went", "Gone"}
    assert [(m.pos, m.text, m.language) for m in got["go"].meanings] == [("v.", "move", "en"), ("n.", "a try", "en"), ("vi.", "去", "zh")]
    assert got["go"].tags == ["zk", "gk"] and (got["went"].word_type, got["went"].lemma) == ("past", "go") and got["Gone"].word_type == "pp"


def test_collect_twice(spark):
    users = spark.createDataFrame([], USER_WORDS)
    events = spark.createDataFrame([(7, " tree ", 1, "en", "first", 100), (7, "tree", 2, "", "", 200), (8, "oak", 3, None, None, None)], "user_id long, word string, ordinal long, language string, notes string, mastery_overall int")
    once = M.collect_words(users, events, F.current_timestamp())
    rows = {r.word: r for r in once.collect()}
    assert (rows["tree"].query_count, rows["tree"].notes, rows["tree"].mastery_overall, rows["tree"].created_by) == (2, "first", 200, "user")
    again = {r.word: r for r in M.collect_words(once, events.where("user_id = 8"), F.current_timestamp()).collect()}
    assert again["oak"].query_count == 2 and len(again) == 2 and sorted(r.id for r in again.values()) == [1, 2]


def test_store_and_backup(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    df = words(spark, {"id": 1, "text": "go"}, {"id": 2, "text": "went", "word_type": "past", "lemma": "go"})
    store.write({"words": df})
    assert store.next_id("words") == 3 and store.read("words").count() == 2
    with pytest.raises(ConstraintError):
        store.write({"words": df.union(words(spark, {"id": 3, "text": "go"}))})
    with pytest.raises(ConstraintError):
        store.write({"words": words(spark, {"id": 1, "text": "x", "lemma": "y"})})
    assert store.read("words").count() == 2
    path = f"file://{tmp_path}/backup"
    assert export({"words": store.read("words")}, path, gzip=True) == {"words": 2}
    back = import_tables(spark, path, {"words": spark.createDataFrame([], WORDS)}, strict_hash=True)["words"]
    assert sorted(map(str, back.collect())) == sorted(map(str, store.read("words").collect()))
    with pytest.raises(BackupError):
        select_tables(["nope"])


def test_resolve():
    assert resolve("postgres://h/d")[0] == "jdbc" and resolve("a.db") == ("sqlite", {"path": "a.db"}) and resolve("/x/y") == ("parquet", {"path": "/x/y"})
    assert resolve("host=h dbname=d user=u")[1]["url"] == "jdbc:postgresql://h:5432/d"


def test_upsert_model(spark):
    t = spark.createDataFrame([(1, 10, 5), (2, 20, 5)], "k int, n int, created_at int")
    s = spark.createDataFrame([(2, 7, 9), (3, 30, 9)], "k int, n int, created_at int")
    rows = lambda policy: sorted(tuple(r) for r in M.upsert(t, s, ["k"], policy, ("n",)).collect())
    assert rows("update") == [(1, 10, 5), (2, 7, 5), (3, 30, 9)]
    assert rows("ignore") == [(1, 10, 5), (2, 20, 5), (3, 30, 9)]
    assert rows("add") == [(1, 10, 5), (2, 27, 5), (3, 30, 9)]
