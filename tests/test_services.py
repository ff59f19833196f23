"""Requests, hooks, mutations with counts, data sources and the command line."""

import io
import json
import sqlite3
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from wordloom import cli
from wordloom.errors import BackupError, ConstraintError, InvalidInput, NotFound, NotSingular, Rejected
from wordloom.functions import text as T
from wordloom.operators import builder as B
from wordloom.operators import hooks as H
from wordloom.operators import mutate as M
from wordloom.operators.lexicon import inflections, load_source
from wordloom.operators.query import Page
from wordloom.operators.services import UserWordService, WordService
from wordloom.plans.filterexpr import WORDS as WORD_FIELDS
from wordloom.plans.ordering import bind
from wordloom.schemas import USER_WORDS, WORDS
from wordloom.sources import backup, jdbc
from wordloom.sources.store import Store, ddl
from wordloom.streaming.collect import collect_stream


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_words(store):
    words = WordService(store, lambda: datetime(2024, 1, 1, tzinfo=UTC))
    go = words.create({"text": " go ", "tags": ["zk"]})
    went = words.create({"text": "went", "word_type": "past", "lemma": " go ", "language": "XX"})
    assert (go.id, go.text, go.language, go.word_type, go.lemma, go.tags) == (1, "go", "en", "lemma", None, ["zk"])
    assert (went.id, went.lemma, went.language) == (2, "go", "en")
    assert [f.text for f in words.lookup("go").first().forms] == ["went"] and words.lookup("nope").isEmpty()
    for bad in ({"text": " "}, {"text": "x", "word_type": "past"}):
        with pytest.raises(InvalidInput):
            words.create(bad)
    with pytest.raises(ConstraintError):
        words.create({"text": "go"})
    changed = words.update({"id": 1, "text": "go", "lemma": "ignored", "meanings": [{"pos": "v.", "text": "move", "language": "en"}]})
    assert changed.tags == [] and changed.lemma is None and changed.meanings[0].text == "move" and words.get(1) == changed
    rows, total = words.list("keyword == 'GO'", "text", Page(1, 10))
    assert [r.id for r in rows.collect()] == [1] and total.first().total == 1
    words.delete(2)
    for call in (lambda: words.delete(2), lambda: words.get(2), lambda: words.update({"id": 2, "text": "x"})):
        with pytest.raises(NotFound, match="word not found"):
            call()
    for call in (lambda: words.get(0), lambda: words.delete(-1), lambda: words.update({"text": "x"}), lambda: words.lookup("  ")):
        with pytest.raises(InvalidInput):
            call()
    assert words.create({"text": "new"}).id == 3  # the id of a deleted row isn't given again


def test_user_words(store):
    at = [datetime(2024, 1, 1, 12, tzinfo=UTC)]
    users = UserWordService(store, lambda: at[0])
    hello = users.collect(42, {"word": " Hello ", "created_by": "tester"})
    assert (hello.id, hello.word, hello.query_count, hello.language, hello.created_by) == (1, "Hello", 1, "en", "tester")
    users.collect(1, {"word": "Apple", "mastery_read": 4, "notes": "first"})
    at[0] = datetime(2024, 1, 3, 9, tzinfo=UTC)
    again = users.collect(1, {"word": "Apple", "notes": "updated", "mastery_overall": 250, "language": "fr"})
    assert (again.id, again.query_count, again.notes, again.mastery_overall, again.mastery_read, again.language) == (2, 2, "updated", 250, 0, "fr")
    assert again.updated_at > again.created_at and users.collect(1, {"word": "apple"}).id == 3
    done = users.update_mastery(42, 1, {"listen": 2, "read": 3, "overall": 180}, {"review_interval_days": 2}, "keep going")
    assert (done.mastery_listen, done.mastery_read, done.mastery_overall, done.review_interval_days, done.notes) == (2, 3, 180, 2, "keep going")
    with pytest.raises(ValueError, match="out of range"):
        users.update_mastery(42, 1, {"listen": 40_000})
    for call in (lambda: users.update_mastery(7, 1, {}), lambda: users.update_mastery(42, 0, {}), lambda: users.delete(42, 2), lambda: users.delete(1, 99)):
        with pytest.raises(NotFound, match="user word not found"):
            call()
    with pytest.raises(InvalidInput):
        users.collect(1, {"word": "　"})
    assert [r.word for r in users.list(1, "keyword == 'apple'")[0].collect()] == ["Apple", "apple"] and users.list(1, "keyword == 'upd'")[1].first().total == 0
    users.delete(1, 2)
    assert users.list(1)[1].first().total == 1


def test_collect_replaces_as_a_whole(spark):
    kind = "user_id long, word string, ordinal long, language string, notes string, mastery_read int, mastery_overall int"
    events = spark.createDataFrame([(1, "a　", 1, "XX", "n", 5, 9), (1, "a", 2, " ", "", None, 3), (1, None, 3, "en", "x", 1, 1), (2, "b", 1, None, None, 2, 2)], kind)
    rows = {r.word: r for r in M.collect_words(spark.createDataFrame([], USER_WORDS), events, F.current_timestamp(), 10).collect()}
    assert {w: (r.id, r.query_count, r.language, r.notes, r.mastery_read, r.mastery_overall, r.sentences) for w, r in rows.items()} == {"a": (10, 2, "en", "n", 0, 3, []), "b": (11, 1, "en", None, 2, 2, [])}


@pytest.mark.parametrize(("rows", "width", "size"), [(400_000, 8, "1k"), (500_000, 256, "64m")])
def test_ids_of_many_partitions(spark, rows, width, size):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    try:
        made = spark.range(rows).select(F.xxhash64("id").alias("k"), F.expr(f"repeat(cast(id % 10 as string), {width})").alias("pad"))
        got = M.with_ids(made, 7, ["k"])
        assert tuple(got.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id")).first()) == (rows, rows, 7, rows + 6)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_counts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, t string")
    new, n = M.update_counted(df, F.col("t") == "b", {"t": F.lit("c")})
    assert n == 2 and new.where("t = 'c'").count() == 2
    left, n = M.delete_counted(df, F.col("t") == "b")
    assert n == 2 and [r.id for r in left.collect()] == [1]
    with pytest.raises(NotFound):
        M.affected(M.delete_counted(df, F.col("id") == 9))


def test_hooks(store):
    words, seen = WordService(store), []
    note = lambda name: lambda then: lambda m: (seen.append((name, m.op)), then(m))[1]
    words.mutators.use("words", note("outer"), H.on(note("inner"), H.CREATE), H.unless(note("not made"), H.CREATE), H.reject(H.DELETE_ONE))
    words.create({"text": "a"})
    words.update({"id": 1, "text": "b"})
    with pytest.raises(Rejected):
        words.delete(1)
    assert seen == [("outer", "create"), ("inner", "create"), ("outer", "update_one"), ("not made", "update_one"), ("outer", "delete_one"), ("not made", "delete_one")]
    m = H.Mutation(H.UPDATE, "t", None, frozenset({"x", "y"}), frozenset({"y"}))
    assert H.every(H.has_op(H.UPDATE), H.has_fields("x"), H.has_added("y"), H.never(H.has_cleared("x")))(m) and not H.some(H.has_op(H.CREATE), H.has_added("x"))(m)


def test_builder_readers(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", 1.5)], "id int, t string, x double")
    q = B.Query(df)
    assert q.scalars("strings", "t") == ["a", "b"] and q.where(F.col("id") == 2).scalar("float64s", "x") == 1.5
    assert q.order_by("id", down=True).first_id() == 2 and q.where(F.col("id") == 1).only_id() == 1
    assert q.limit(1).intercept(lambda d: d.where("id = 2")).ids().collect()[0].id == 2 and q.entities("t").all().columns == ["id", "t"]
    with pytest.raises(TypeError):
        q.scalars("ints", "t")
    with pytest.raises(NotSingular):
        q.scalar("ints", "id")
    with pytest.raises(NotFound):
        q.where(F.col("id") == 9).only_id()
    with pytest.raises(ValueError, match="invalid field"):
        q.order_by("nope")


def test_bind():
    q = bind("keyword == 'a'", "text desc", WORD_FIELDS)
    assert q.slots == {"keyword": "a"} and q.order_by == "text desc, id asc"
    with pytest.raises(ValueError, match="must not be nil"):
        bind("", "", None)


def test_forms_of_an_entry(spark):
    entries = spark.createDataFrame([(1, "read", "p:read/1:lead"), (2, "reed", "s:Read/p:lead/p:LEAD/0:x"), (3, "run", "p:ran/p:Ran/ p :run")], "ordinal int, word string, exchange string")
    got = {r.form: (r.lemma, r.form_type) for r in inflections(entries).collect()}
    assert got == {"lead": ("read", "variant"), "read": ("reed", "plural"), "ran": ("run", "past")}
    pairs = entries.where("ordinal = 3").select(T.exchange_pairs(F.col("exchange")).alias("p")).first().p
    assert [tuple(p) for p in pairs] == [("past", "ran"), ("p ", "run")]  # codes are taken as they are written
    empty = spark.createDataFrame([("",), (None,)], "x string").select(F.size(T.exchange_pairs(F.col("x"))).alias("n"))
    assert [r.n for r in empty.collect()] == [0, 0]


def test_names(spark):
    df = spark.createDataFrame([("LANGUAGE_ENGLISH", "zh"), ("korean", "XX"), ("x", None)], "a string, b string")
    assert [tuple(r) for r in df.select(T.language_code(F.col("a")), T.language_name(F.col("b")), T.definition_language(F.col("b"))).collect()] == [("en", "chinese", "zh"), ("ko", "unspecified", "en"), ("", "unspecified", "en")]
    assert T.cache_name("http://h/a.zip").endswith("-a.zip") and len(T.cache_name("http://h/a.zip").split("-")[0]) == 8


def line(table, **payload):
    return json.dumps({"type": table, "payload": payload})


META = json.dumps({"type": "meta", "version": 1, "tables": ["t"]})


@pytest.fixture
def imported(spark, tmp_path):
    def run(*lines, target=()):
        at = tmp_path / f"in-{len(list(tmp_path.iterdir()))}.jsonl"
        at.write_text("\n".join(lines))
        have = spark.createDataFrame(list(target), "id long, n int, x double, b boolean, s string, at timestamp, tags array<string>, raw binary")
        return {r.id: r for r in backup.import_tables(spark, str(at), {"t": have})["t"].collect()}

    return run


def test_import_values(imported):
    full = {"x": "1.5", "b": "TRUE", "s": "é", "at": "2025-01-01T08:00:00.5+08:00", "tags": ["a"], "raw": "aGk="}
    got = imported(line("t", id="5", n="7", **full), META, line("other", z=1), line("t", id=6, at="2025-01-01T00:00:00Z", tags='["q"]', b=2), line("t", id=7, n=None, at="2025-01-01T00:00:00Z"), line("t", id=7, n=8, at="2025-01-02T00:00:00Z"))
    assert (got[5].n, got[5].x, got[5].b, got[5].s, got[5].tags, bytes(got[5].raw)) == (7, 1.5, True, "é", ["a"], b"hi")
    assert got[5].at.isoformat().endswith("00:00:00.500000")
    assert (got[6].n, got[6].x, got[6].b, got[6].s, got[6].tags) == (0, 0.0, True, "", ["q"]) and got[7].n == 8
    old = (1, 4, 2.5, True, "keep", datetime(2025, 1, 1), ["t"], None)
    assert imported(META, line("t", id=1, n=9, at="2025-01-01T00:00:00Z"), target=[old])[1].s == "keep"


@pytest.mark.parametrize(
    ("lines", "says"),
    [
        ([line("t", id="abc", at="2025-01-01T00:00:00Z"), META], "t.id"), ([line("t", id=1, n="oops", at="2025-01-01T00:00:00Z"), META], "t.n"), ([line("t", id=1, n=1.5, at="2025-01-01T00:00:00Z"), META], "t.n"), ([line("t", id=1, n=3_000_000_000, at="2025-01-01T00:00:00Z"), META], "t.n"),
        ([line("t", id=1, at="yesterday"), META], "t.at"), ([line("t", id=1, at=""), META], "missing required value for t.at"), ([line("t", id=1, b="maybe", at="2025-01-01T00:00:00Z"), META], "t.b"), ([line("t", id=1, z=1), META], "column z not found"),
        (["{", META], "decode record"), ([line("t", id=1, at="2025-01-01T00:00:00Z")], "missing meta"), ([json.dumps({"type": "meta", "version": 2})], "unsupported format version"), ([json.dumps({"type": "t"}), META], "missing payload"),
    ],
)
def test_import_errors(imported, lines, says):
    with pytest.raises(BackupError, match=says):
        imported(*lines)


def test_export_is_in_utc(spark, tmp_path):
    df = spark.sql("SELECT 1L AS id, timestamp_micros(1735689600000000) AS at, timestamp_micros(-500000) AS before, TIMESTAMP_NTZ '2025-01-01 10:00:00.120' AS plain, array(named_struct('t', timestamp_micros(1))) AS deep, cast(null as timestamp) AS none, cast('hi' as binary) AS raw")
    held = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("Asia/Tokyo", "UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = json.loads(df.select(backup.record("t", df)).first()[0])["payload"]
            assert got == {"id": 1, "at": "2025-01-01T00:00:00Z", "before": "1969-12-31T23:59:59.5Z", "plain": "2025-01-01T10:00:00.12Z", "deep": [{"t": "1970-01-01T00:00:00.000001Z"}], "none": None, "raw": "aGk="}
            path = str(tmp_path / zone.replace("/", "-"))
            backup.export({"t": df.drop("none")}, path)
            back = backup.import_tables(spark, path, {"t": df.drop("none").limit(0)}, progress=backup.Printed(io.StringIO()))["t"].select("at", "plain", F.unix_micros("at").alias("n")).first()
            assert back.n == 1735689600000000 and back.plain == datetime(2025, 1, 1, 10, 0, 0, 120000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    with sqlite3.connect(tmp_path / "dict.db") as db:
        db.execute("CREATE TABLE stardict (word, phonetic, definition, pos, translation, exchange, tag, collins)")
        db.executemany("INSERT INTO stardict VALUES (?,?,?,?,?,?,?,?)", [("go", "gou", "v. move", None, "vi. 去", "p:went", "zk", 1), ("went", "wt", None, None, None, None, None, 2), ("no use", "x", None, None, None, None, None, 3)])
    at = ["--store", f"file://{tmp_path}/store"]
    assert cli.run(spark, [*at, "db-init", "--schema-only"]) == 0 and "CREATE TABLE words" in capsys.readouterr().out and ddl().count("CREATE TABLE") == 2
    for _ in range(2):  # the second time finds the same rows
        assert cli.run(spark, [*at, "db-init", "--source", str(tmp_path / "dict.db")]) == 2
    store = Store(spark, at[1])
    assert sorted((r.id, r.text, r.word_type) for r in store.read("words").collect()) == [(1, "go", "lemma"), (2, "went", "past")]
    out = str(tmp_path / "b.jsonl.gz")
    assert cli.run(spark, [*at, "export", "-o", out, "--tables", " Words "]) == 2
    other = ["--store", f"file://{tmp_path}/other"]
    assert cli.run(spark, [*other, "import", "-i", out]) == 2
    assert sorted(map(str, Store(spark, other[1]).read("words").collect())) == sorted(map(str, store.read("words").collect()))
    monkeypatch.chdir(tmp_path)
    assert backup.export_stream({"words": store.read("words")}).startswith("wordloom-backup-")
    text = io.BytesIO()
    monkeypatch.setattr("sys.stdout", type("Out", (), {"buffer": text, "write": lambda *_: 0, "flush": lambda *_: None})())
    backup.export_stream({"words": store.read("words")}, "-")
    assert len(text.getvalue().splitlines()) == 3
    monkeypatch.setattr("sys.stdin", type("In", (), {"buffer": io.BytesIO(text.getvalue())})())
    with backup.received(spark, "-") as path:
        assert backup.import_tables(spark, path, {"words": spark.createDataFrame([], WORDS)})["words"].count() == 2
    with pytest.raises(ValueError, match="lacks the columns"):
        spark.range(1).write.parquet(str(tmp_path / "few"))
        load_source(spark, str(tmp_path / "few"))


def test_collect_stream(spark, store, tmp_path):
    kind = "user_id long, word string, ordinal long, language string, notes string, mastery_overall int"
    spark.createDataFrame([(1, "a", 1, "fr", None, 5), (1, "b", 2, None, "n", 6)], kind).write.parquet(str(tmp_path / "in"))
    run = lambda: collect_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), store, str(tmp_path / "checkpoint")).awaitTermination()
    run()
    spark.createDataFrame([(1, "a", 3, None, "later", 9)], kind).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()  # nothing new
    got = {r.word: (r.id, r.query_count, r.language, r.notes, r.mastery_overall) for r in store.read("user_words").collect()}
    assert got == {"a": (1, 2, "fr", "later", 9), "b": (2, 1, "en", "n", 6)}


def test_sqlite_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", [f"x{i}"]) for i in range(2500)], "id long, text string, tags array<string>")
    path = f"sqlite://{tmp_path}/w.db"
    jdbc.write_source(df, path, "words", "overwrite")
    assert sorted(jdbc.read_source(spark, path, "words", df.schema).collect()) == sorted(df.collect())
    assert jdbc.read_sqlite(spark, f"{tmp_path}/w.db", "words", 1000).rdd.getNumPartitions() == 3
    with pytest.raises(ValueError, match="no table"):
        jdbc.read_source(spark, path, "nope")
    jdbc.write_source(df, f"{tmp_path}/out.csv".replace(".csv", ".json"), "")
    assert jdbc.read_source(spark, f"{tmp_path}/out.json", "", df.schema).count() == 2500
