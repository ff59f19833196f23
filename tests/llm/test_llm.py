import base64
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.llm import byte_bpe, chat_format, decontaminate, image_copies, jaccard_join, language_id, license_scan, queries, token_archive, toxicity, warc
from wordloom.llm.components import connected_components

ODD = [None, "", " ", "\n\n", "a", "it's don't", "x" * 5000, "    y", "héé***  çà,, 12", "日本 語", "<|endoftext|>", "a b c d e", "a b c d e"]


def frame(spark, texts, extra="x"):
    return spark.createDataFrame([(i, t, extra) for i, t in enumerate(texts)], "doc_id long, text string, n long" if extra is None else "doc_id long, text string, id string")


def test_bpe_like_the_library(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    bpe = byte_bpe.load(path, pattern)
    got = {r.doc_id: r for r in byte_bpe.round_trip_digests(frame(spark, ODD), path, pattern).withColumnRenamed("id", "doc_id").collect()}
    for i, t in enumerate(ODD):
        ids = np.array(bpe.engine.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.round_trip_digests(frame(spark, ODD).limit(0), path, pattern).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 1'\n\t.sé ", max_size=300))
def test_bpe_chunks(text):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        small = test_bpe_chunks.__dict__.setdefault("bpe", byte_bpe.ChunkedBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, public_tokenizers.PATTERN, 16, 4))
    assert "".join(small.pretokens(text)) == text
    assert small.encode(text).tolist() == small.engine.encode_ordinary(text)
    assert small.decode(small.encode(text)) == text.encode()


def test_token_archive(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = [*ODD, "The WORDS, of*** (a) thing!! 'quoted' 5,000 élan### …%%%"]
    place, manifest, dictionary = token_archive.write_archive(frame(spark, texts), path, 2)
    got = sorted(token_archive.digest(token_archive.read_archive(place, manifest, dictionary)).collect())
    start = 0
    for r, t in zip(got, texts, strict=True):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    arrays = [np.arange(5, dtype="<u4"), np.array([70_000], "<u4"), np.zeros(0, "<u4")]
    raw = token_archive.encode_file([3, 7, 9], arrays, dictionary)
    reader = token_archive.FileReader(lambda at, n: raw[at : at + n], len(raw), dictionary)
    assert reader.find(7).tolist() == [70_000] and reader.find(8) is None
    with pytest.raises(ValueError, match="another dictionary"):
        token_archive.FileReader(lambda at, n: raw[at : at + n], len(raw), b"x")


def test_token_archive_query_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*ODD, "foo <|endoftext|> bar", "Foo<|endoftext|>bar.", "<|ENDOFTEXT|>", "it's<|startoftext|>'s <|endoftext|>", "<|endoftext|><|endoftext|>", "x<|endoftext |>", "a\u2028<|endoftext|>!! e\u0301<|endoftext|>\u0301", "<|endoftext<|endoftext|>|>"]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    start = 0
    for r, t in zip(sorted(queries.op5_token_archive(spark, str(tmp_path)).collect()), texts, strict=True):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_language_id(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("the house", "en"), ("la maison", "fr"), (None, "en"), ("x", None)] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    asked = frame(spark, ["the dog", "le chiens", None, "", "123 !!", "THE!! cat|dog", "日本"])
    got = [(r.lang_pred, r.score) for r in language_id.predict(asked, model).orderBy("doc_id").collect()]
    assert [x for x, _ in got[:6]] == ["en", "fr", "und", "und", "und", "en"] and got[6][0] in ("en", "fr") and all(0 <= s <= 1 for _, s in got)
    assert [r.lang_pred for r in language_id.predict(asked, language_id.fit(docs.limit(0))).collect()] == ["und"] * 7


def test_toxicity(spark):
    good, bad = ["what a lovely day in the park"] * 30, ["you are such an idiot today", "idiot go away"] * 10
    docs = frame(spark, good + bad + ["1d10t you", "i d i o t", "idiooot", "i.d.i.o.t", None, "", "lovely day"])
    labels = spark.createDataFrame([(i, int(i >= 30)) for i in range(50)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert [got[i].predicted for i in (0, 31, 50, 51, 52, 53, 54, 55, 56)] == [0, 1, 1, 1, 1, 1, 0, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 57
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0)))
    assert none.where("score > 0").count() == 0


@pytest.fixture(scope="module")
def toxic_words(spark):
    """Whether a text is found toxic by a scorer that knows some toxic words."""
    bad = ["idiot", "loser", "clown", "trash", "pathetic", "scum", "ass"]
    good = ["what a lovely day in the park", "i think you are right about the letter", "the old house has a garden and you like it"] * 20
    docs = frame(spark, good + [f"{x} {w}" for w in bad for x in ("you", "you are a", "the old", "i think you are", "what a") * 2])
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(130)], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, labels)
    assert all(scorer.score(f"you {w}") >= 0.5 for w in bad)
    return lambda text: scorer.score(text) >= 0.5


@pytest.mark.parametrize("text", ["you are a i d i o t", "y o u i d i o t", "y o u  i d i o t", "i  d  i  o  t", "you.1d10t", "a s s", "you a s s", "t h e o l d h o u s e h a s a g a r d e n a n d y o u i d i o t", "the.old.house.has.a.garden.and.you.like.it.1d10t"])
def test_toxic_words_in_runs(toxic_words, text):
    assert toxic_words(text)


@pytest.mark.parametrize("text", ["!diot", "|oser", "(lown", "+rash", "£oser", "idi0+", "pathet1(", "s#cum", "id%iot", "idi,ot", "id&iot", "id;iot", 'id"iot', "iiddiioott", "(1d10t)", "id10t!"])
def test_toxic_words_disguised(toxic_words, text):
    assert toxic_words(f"you {text}")


def test_clean_runs(toxic_words):
    assert not any(map(toxic_words, ["a b c d e", "t h e o l d h o u s e", "the.old.house", "a  b  c", "i a", "- - - -", "hello letter (old) house!", "$5 100% 12,000 +1", "x" * 5000, "1" * 5000, "x1" * 2500, "a " * 3000]))


def test_license_scan(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "MIT License MIT License", "Licensed under CC BY-NC 4.0.", None, "", "gnu general public-license version 3", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]
    got = [tuple(r)[1:] for r in license_scan.scan(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got[0] == (8, 1, 3, 3, "apache", "apache,apache-2.0", 0.6)
    assert got[1][:5] == (4, 2, 0, 2, "mit")
    assert got[2] == (7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc-4.0", 0.6)
    assert got[3] == got[4] == (0, 0, None, None, "", "", 0.0)
    assert got[5][4:6] == ("gpl", "gpl,gpl-3.0") and got[6][4:6] == ("", "mit-opening")
    machine = license_scan.TokenAutomaton("a <opt>b <opt>c</opt></opt> <any:2> d")
    ends = lambda x: machine.accepts_at(x.encode().split(), 0)
    assert ends("a d") == 2 and ends("a b c d") == 4 and ends("a x y d") == 4 and ends("a b c x y d") == 6 and ends("a x y z d") is None


def test_warc(spark):
    rows = [(5, "http://www.b.com/x?q=1", "<p>é</p>"), (2, "https://a.b.com:8080/", "<p>é</p>"), (9, None, None), (3, "http://b.com/", ""), (4, "bad url\r\n", "other"), (None, "u", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path, captures = warc.write_archives(pages)
    directory = warc.write_index(path, captures)
    got = {r.page_id: tuple(r)[1:] for r in warc.read_archives(path, warc.look_up(path, directory, pages)).collect()}
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert got == {2: (9, sha("<p>é</p>"), "response", None), 5: (9, sha("<p>é</p>"), "revisit", 2), 3: (0, sha(""), "response", None), 9: (0, sha(""), "revisit", 3), 4: (5, sha("other"), "response", None)}
    index = warc.CaptureIndex(path, [tuple(r) for r in directory.collect()])
    (raw,) = index.records("https://a.b.com:8080/")
    assert warc.parse(raw)[2] == "<p>é</p>".encode() and index.records("http://nowhere.com/") == []
    assert warc.url_key("http://www.Example.com:80/A?B") == "com,example)/a?b"
    path, captures = warc.write_archives(pages, min_bytes=1)
    assert {r.page_id for r in warc.read_archives(path, warc.look_up(path, warc.write_index(path, captures), pages)).where("record_type = 'revisit'").collect()} == {5}


def test_chat_format(spark):
    schema = {"add": {"properties": {"a": "integer", "b": "integer"}, "required": ["a"]}}
    rows = [(1, 0, "result", "c1", None, None, "3"), (1, 1, "call", "c1", "add", '{"b": 2, "a": 1}', None), (1, 2, "call", "c2", "add", '{"b": 2}', None), (1, 3, "call", None, "sub", "not json", None), (1, 4, "user", None, None, None, 'say "hi"'), (1, 4, "user", None, None, None, 'say "hi"')]
    messages = spark.createDataFrame(rows, "conversation long, turn long, kind string, call_id string, name string, arguments string, content string")
    got = chat_format.link_calls(messages, schema).orderBy("sort_turn", "sort_phase", "turn").collect()
    assert [(r.turn, r.linked, r.valid) for r in got] == [(1, True, True), (0, True, None), (2, False, False), (3, False, False), (4, None, None), (4, None, None)]
    assert got[0].message == '{"arguments":{"a":1,"b":2},"call_id":"c1","kind":"call","name":"add"}'
    assert got[1].message == '{"call_id":"c1","content":"3","kind":"result","name":"add"}'
    assert got[3].message == '{"arguments":"not json","kind":"call","name":"sub"}' and got[4].message == '{"content":"say \\"hi\\"","kind":"user"}'
    assert chat_format.link_calls(messages.limit(0), schema).count() == 0


def test_decontaminate(spark):
    g = np.random.default_rng(5)
    say = lambda n: " ".join("".join(g.choice(list("etaoinshr"), g.integers(2, 8))) for _ in range(n))
    item, other = say(40), say(40)
    edited = item[:30] + "zz" + item[33:]
    docs = [say(80) + " " + item + " " + say(50), say(20) + " " + item.upper().replace(" ", ",  ") + say(9), edited, say(30) + item[20:140] + say(30), item[:40] + " " + say(80), say(200), None, "", other[:30]]
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "!!"), (5, "tiny")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, docs), bench).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (3, 1)}
    assert {r.doc_id for r in decontaminate.without_leaks(frame(spark, docs), bench).collect()} == {4, 5, 6, 7, 8}
    assert decontaminate.find_leaks(frame(spark, docs), bench.limit(0)).count() == 0


def brute(texts, width, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = (t or "").translate(low).replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = [new if x == old else x for x in up]
    return {i: (len(s), up[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("width", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_jaccard_join(spark, width, num, den):
    g = np.random.default_rng(width)
    base = [[f"w{x}" for x in g.integers(0, 400, n)] for n in (6, 30, 60, 150)]
    texts = [None, "", "a b", "A b", "a b c", "word " * 50]
    for words in base:
        for k in range(100 if len(words) == 60 else 15):  # a family over a group's size
            own = list(words)
            for at in g.integers(0, len(words), k % 5):
                own[at] = f"x{g.integers(0, 9)}"
            texts.append(" ".join(own))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(frame(spark, texts), width, num, den).collect()}
    want = brute(texts, width, num, den)
    assert got == want
    kept = {r.doc_id for r in jaccard_join.one_of_each(frame(spark, [*texts]), width, num, den).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}


def test_jaccard_empty(spark):
    assert jaccard_join.join_components(frame(spark, ["a"]).limit(0), 4, 85, 100).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.v: r.c for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_image_copies(spark):
    g = np.random.default_rng(3)
    big, other = (np.kron(g.random((20, 20)), np.ones((8, 8))) for _ in range(2))
    images = [big, big, big[16:130, 24:140], big * 0.8 + 0.1, np.rot90(big), other, np.full((40, 40), 0.5)]
    rows = [(i, bytearray(image_copies.encode(x))) for i, x in enumerate(images)] + [(7, None), (8, bytearray(b"junk"))]
    got = {r.image_id: r.class_id for r in image_copies.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 6, 7: 7, 8: 8}
    for raw in (None, b"", b"P5", b"P5 1", b"P5 # c", b"P5 0 0 255\n", b"P5 3 3 255\nxx", b"P5 1 1 999\nxx"):
        assert image_copies.decode(raw) is None
    assert image_copies.decode(b"P5 # c\n2 1 255\n\x00\xff").tolist() == [[0.0, 1.0]]
    assert not math.isnan(image_copies.describe(np.zeros((40, 40)))[0].sum())


def test_image_links_like_brute_force(spark):
    g = np.random.default_rng(7)
    base = g.normal(size=(60, 64))
    vectors = [(i, (base[i % 60] + g.normal(size=64) * 0.12).tolist()) for i in range(240)]
    rows = image_copies.render_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), "vec_id", "embedding").select("image_id", "image", F.xxhash64("image").alias("fp")).collect()
    narrow = lambda x: (x[0].astype("<f4").astype(float), x[1])
    seen = sorted(((r.fp, r.image_id, narrow(image_copies.describe(image_copies.decode(bytes(r.image))))) for r in rows), key=lambda x: x[:2])
    up = {i: i for _, i, _ in seen}
    for n, (_, i, a) in enumerate(seen):
        for _, j, b in seen[n + 1 :]:
            if np.isin(image_copies.pair_keys(*a), image_copies.pair_keys(*b)).any() and image_copies.consensus(a, b) >= image_copies.VOTES:
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = {k: new if c == old else c for k, c in up.items()}
    images = spark.createDataFrame([(r.image_id, r.image) for r in rows], "image_id long, image binary")
    assert {r.image_id: r.class_id for r in image_copies.copies(images).collect()} == up


def test_image_copies_without_a_shared_key(spark, monkeypatch):
    g = np.random.default_rng(7)
    base = g.normal(size=(20, 64))
    vectors = [(i, (base[i % 20] + g.normal(size=64) * 0.12).tolist()) for i in range(60)]
    images = image_copies.render_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()
    narrow = lambda x: (x[0].astype("<f4").astype(float), x[1])
    seen = {r.image_id: narrow(image_copies.describe(image_copies.decode(bytes(r.image)))) for r in images}
    links = [(i, j) for i in seen for j in seen if i < j and image_copies.consensus(seen[i], seen[j]) >= image_copies.VOTES]
    assert any(not np.isin(image_copies.pair_keys(*seen[i]), image_copies.pair_keys(*seen[j])).any() for i, j in links)
    up = {i: i for i in seen}
    for i, j in links:
        old, new = max(up[i], up[j]), min(up[i], up[j])
        up = {k: new if c == old else c for k, c in up.items()}
    monkeypatch.setattr(image_copies, "BLOCK", 16)
    out = image_copies.copies(spark.createDataFrame(images, "image_id long, image binary"), exhaustive=True)
    assert out.columns == ["image_id", "n_corners", "class_id"]
    assert {r.image_id: r.class_id for r in out.collect()} == up


def test_first_of_a_key_over_batches(spark):
    rows = [(i, k) for k, n in ((1, 2), (2, 25_000), (3, 1), (4, 3)) for i in range(k, k + n)]
    got = image_copies.with_first(image_copies.shared_keys(spark.createDataFrame(rows, "fp long, key long"))).collect()
    assert sorted(tuple(x) for x in got) == sorted((i, k, k) for i, k in rows if k != 3)


def test_image_pairs_of_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(image_copies, "BLOCK", 4)
    keyed = spark.createDataFrame([(i, 1) for i in range(30)] + [(40, 2), (41, 2)], "fp long, key long")
    labels = spark.createDataFrame([(0, 0), (1, 0), (40, 40), (41, 40)], "v long, c long")
    got = sorted(tuple(r) for r in image_copies.unlinked_pairs(keyed, labels).collect())
    assert got == [(i, j) for i in range(30) for j in range(i + 1, 30) if (i, j) != (0, 1)]
