"""Operators and queries against plain versions of what they compute."""

import base64
import hashlib
import itertools
import json
import math
import random
import re
import resource
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wordloom.llm import byte_bpe, chat_format, decontaminate, image_copies, language_id, license_scan, queries, token_archive, toxicity, warc

FOLDER = "/root/testdata/sf0.001"
LETTERS = "etaoinshr"


def say(r, n):
    return " ".join("".join(r.choice(LETTERS) for _ in range(r.randint(2, 8))) for _ in range(n))


def rows_of(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = queries.queries()[name](spark, FOLDER)
    want = c.sql(queries.oracle_sql()[name])
    plain = lambda rows: sorted(map(str, rows))
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(tuple(r[k] for k in sorted(got.columns)) for r in got.collect()) == plain(want.select(*[duckdb.ColumnExpression(k) for k in sorted(want.columns)]).fetchall())


# op1


def edits(pattern: bytes, text: bytes) -> int:
    """The fewest edits between a pattern and any part of a text."""
    prev, t, at = np.zeros(len(text) + 1, int), np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    for c in pattern:
        cur = prev + 1
        cur[1:] = np.minimum(cur[1:], prev[:-1] + (t != c))
        prev = np.minimum.accumulate(cur - at) + at
    return int(prev.min())


def test_leaks_like_brute_force(spark, tmp_path):
    r = random.Random(3)
    items = [(i, say(r, r.randint(10, 40))) for i in range(8)] + [(8, None), (9, "tiny"), (9, "at"), (10, "!!")]
    docs = []
    for _ in range(60):
        text = r.choice(items[:8])[1]
        at = r.randint(0, max(0, len(text) - 85))
        part = list(text[at : at + r.randint(70, 140)])
        for _ in range(r.randint(0, 9)):
            j = r.randrange(len(part))
            part[j : j + r.randint(0, 1)] = r.choice(["", "x", "q", "7"])
        docs.append(say(r, 10) + "".join(part).upper() + say(r, 8))
    docs += [None, "", "so tiny, isn't it", docs[0]]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("item_id", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(x.doc_id, x.item_id): x for x in queries.op1_decontaminate(spark, str(tmp_path)).collect()}
    want, whole = {}, {i: decontaminate.normalise(t) for i, t in items[:8]}
    for d, text in enumerate(docs):
        text = decontaminate.normalise(text)
        for i, item in whole.items():
            m = min(decontaminate.WINDOW, len(item))
            k = min(int(m * decontaminate.ERROR), (m - decontaminate.Q) // decontaminate.Q)
            least = min(edits(item[s : s + m], text) for s in range(len(item) - m + 1))
            if least <= k:
                want[d, i] = least
        if {b"tiny", b"at"} & set(text.split()):
            want[d, 9] = 0
    assert {k: x.edits for k, x in got.items()} == want and len(want) > 30
    for (d, i), x in got.items():
        if i < 8:
            part = decontaminate.normalise(docs[d])[x.start : x.end]
            assert min(edits(part, whole[i]), len(part)) <= x.edits


def test_leaks_in_runs_are_bounded():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    index = decontaminate.BenchmarkIndex([(1, b"a" * 300), (2, b"ab " * 100)])
    assert [x[1:3] for x in index.leaks([b"a" * 100_000, b"", b"b a"])] == [(1, 0)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 << 10


# op2


def test_language_like_brute_force(spark, tmp_path):
    r = random.Random(5)
    words = {"en": ["the", "cat", "dog", "house", "thing"], "fr": ["le", "chat", "maison", "chose", "été"], "de": ["der", "hund", "haus", "straße", "ding"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(1, 12))), lang) for i, lang in enumerate(r.choices(list(words), k=80))]
    rows += [(100, None, "en"), (101, "the cats", None), (102, "", "fr"), (103, "12 !?", "de"), (104, "hou\tmais " * 4000, "en"), (105, "THE|CHAT", "de"), (105, "THE|CHAT", "de"), (106, "zzz qqq", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((x.doc_id, x.held_out, x.lang_pred, round(x.score, 6)) for x in queries.op2_language_id(spark, str(tmp_path)).collect())

    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    grams = lambda w, k: [f"^{w}$"[i : i + k] for i in range(len(w) + 3 - k)] if k > 1 else list(w)
    counts: dict = {k: {} for k in range(6)}
    for d, text, lang in rows:
        if text is not None and lang is not None and not held(d):
            for w in re.findall(r"[^\W\d_]+", text.lower()):
                for k in range(6):
                    for x in [w] if not k else grams(w, k):
                        counts[k].setdefault(x, Counter())[lang] += 1
    langs = sorted({lang for held_ in counts[0].values() for lang in held_})
    total = {k: Counter() for k in counts}
    for k, held_ in counts.items():
        for c in held_.values():
            total[k].update(c)
    size = {k: sum(len(c) for c in held_.values()) for k, held_ in counts.items()}
    known = {k: {x for x, c in held_.items() if sum(c.values()) >= language_id.KNOWN_FROM} for k, held_ in counts.items()}
    log = lambda k, x, lang: math.log(counts[k].get(x, {}).get(lang, 0) + 0.1) - math.log(total[k][lang] + 0.1 * size[k])

    def plain(text):
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not found:
            return "und", 0.0
        score = {lang: math.log(total[0][lang] / sum(total[0].values())) for lang in langs}
        for w in found:
            k, xs = (0, [w]) if w in known[0] else next(((k, some) for k in range(5, 0, -1) if (some := [x for x in grams(w, k) if x in known[k]])), (0, []))
            for lang in langs:
                score[lang] += sum(log(k, x, lang) for x in xs) / len(xs) if xs else 0
        best = max(langs, key=lambda x: (score[x], -langs.index(x)))
        return best, 1 / sum(math.exp(score[x] - score[best]) for x in langs)

    want = sorted((d, held(d), plain(t)[0], round(plain(t)[1], 6)) for d, t, _ in rows)
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-3)
    with pytest.raises(ValueError, match="clash"):
        language_id.predict(spark.createDataFrame([(1, "x", 2)], "doc_id long, text string, score int"), None, keep=("score",))


# op3


def test_image_copies_edited(spark):
    g = np.random.default_rng(3)
    big, other = (np.kron(g.random((24, 24)), np.ones((6, 6))) for _ in range(2))
    grown = big.repeat(2, 0).repeat(2, 1)
    images = [big, big[20:130, 24:140], np.clip(big + g.normal(size=big.shape) * 0.01, 0, 1), big * 0.7 + 0.2, np.rot90(big, 3), grown, other, other[10:, 10:]]
    rows = [(i, bytearray(image_copies.encode(x)), "x") for i, x in enumerate(images)] + [(9, bytearray(image_copies.encode(big)), "x"), (9, bytearray(image_copies.encode(other)), "x")]
    out = image_copies.copies(spark.createDataFrame(rows, "image_id long, image binary, fp string"))
    got = [(r.image_id, r.class_id) for r in out.collect()]
    assert sorted(got) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 6), (7, 6), (9, 0), (9, 6)]
    empty = spark.createDataFrame([], "image_id long, image binary")
    assert image_copies.copies(empty).count() == 0


def test_vectors_of_any_length_are_drawn_whole(spark):
    rows = spark.createDataFrame([(1, [1.0] * 5 + [9.0]), (2, [1.0] * 5 + [-9.0]), (3, []), (4, None)], "vec_id long, v array<double>")
    got = {r.image_id: r.image for r in image_copies.render_vectors(rows, "vec_id", "v").collect()}
    assert got[1] != got[2] and got[3] is got[4] is None


# op4


def test_decoding_like_brute_force():
    r = random.Random(1)
    counts = np.array([r.random() for _ in range(27**3)])
    model = toxicity.CharModel(counts)
    log = lambda a, b, k: model.log[a * 27 + b][k]
    alphabet = "abi1!|0@.\n -$aé"
    for _ in range(400):
        token, marks = "".join(r.choice(alphabet) for _ in range(r.randint(1, 5))), r.random() < 0.7
        best = []
        for path in itertools.product(*(model.options(c, i > 0 and c == token[i - 1], marks) for i, c in enumerate(token.lower()))):
            a = b = toxicity.MARK
            score, said = 0.0, []
            for k, cost in path:
                score -= cost
                if k >= 0 and not (k == b == toxicity.MARK):
                    score += log(a, b, k)
                    a, b = b, k
                    said.append(" " if k == toxicity.MARK else chr(97 + k))
            best.append((score + (log(a, b, toxicity.MARK) if b != toxicity.MARK else 0.0), "".join(said).split()))
        top = max(x for x, _ in best)
        assert model.decode(token, marks) in [s for x, s in best if x > top - 1e-9], token


def test_toxicity_query(spark, tmp_path):
    good, bad = ["what a lovely day in the park"] * 60, ["you are such an idiot today", "idiot go away"] * 30
    texts = good + bad + ["you 1d10t", "i d i o t", "x" * 48 + "..1d10t", None, "", "lovely day " * 9000 + "idiot", "lovely day"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("toxic", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i >= 60)) for i in range(120)] + [(3, None), (None, 1), (999, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert [got[i].predicted for i in (0, 61, *range(120, 127))] == [0, 1, 1, 1, 1, 0, 0, 1, 0]


# op5


def test_pretokens_like_the_library():
    from tokenizers import Tokenizer

    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(1)
    whole, cache = Tokenizer.from_file(path), token_archive.PretokenCache(path, most=500)
    alphabet = [*"aAzZéÉñß'0129 \t\n.,!<|>_-#İıſŉŒŸµª²¼٣̧́ 　\x1c\x85ΣσςΑ日本’“…×÷ǅ😀ﬁK", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "'RE", "ll", "</w>", "\r\n"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(20_000)]
    assert cache.known
    for at in range(0, len(texts), 500):
        for text, raw in zip(texts[at : at + 500], cache.encode_all(texts[at : at + 500]), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, ascii(text)


def test_archive_of_repeated_ids_and_nothing(spark, tmp_path):
    rows = [(5, "b a", "x"), (5, "a", "x"), (5, "a", "x"), (1, None, "x"), (None, "gone", "x"), (-3, "word " * 60_000, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op5_token_archive(spark, str(tmp_path)).orderBy("start").collect()]
    assert [r[0] for r in got] == [-3, 1, 5, 5, 5] and [r[1] for r in got] == [0, *itertools.accumulate(r[2] for r in got[:-1])] and got[0][2] == 60_001 and got[1][2] == 1
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op5_token_archive(spark, str(tmp_path / "none")).count() == 0


# op6


def test_warc_like_brute_force(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.randint(1, 60), f"http://h{r.randint(0, 5)}.com/{r.randint(0, 9)}", r.choice(["A", "B", "", None, "x" * 200_000, f"own {i}"])) for i in range(120)]
    rows += [(1, "u", "A"), (2, "u", "A"), (2, "u", "B unique"), (70, "v", "p"), (71, "v", "p"), (71, "v", "q"), (60, "v", "q")]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("d", F.lit(1)).withColumn("refers_to", F.lit("clash")).write.parquet(str(tmp_path / "pages.parquet"))
    first = {}
    for i, _, html in rows:
        first[html or ""] = min(i, first.get(html or "", i))
    want = sorted((i, len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if first[h] == i else "revisit", first[h] if first[h] != i else -1) for i, _, html in rows for h in [html or ""])
    got = queries.op6_warc(spark, str(tmp_path)).fillna({"refers_to": -1})
    assert sorted(tuple(x) for x in got.collect()) == want
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert queries.op6_warc(spark, str(tmp_path / "none")).count() == 0


def test_capture_index_finds_every_url(spark):
    r = random.Random(4)
    rows = [(i, f"http://www.h{r.randint(0, 40)}.com/{r.randint(0, 3)}", f"page {i}") for i in range(700)]
    rows += [(900 + i, "http://often.com/", f"often {i}") for i in range(90)]  # over several blocks
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path, captures = warc.write_archives(pages)
    files = warc.write_index(path, captures, block_lines=16)
    index = warc.CaptureIndex(path, [tuple(x) for x in files.collect()])
    asked = pages.where("page_id % 3 = 0")
    wanted = {warc.url_key(u) for i, u, _ in rows if i % 3 == 0}
    assert sorted(x.page_id for x in warc.look_up(path, files, asked).collect()) == sorted(i for i, u, _ in rows if warc.url_key(u) in wanted)
    for url in {u for _, u, _ in rows}:
        assert sorted(warc.parse(x)[2].decode() for x in index.records(url)) == sorted(h for _, u, h in rows if u == url)
    assert index.records("http://h999.com/") == []


# op7


def test_base_phrases_like_brute_force(spark, tmp_path):
    r = random.Random(6)
    pieces = ["GNU", "general", "Public", "license", "apache", "mit", "cc", "by", "By", "é", "2", "0", "version", "under", "the", "x"]
    texts = ["".join(r.choice(pieces) + r.choice([" ", "  ", "-", ", ", "\n", "\x7f", ""]) for _ in range(r.randint(0, 60))) for _ in range(400)] + [None, "", "mit license " * 30_000, "mit license mit license"] + ["mit license"] * 2
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    for x in queries.op7_license_scan(spark, str(tmp_path)).collect():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), texts[x.doc_id] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        hits = [(i, label) for phrase, label in license_scan.BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
        at = [i for i, _ in hits] or [None]
        assert (x.n_words, x.n_base, x.base_labels) == (len(words), len(hits), ",".join(sorted({b for _, b in hits})))
        assert (x.first_word, x.last_word) == ((min(at), max(at)) if hits else (None, None))
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and x.score >= (0.5 if hits else 0)


def filled(template, holder="Some Holder, Inc."):
    return re.sub(r"<any:\d+>", holder, re.sub(r"</?opt>", "", template)).capitalize() + "."


def test_license_texts():
    scan = license_scan.Scanner().scan
    for grade, held in license_scan.GRADES:
        for label, templates in held.items():
            for t in templates:
                _, _, _, labels, score = scan("Copyright (c) 2020\n" + filled(t) + "\nmore")
                assert label in labels and score >= grade, label
                if held is license_scan.TEXTS:
                    assert [x for x in labels if "opening" not in x] == [label]
    changed = filled(license_scan.MIT).replace("arising from", "coming from")
    assert scan(changed)[3:] == (["mit-opening"], 0.7)
    assert scan(filled(license_scan.MIT) + " The software shall be used for good, not evil.")[3] == ["mit", "mit-opening"]
    assert scan("Not licensed under CC BY 4.0; see GNU General Public License, 3 chapters")[3:] == (["cc-by", "cc-by-4.0", "gpl"], 0.6)
    assert scan("Apache License 2.0")[3] == ["apache", "apache-2.0"] and scan("General Public License v3")[3] == ["gpl-3.0"]


# op8


def test_bpe_of_long_texts(spark, tmp_path):
    r = random.Random(8)
    paragraphs = lambda n: "".join(" ".join(r.choice(["the", "of", "123", "it's", "é", "a,b"]) for _ in range(r.randint(1, 200))) + r.choice(["\n", "\n\n", "  \n", " "]) for _ in range(n))
    texts = [("word " * 7000)[:32_767] + "\n\n" + "Next paragraph here " * 300, paragraphs(300), paragraphs(200), "x" * 200_000, " " * 70_000 + "a", "'ll" * 20_000, None, "", "short", paragraphs(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (0, texts[1]), (None, texts[2])]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    engine = byte_bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).engine

    def plain(doc_id, text):
        ids = np.array(engine.encode_ordinary(text or ""), "<u4")
        return doc_id if doc_id is not None else -1, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = queries.op8_byte_bpe(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").fillna({"doc_id": -1})
    assert sorted(tuple(x) for x in got.collect()) == sorted(plain(*x) for x in rows)


def test_pattern_sees_characters_as_the_library_does():
    bpe = byte_bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for first in range(0, 0x30000, 64):
        text = "".join(f"a{c}1{c}!{c} {c}{c}" for c in map(chr, range(first, first + 64)) if not 0xD800 <= ord(c) < 0xE000)
        assert bpe.encode(text).tolist() == bpe.engine.encode_ordinary(text)


# op9


TOOL = {
    "add": {"properties": {"a": "integer", "b": {"type": ["number", "null"]}}, "required": ["a"], "additionalProperties": False},
    "deep": {"properties": {"o": {"type": "object", "properties": {"k": {"enum": ["x", "y", 1]}}, "required": ["k"]}, "l": {"type": "array", "items": "string"}}},
}
ARGUMENTS = {
    '{"a":1}': ("add", True), '{"a":1.0,"b":null}': ("add", True), '{"a":123456789012345678901234567890}': ("add", True), '{"a":1e400}': ("add", False), '{"a":1.5}': ("add", False), '{"a":"1"}': ("add", False), '{"a":1,"c":2}': ("add", False), "{}": ("add", False),
    "[1]": ("add", False), "nope": ("add", False), '{"o":{"k":"x"},"l":["q"]}': ("deep", True), '{"o":{"k":"z"}}': ("deep", False), '{"o":{"k":1},"l":[]}': ("deep", True), '{"o":{}}': ("deep", False), '{"l":["q",1]}': ("deep", False), '{"z":9}': ("deep", True), '{"a": 2}': ("none", False),
}


def test_arguments(spark):
    rows = [(1, i, "call", f"c{i}", name, text, None) for i, (text, (name, _)) in enumerate(ARGUMENTS.items())] + [(1, 99, "call", "c99", "add", None, None)]
    got = {r.turn: r for r in chat_format.link_calls(spark.createDataFrame(rows, MESSAGE), TOOL).collect()}
    assert [got[i].valid for i in range(len(ARGUMENTS))] == [ok for _, ok in ARGUMENTS.values()]
    assert json.loads(got[99].message) == {"call_id": "c99", "kind": "call", "name": "add"} and got[99].valid is False


MESSAGE = "conversation long, turn long, kind string, call_id string, name string, arguments string, content string"


def test_links_like_brute_force(spark):
    r = random.Random(9)
    rows = [(r.choice([1, 2, None]), r.randint(0, 6), r.choice(["call", "result", "user", None]), r.choice(["a", "b", None]), r.choice(["add", None]), r.choice(['{"a":1}', "bad  \x01", None]), r.choice(["hi", None, 'q"\\'])) for _ in range(300)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, MESSAGE).withColumn("first", F.lit(1)).withColumn("c", F.lit(2))
    got = chat_format.link_calls(df, TOOL).collect()
    assert len(got) == len(rows)
    low = lambda x: (x is not None, x or "")
    first, answered = {}, {}
    for c, t, kind, i, name, args, _ in rows:
        if c is not None and i is not None and kind == "call":
            first[c, i] = min(first.get((c, i), (99,)), (t, low(args), low(name)))
        if c is not None and i is not None and kind == "result":
            answered[c, i] = True
    want = Counter()
    for c, t, kind, i, name, args, content in rows:
        pair = first.get((c, i))
        linked = (c, i) in answered and pair == (t, low(args), low(name)) if kind == "call" else pair is not None if kind == "result" else None
        shown = name if kind != "result" else (pair[2][1] if pair and pair[2][0] else None)
        parsed = json.loads(args) if args and args[0] == "{" else args
        message = {"arguments": parsed if kind == "call" else None, "call_id": i, "content": content, "kind": kind, "name": shown}
        place = (max(t, pair[0]) if kind == "result" and pair else t, int(kind == "result"))
        want[str((c, t, kind, i, *place, linked, json.dumps({k: v for k, v in message.items() if v is not None}, sort_keys=True)))] += 1
    assert Counter(str((x.conversation, x.turn, x.kind, x.call_id, x.sort_turn, x.sort_phase, x.linked, json.dumps(json.loads(x.message), sort_keys=True))) for x in got) == want


def test_shared_keys(spark):
    r = random.Random(1)
    rows = [(i, r.choice([1, 2, 2, 3, *range(10, 60)])) for i in range(120)] + [(500 + i, 7) for i in range(30_000)]
    n = Counter(k for _, k in rows)
    got = image_copies.shared_keys(spark.createDataFrame(rows, "fp long, key long")).collect()
    assert sorted(tuple(x) for x in got) == sorted(x for x in rows if n[x[1]] > 1)
    assert image_copies.shared_keys(spark.createDataFrame([], "fp long, key long")).count() == 0
    assert image_copies.shared_keys(spark.createDataFrame([(1, 1)], "fp long, key long")).count() == 0
