"""The pipeline against plain versions of its stages."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from test_brute import edits, say
from wordloom.llm import byte_bpe, decontaminate, language_id, toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, docs, labels, bench):
    spark.createDataFrame(docs, KIND).withColumn("__id", F.lit("clash")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def shingles(text):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_run_like_plain_stages(spark, tmp_path):
    r = random.Random(11)
    lists = {"en": ["the", "cat", "dog", "house", "garden", "tree", "river", "stone"], "fr": ["le", "chat", "maison", "jardin", "arbre", "fleuve", "pierre", "chien"]}
    speak = lambda lang, n: " ".join(r.choice(lists[lang]) for _ in range(n))
    bench = [(i, say(r, 25)) for i in range(3)]
    texts = []
    for _ in range(90):
        lang = r.choice(["en", "fr"])
        texts.append((speak(lang, r.randint(5, 60)), lang))
    texts += [(speak("en", 8) + " you idiot " + speak("en", 3), "en") for _ in range(30)]
    copies = [speak("en", 80) for _ in range(4)]
    texts += [(c if k % 2 else c.replace(" ", "\n", 3) + f" end{k}", "en") for c in copies for k in range(6)]
    texts += [(speak("en", 10) + " " + t[:100] + " " + speak("en", 10), "en") for _, t in bench] + [(speak("en", 20) + " 1d10t", "en"), (None, "en"), ("", "fr"), ("12 34", None), (speak("fr", 9000), None)]
    docs = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(texts)]
    docs += [docs[5], (None, speak("en", 30), "en", None, None)]
    labels = [(i, 1, int(90 <= i < 120)) for i in range(120)]
    folder = str(tmp_path)
    tables(spark, folder, docs, labels, bench)

    frame = lambda rows: spark.createDataFrame(rows, KIND)
    known = spark.createDataFrame([x for x in labels if zlib.crc32(str(x[0]).encode()) % 5], "doc_id long, quality int, toxic int")
    scorer = toxicity.fit(frame(docs), known)
    kept = [d for d in docs if scorer.score(d[1]) < 0.5]
    assert not any("idiot" in (d[1] or "") or "1d10t" in (d[1] or "") for d in kept) and len(kept) > 100
    model = language_id.fit(frame(kept))
    kept = [d for d in kept for lang, score in [model.predict(d[1])] if lang != "und" and score >= 0.5]
    assert {d[1] for d in docs if d[1] in (None, "", "12 34")}.isdisjoint(d[1] for d in kept)

    named = sorted({d for d in kept if d[0] is not None}, key=str)
    sets, up = [shingles(d[1]) for d in named], list(range(len(named)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                up = [up[j] if x == up[i] else x for x in up]
    first = {}
    for d, c in zip(named, up, strict=True):
        first[c] = min(first.get(c, d[0]), d[0])
    kept = [d for d, c in zip(named, up, strict=True) if first[c] == d[0]] + [d for d in kept if d[0] is None]

    def leaks(text):
        text = decontaminate.normalise(text)
        for _, item in bench:
            item = decontaminate.normalise(item)
            if any(edits(item[s : s + 80], text) <= int(80 * decontaminate.ERROR) for s in range(len(item) - 79)):
                return True
        return False

    kept = [d for d in kept if not leaks(d[1])]
    engine = byte_bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).engine
    raw = {d[0]: np.array(engine.encode_ordinary(d[1]), "<u4").tobytes() for d in kept}
    out = corpus_pipeline.run(spark, folder)
    got = {x.doc_id: x for x in out.collect()}
    assert got.keys() == raw.keys() and len(got) == len(kept) and out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256"]
    assert all(bytes(got[k].ids) == v and got[k].n_tokens == len(v) // 4 and got[k].ids_sha256 == hashlib.sha256(v).hexdigest() for k, v in raw.items())


def test_stages_of_nothing(spark, tmp_path):
    tables(spark, str(tmp_path), [], [], [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
