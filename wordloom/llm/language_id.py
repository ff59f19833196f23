"""Language identification by word-first backoff.

A word that the model knows is scored by its log frequency in each language.  A word that it doesn't know is scored by
its character n-grams, the longest length of which any is known; shorter lengths are tried in turn.  Scores add up over
the whole text, and the winner's share of the probability is the score.

Defined results: a null text or one without a letter is ``und`` with score 0; texts of any length are scored whole; rows
with a null language or text are not learned from; ties go to the language that sorts first; an empty training set
gives ``und`` throughout; repeated rows count as often as they occur; an empty table gives no rows; kept columns may not
be called ``lang_pred`` or ``score``; other columns, whatever their names, are ignored by ``predict`` and kept by
``with_language``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.shared import bounded_sample, map_batches, materialise

#: Documents that the model is fitted on, about, at most.
TRAIN_DOCS = 10_000
#: Times that a word or n-gram occurs in the sample before the model knows it: one that occurs once says little, and most do.
KNOWN_FROM = 2
LONGEST_GRAM = 5
UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 150_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of the word between word marks."""
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


def training_counts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(kind, lang, item, n)``: kind 0 counts words, kind k counts k-grams; summed in each slice before the shuffle."""

    def make():
        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            words: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words[lang].update(words_of(text))
            total: Counter = Counter()
            for lang, held in words.items():
                for word, n in held.items():
                    total[0, lang, word] += n
                    for k in range(1, LONGEST_GRAM + 1):
                        for gram in grams_of(word, k):
                            total[k, lang, gram] += n
            kinds, langs, items = zip(*total, strict=True) if total else ((), (), ())
            return pa.record_batch([pa.array(kinds, pa.int32()), pa.array(langs, pa.string()), pa.array(items, pa.string()), pa.array(list(total.values()), pa.int64())], ["kind", "lang", "item", "n"])

        return count

    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = map_batches(rows, "text", "kind int, lang string, item string, n long", make)
    return counts.groupBy("kind", "lang", "item").agg(F.sum("n").alias("n"))


class BackoffModel:
    """Log frequencies per language of words and n-grams, as rows of a matrix."""

    def __init__(self, langs: list[str], words: dict[str, int], word_rows: np.ndarray, grams: list[dict[str, int]], gram_rows: np.ndarray, prior: np.ndarray):
        self.langs, self.words, self.prior = langs, words, prior
        self.grams = [{g: row + len(words) for g, row in held.items()} for held in grams]
        self.features_of = np.concatenate([word_rows, gram_rows]).astype(np.float32)
        self.forget()

    def forget(self) -> None:
        """Tokens (runs without white space) get rows as they turn up; a row adds up the token's words."""
        self.rows: dict[str, int] = {}
        self.matrix = np.zeros((CACHE_WORDS, len(self.langs)), np.float32)
        self.lettered = np.zeros(CACHE_WORDS, bool)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "matrix", "lettered")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.forget()

    def features(self, word: str) -> list[int]:
        """Rows that are averaged for a word: its own if known, else those of its longest known n-grams."""
        if (row := self.words.get(word)) is not None:
            return [row]
        for k in range(LONGEST_GRAM, 0, -1):
            get = self.grams[k].get
            known = [x for g in grams_of(word, k) if (x := get(g)) is not None]
            if known:
                return known
        return []

    def learn(self, tokens: list[str]) -> None:
        """Give rows to tokens that aren't held yet."""
        first = len(self.rows)
        owner, size, flat = [], [], []
        for row, token in enumerate(tokens, first):
            self.rows[token] = row
            words = [token] if token.isalpha() else WORD.findall(token)
            self.lettered[row] = token.isalpha() or any(map(str.isalpha, token))
            for word in words:
                if known := self.features(word):
                    owner.append(row)
                    size.append(len(known))
                    flat += known
        if flat:
            starts = np.cumsum([0] + size[:-1])
            np.add.at(self.matrix, owner, np.add.reduceat(self.features_of[flat], starts) / np.array(size)[:, None])

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for text in texts:
            found = list(Counter((text or "").lower().split()).items())
            total, lettered = self.prior, False
            for at in range(0, len(found), CACHE_WORDS // 2):
                part = found[at : at + CACHE_WORDS // 2]
                if len(self.rows) + len(part) > CACHE_WORDS:
                    self.forget()
                self.learn([w for w, _ in part if w not in self.rows])
                rows = [self.rows[w] for w, _ in part]
                total = total + np.array([n for _, n in part], np.float64) @ self.matrix[rows]
                lettered = lettered or bool(self.lettered[rows].any())
            out.append(self.winner(total) if lettered and self.langs else (UNDETERMINED, 0.0))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def winner(self, total: np.ndarray) -> tuple[str, float]:
        share = np.exp(total - total.max())
        best = int(total.argmax())
        return self.langs[best], float(min(1.0, share[best] / share.sum()))


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id", train_docs: int = TRAIN_DOCS) -> BackoffModel:
    """Fit on a bounded, hash-chosen sample of the labelled rows; the model's tables are bounded too."""
    known = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = materialise(training_counts(bounded_sample(known, key, train_docs), text_col, lang_col), "langid-counts")
    sums = {(r.kind, r.lang): (r.n, r.d) for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()}
    langs = sorted({lang for _, lang in sums})
    at = {lang: i for i, lang in enumerate(langs)}
    size = [sum(d for (k, _), (_, d) in sums.items() if k == kind) or 1 for kind in range(LONGEST_GRAM + 1)]
    base = np.array([[math.log(0.1) - math.log(sums.get((k, lang), (0, 0))[0] + 0.1 * size[k]) for lang in langs] for k in range(LONGEST_GRAM + 1)])

    def table(low: int, high: int) -> tuple[list[dict[str, int]], np.ndarray]:
        kept = counts.where(F.col("kind").between(low, high))
        known = kept.groupBy("kind", "item").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("n")).where(F.col("n") >= KNOWN_FROM)
        at_row: list[dict[str, int]] = [{} for _ in range(LONGEST_GRAM + 1)]
        rows: list[np.ndarray] = []
        # the sample's words bound what comes: an item has as many languages as times at most
        for r in known.select("kind", "item", "by").orderBy("kind", "item").toLocalIterator():
            at_row[r.kind][r["item"]] = len(rows)
            row = base[r.kind].copy()
            for lang, n in r.by.items():
                row[at[lang]] = math.log(n + 0.1) - math.log(sums[r.kind, lang][0] + 0.1 * size[r.kind])
            rows.append(row.astype(np.float32))
        return at_row, np.array(rows, np.float32).reshape(len(rows), len(langs))

    (words, *_), word_rows = table(0, 0)
    grams, gram_rows = table(1, LONGEST_GRAM)
    share = np.array([sums.get((0, lang), (0, 0))[0] for lang in langs], float)
    prior = np.log(share / share.sum()) if len(langs) else np.zeros(0)
    return BackoffModel(langs, words, word_rows, grams, gram_rows, prior)


def predict(df: DataFrame, model: BackoffModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with ``lang_pred`` and ``score``."""
    held = df.sparkSession.sparkContext.broadcast(model)
    if taken := {"lang_pred", "score"}.intersection(keep):
        raise ValueError(f"kept columns clash with those of the result: {sorted(taken)}")
    rows = df.select(*keep, F.col(text_col).alias("__text"))
    fields = rows.drop("__text").schema

    def make():
        def score(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = zip(*held.value.predict_all(batch.column(len(keep)).to_pylist()), strict=True)
            return pa.record_batch([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

        return score

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return map_batches(rows, "__text", f"{schema}, lang_pred string, score double", make)


def with_language(docs: DataFrame, model: BackoffModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose language is determined with ``least`` or more, with all their columns."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def make():
        def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = held.value.predict_all(batch.column(at).to_pylist())
            return batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in found], pa.bool_()))

        return keep

    return map_batches(docs, text_col, docs.schema, make)
