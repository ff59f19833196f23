"""Toxicity scores after noisy-channel deobfuscation.

Tokens that can be disguised (digits or symbols in or beside a word, letters spaced out one by one, letters repeated)
become a lattice: each character may stand for itself, for the letters it is used in place of, for nothing (separators,
repeats) or for the end of a word (all but letters).  A Viterbi search picks the path that is likeliest under a
character trigram model of the whole corpus and under the channel's costs; if it has several words, the likeliest path
of a single word is kept too.  The text's words, restored ones among them, are then scored: words and word stems have a
lower confidence bound of the share of labelled texts with them that are toxic, and a logistic model of the strongest
ones gives the score.

Defined results: null and empty texts get the score of a text without any known stem; texts of any length are scored
whole; labels that are null, or whose document is missing, teach nothing; with no labels at all every score is 0; of
equally strong stems each counts once; a document that is repeated or labelled twice counts as often as its pairs occur;
an empty table gives no rows; kept columns may not be called ``score`` or ``predicted``; other columns, whatever their
names, are ignored by ``score`` and kept by ``without_toxic``.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.shared import SLICE_BYTES, bounded_sample, map_batches, materialise

#: Labelled documents that the scorer is fitted on, about, at most.
TRAIN_DOCS = 60_000
#: A stem counts from so many labelled documents on.
MIN_DOCS = 4
STEM_LENGTHS = (4, 5, 6)
#: Tokens whose strongest stem a worker remembers; of those whose stems it lists, half of that, and of decoded ones a quarter.
CACHE_WORDS = 200_000

# What a symbol is written in place of.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = frozenset(".-_*~'`/\\:,;^=#%&\"")
# Costs in nats of the channel: writing a symbol for a letter, leaving a repeat or a separator out, keeping a repeat.
SWAP, DROP, KEEP_REPEAT = 0.5, 0.2, 1.5
#: Ending a word at a symbol that can stand for a letter, and leaving out a gap wider than others of its run.
MARK_SYMBOL, DROP_WIDE = 3.0, 2.0

SYMBOLS, MARK = 27, 26  # letters a-z and the word mark
WORD = re.compile(r"[^\W\d_]+")
#: A letter twice in a row.
REPEATED = re.compile(r"([^\W\d_])\1")
REPEATED_RUN = re.compile(r"(.)\1+", re.S)
#: Letters at a word's beginning that every stem has, or all of a shorter one.
HEAD = 4
#: Single characters between white space, one after another, are taken for spaced-out words.
SPACED = re.compile(r"(?<!\S)\S(?:\s++\S(?!\S))+")
GAP = re.compile(r"\s+")
#: In a run of single characters, a gap wider than its narrowest.
WIDE = "\n"
EDGES = "".join(SEPARATORS) + "?)[]{}<>"
#: Marks at a token's edge that can stand for letters or be no part of the word.
SYMBOL_EDGES = EDGES + "".join(c for c in STANDS_FOR if not c.isdigit())
#: Longer tokens are decoded whenever they come, not remembered.
LONGEST_TOKEN = 48


def letter(char: str) -> int:
    """0-25 for a letter a-z with or without marks, else -1."""
    base = unicodedata.normalize("NFD", char)[0]
    return ord(base) - 97 if "a" <= base <= "z" else -1


@functools.lru_cache(100_000)
def base_letter(char: str) -> str:
    """The letter a-z of a character, '' if it has none."""
    k = letter(char)
    return chr(97 + k) if k >= 0 else ""


def plain_forms(token: str) -> tuple[str, ...]:
    """A token of letters without repeats, as written and in letters a-z; nothing if one of them has no such letter."""
    if token.isascii():
        return (REPEATED_RUN.sub(r"\1", token) if REPEATED.search(token) else token,)
    plain = list(map(base_letter, token))
    return tuple(REPEATED_RUN.sub(r"\1", x) if REPEATED.search(x) else x for x in (token, "".join(plain))) if all(plain) else ()


def trigram_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``(gram, n)`` over the letters of every text; a slice gives each gram once."""
    table = np.full(256, 26, np.int64)
    table[97:123] = table[65:91] = np.arange(26)

    def make():
        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            joined = "  ".join(t for t in batch.column(0).to_pylist() if t)
            raw = unicodedata.normalize("NFD", joined).encode("ascii", "ignore") if not joined.isascii() else joined.encode()
            codes = table[np.frombuffer(b"  " + raw + b"  ", np.uint8)]
            grams = np.bincount((codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:], minlength=SYMBOLS**3)
            at = np.flatnonzero(grams)
            return pa.record_batch([pa.array(at, pa.int32()), pa.array(grams[at], pa.int64())], ["gram", "n"])

        return count

    return map_batches(df.select(F.col(text_col).alias("text")), "text", "gram int, n long", make).groupBy("gram").agg(F.sum("n").alias("n"))


class CharModel:
    """Log probabilities of a letter after two others, mixed with shorter histories."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 1) / (one.sum() + SYMBOLS)
        p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
        p3 = (three + 20 * p2[None]) / (three.sum(2, keepdims=True) + 20)
        #: By history (two symbols as one number), then by symbol.
        self.log = np.log(p3).reshape(SYMBOLS * SYMBOLS, SYMBOLS).tolist()
        self.known: dict[tuple[str, bool, bool], tuple[tuple[int, float], ...]] = {}

    def options(self, char: str, again: bool, marks: bool) -> tuple[tuple[int, float], ...]:
        """What a character can stand for (a letter, the word mark, or -1 for nothing) at which cost."""
        if (held := self.known.get((char, again, marks))) is not None:
            return held
        out: list[tuple[int, float]] = []
        k = letter(char)
        if k >= 0:
            out.append((k, KEEP_REPEAT if again else 0.0))
            if again:
                out.append((-1, DROP))
        else:
            out += [(ord(x) - 97, SWAP) for x in STANDS_FOR.get(char, "")]
            if marks:
                out.append((MARK, MARK_SYMBOL if out else 0.0 if char == WIDE else DROP))
            if char == WIDE:
                out.append((-1, DROP_WIDE))
            elif char in SEPARATORS or char.isspace():
                out.append((-1, DROP))
            elif again or char not in STANDS_FOR:
                out.append((-1, 2 * DROP))
        if len(self.known) >= 100_000:
            self.known.clear()
        self.known[char, again, marks] = tuple(out)
        return tuple(out)

    def decode(self, chars: str, marks: bool = True) -> list[str]:
        """The words of the likeliest path behind ``chars``."""
        return self.path(chars, marks).split()

    def path(self, chars: str, marks: bool = True) -> str:
        """The likeliest path behind ``chars``, a space for a word mark; the beam holds the best path of every two-symbol history.

        Without ``marks`` there is one word.  A path is a chain of (path before, symbol).
        """
        log, start = self.log, MARK * SYMBOLS + MARK
        beam: dict[int, tuple[float, tuple | None]] = {start: (0.0, None)}
        last = ""
        for char in chars.lower():
            step: dict[int, tuple[float, tuple | None]] = {}
            for k, cost in self.options(char, char == last, marks):
                for at, (score, said) in beam.items():
                    b = at % SYMBOLS
                    if k < 0 or k == b == MARK:  # one mark after another says nothing new
                        key, s, way = at, score - cost, said
                    else:
                        key, s, way = b * SYMBOLS + k, score - cost + log[at][k], (said, k)
                    if key not in step or s > step[key][0]:
                        step[key] = (s, way)
            beam, last = step, char
        _, _, said = max(((score + (log[at][MARK] if at % SYMBOLS != MARK else 0.0), at, said) for at, (score, said) in beam.items()), key=lambda x: x[:2])
        out = []
        while said:
            said, k = said
            out.append(" " if k == MARK else chr(97 + k))
        return "".join(reversed(out))


NO_STEM = (0.0, "")


def stems_of(word: str) -> list[str]:
    """The word itself and its beginnings; a mark keeps the two apart."""
    return [word] + [f"{word[:n]}*" for n in STEM_LENGTHS if len(word) >= n]


def lower_bound(hit: float, n: float, z: float = 1.64) -> float:
    """Wilson's lower bound of a share."""
    p = hit / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


class Recent:
    """What a function gives for keys; of ``most`` values held, those that weren't asked for lately are forgotten first."""

    def __init__(self, make: Callable[[str], object], most: int):
        self.make, self.most, self.new, self.old = make, most, {}, {}

    def values(self, keys: set[str]) -> list:
        if len(self.new) >= self.most // 2:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        for key in [k for k in keys if k not in new]:
            value = old.get(key)
            new[key] = self.make(key) if value is None else value
        return list(map(new.__getitem__, keys))


class Scorer:
    def __init__(self, chars: CharModel):
        self.chars, self.weights = chars, None
        self.know({})
        self.forget()

    def forget(self) -> None:
        self.restored: dict[str, tuple[str, ...]] = {}
        self.strength, self.stems_by = Recent(self.strongest, CACHE_WORDS), Recent(self.token_stems, CACHE_WORDS // 2)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("restored", "strength", "stems_by")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.forget()

    def restore(self, token: str) -> tuple[str, ...]:
        """The words that a token stands for, and the one that it is if no symbol ends a word."""
        token = token.strip(EDGES)
        if (x := self.restored.get(token)) is None:
            path = self.chars.path(token)
            x = path.split()
            if " " in path or token[:1] in STANDS_FOR:  # a mark before the first letter leaves no trace
                x += self.chars.decode(token, marks=False)
            x = tuple(dict.fromkeys(x))
            if len(token) <= LONGEST_TOKEN:
                if len(self.restored) >= CACHE_WORDS // 4:
                    self.restored.clear()
                self.restored[token] = x
        return x

    def token_words(self, token: str) -> list[str]:
        """The words of a lower-cased token as written, and as restored unless it is plain: letters, none repeated."""
        if token.isalpha() and not REPEATED.search(token):
            return [token]
        found = [token] if token.isalpha() else WORD.findall(token)
        if found:
            for inner in dict.fromkeys((token.strip(EDGES), token.strip(SYMBOL_EDGES))):
                if not inner.isalpha() or REPEATED.search(inner):
                    found += self.restore(inner)
        return found

    def spaced_words(self, text: str) -> list[str]:
        """What runs of single characters in a lower-cased text spell."""
        out = []
        for m in SPACED.finditer(text):
            gaps = GAP.findall(m[0])
            least = min(map(len, gaps))
            out += self.restore("".join(c + (WIDE if len(g) > least else " ") for c, g in zip(GAP.split(m[0]), [*gaps, " "], strict=True)).strip())
        return out

    def tokens(self, text: str | None) -> set[str]:
        """Distinct tokens of a text and the words of its runs of single characters."""
        text = (text or "").lower()
        return {*text.split(), *self.spaced_words(text)}

    def token_stems(self, token: str) -> tuple[str, ...]:
        words = self.token_words(token)
        return tuple(stems_of(words[0]) if len(words) == 1 else {s for w in words for s in stems_of(w)})

    def stems_in(self, text: str) -> set[str]:
        """Distinct stems of the text's words, as written and as restored."""
        return set().union(*self.stems_by.values(self.tokens(text)))

    def know(self, stems: dict[str, float]) -> None:
        """Take up stems with their strengths, and the beginnings by which a token that has none is told at once."""
        self.stems = stems
        self.heads = {s[:HEAD] for s in stems}
        squeezed = lambda found: {REPEATED_RUN.sub(r"\1", s) for s in found}
        self.squeezed = squeezed(s[:-1] for s in stems if s.endswith("*")), squeezed(s for s in stems if not s.endswith("*"))
        self.lengths = sorted({len(s) for s in self.squeezed[0]})

    def may_have_stem(self, forms: tuple[str, ...]) -> bool:
        """Whether words of the forms of a token can have a stem.

        What a token of letters can be restored to differs in marks and repeats only, so its beginnings without them tell.
        """
        beginnings, words = self.squeezed
        for f in forms:
            if f in words:
                return True
            for n in self.lengths:
                if f[:n] in beginnings:
                    return True
        return False

    def strongest(self, token: str) -> tuple[float, str]:
        """The strongest stem of a token's words, (0, "") if it has none."""
        core = token.strip(EDGES)  # marks at the edges are no part of a word
        if core.isalpha() and (forms := plain_forms(core)) and not self.may_have_stem(forms):
            return NO_STEM
        best, known, heads = NO_STEM, self.stems, self.heads
        for w in self.token_words(token):
            if w[:HEAD] in heads:
                for s in stems_of(w):
                    if (x := known.get(s)) is not None and (x, s) > best:
                        best = (x, s)
        return best

    def features(self, text: str | None) -> list[float]:
        found = set(self.strength.values(self.tokens(text)))
        top = sorted((x for x, _ in found), reverse=True)[:3]
        top += [0.0] * (3 - len(top))
        return [1.0, top[0], top[1], top[2]]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.weights, self.features(text)))))))


def stem_counts(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """``(stem, toxic, docs)`` over rows of ``(text, toxic)``."""
    held = rows.sparkSession.sparkContext.broadcast(scorer)

    def make():
        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            total: dict[int, Counter] = defaultdict(Counter)
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[toxic].update(held.value.stems_in(text))
            found = [(list(c), [toxic] * len(c), list(c.values())) for toxic, c in total.items()]
            stems, toxic, docs = (list(itertools.chain.from_iterable(x)) for x in zip(*found, strict=True)) if found else ([], [], [])
            return pa.record_batch([pa.array(stems, pa.string()), pa.array(toxic, pa.int32()), pa.array(docs, pa.int64())], ["stem", "toxic", "docs"])

        return count

    return map_batches(rows, "text", "stem string, toxic int, docs long", make, 4 * SLICE_BYTES).groupBy("stem", "toxic").agg(F.sum("docs").alias("docs"))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", key: str = "doc_id", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> Scorer:
    """The character model sees every text of ``docs``; the scorer sees a bounded, hash-chosen sample of the labels."""
    spark = docs.sparkSession
    counts = np.zeros(SYMBOLS**3)
    for r in trigram_counts(docs, text_col).collect():  # 27 ** 3 rows at most
        counts[r.gram] = r.n
    scorer = Scorer(CharModel(counts))
    known = bounded_sample(labels.where(F.col(label_col).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(label_col).cast("int").alias("toxic")), "__key", train_docs)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(key).alias("__key"), F.col(text_col).alias("text")).join(F.broadcast(known), "__key").select("text", "toxic")  # known is bounded by train_docs
    rows = materialise(rows, "toxicity-train")
    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size:
        return scorer
    wide = stem_counts(rows, scorer).groupBy("stem").agg(F.sum(F.when(F.col("toxic") == 1, F.col("docs")).otherwise(0)).alias("hit"), F.sum("docs").alias("n"))
    share = size.get(1, 0) / sum(size.values())
    likely = wide.where((F.col("n") >= MIN_DOCS) & (F.col("hit") > F.col("n") * min(0.5, 1.5 * share)))
    bounds = {r.stem: lower_bound(r.hit, r.n) for r in likely.collect()}  # stems of ``train_docs`` documents, MIN_DOCS of them at least
    scorer.know({stem: x for stem, x in bounds.items() if x > share})  # others may be as toxic as any text
    held = spark.sparkContext.broadcast(scorer)

    def make():
        def features(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([held.value.features(t) for t in batch.column(0).to_pylist()]).round(2)
            return pa.record_batch([*(pa.array(x[:, i]) for i in range(4)), batch.column(1)], ["a", "b", "c", "d", "toxic"])

        return features

    points = map_batches(rows, "text", "a double, b double, c double, d double, toxic int", make).groupBy("a", "b", "c", "d", "toxic").count().collect()
    x, y, n = (np.array([f(p) for p in points], float) for f in (lambda p: p[:4], lambda p: p.toxic, lambda p: p[5]))
    # one strong stem should do: the others' weights are held closer to 0
    w, ridge = np.zeros(4), np.diag([1e-6, 0.01, 1.0, 1.0])
    for _ in range(50):  # Newton's steps of a logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ w)
    scorer.weights = w
    return scorer


def score(df: DataFrame, scorer: Scorer, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with ``score`` and ``predicted``."""
    held = df.sparkSession.sparkContext.broadcast(scorer)
    if taken := {"score", "predicted"}.intersection(keep):
        raise ValueError(f"kept columns clash with those of the result: {sorted(taken)}")
    rows = df.select(*keep, F.col(text_col).alias("__text"))

    def make():
        def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = [held.value.score(t) for t in batch.column(len(keep)).to_pylist()]
            return pa.record_batch([*batch.columns[: len(keep)], pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], [*keep, "score", "predicted"])

        return scored

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__text").schema)
    return map_batches(rows, "__text", f"{schema}, score double, predicted int", make)


def without_toxic(docs: DataFrame, scorer: Scorer, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows that score under ``limit``, with all their columns."""
    held, at = docs.sparkSession.sparkContext.broadcast(scorer), docs.columns.index(text_col)

    def make():
        def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([held.value.score(t) < limit for t in batch.column(at).to_pylist()], pa.bool_()))

        return keep

    return map_batches(docs, text_col, docs.schema, make)
