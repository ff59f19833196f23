"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased; runs of ASCII characters that are neither letters nor digits become single spaces; all is bytes.  If a window of ``m`` bytes of a
benchmark item occurs in a document with at most ``k`` edits, they share at least ``m + 1 - q - k * q`` q-grams, and these
lie on diagonals no more than ``k`` apart.  So shared q-grams are counted in diagonal bands of width ``2k`` that overlap by
``k``; bands that meet the bound are kept and verified by an alignment within the band.  An item shorter than the window
counts as a whole.

Defined results: null and empty texts leak nothing; items that are null or have no letter or digit match nothing; items
under ``q`` bytes match where they stand as whole words; texts of any length, and with q-grams that repeat without end,
are gone through in blocks of bounded numbers of shared q-grams; a document is reported once per item with its best
region (the fewest edits, then the first place); repeated rows are reported each, and items of one id by the better one;
a null document id is reported as null; an empty benchmark or table finds nothing; extra columns, whatever their names,
are ignored by ``find_leaks`` and kept by ``without_leaks``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.shared import map_batches

Q = 8
WINDOW = 80
#: Edits allowed in a window, as a share of it.
ERROR = 0.075
#: Bytes of benchmark text that are indexed, and broadcast, at once; a larger benchmark takes several passes.
BLOCK_BYTES = 16 << 20
CACHE_REGIONS = 50_000
#: Positions of texts that are looked up at once, shared q-grams that are laid out at once, windows that are aligned at once.
POSITIONS, SHARED, WINDOWS = 1 << 20, 1 << 20, 4096
#: A cell of an alignment holds its edits times this, plus the place where it began.
UNIT = 1 << 32
#: ASCII bytes that are neither letters nor digits become spaces.
TO_SPACE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
MIX, BITS = np.uint64(0x9E3779B97F4A7C15), 22


def normalise(text: str | None) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(TO_SPACE).split()) if text else b""


def best_window(item: np.ndarray, text: np.ndarray, low: int, high: int, m: int) -> tuple[int, int, int]:
    """(edits, start, end) in the text of the window of ``m`` item bytes that takes the fewest edits on diagonals low..high.

    Every window of the item is aligned on its own, several at once; it may begin and end anywhere within the band.  Of
    windows with equally few edits the one that begins first in the text counts.
    """
    width = high - low + 1
    at = np.arange(width, dtype=np.int64)
    before, after = max(0, -low), max(0, len(item) + high + 1 - len(text))
    padded = np.concatenate([np.zeros(before, np.uint8), text, np.zeros(after, np.uint8)])  # no normalised byte is 0
    best = (m + 1, 0, 0)
    for first in range(0, len(item) - m + 1, WINDOWS):
        starts = np.arange(first, min(first + WINDOWS, len(item) - m + 1))[:, None]
        cells = np.broadcast_to(starts + low + at, (len(starts), width)).copy()
        for i in range(m):
            step = cells + UNIT * (padded[starts + i + low + before + at] != item[starts + i])
            step[:, :-1] = np.minimum(step[:, :-1], cells[:, 1:] + UNIT)
            cells = np.minimum.accumulate(step - at * UNIT, axis=1) + at * UNIT
        k, d = np.unravel_index(int(cells.argmin()), cells.shape)
        edits, start = divmod(int(cells[k, d]) - low, UNIT)
        best = min(best, (edits, start + low, int(starts[k, 0]) + m + low + int(d)))
    return best


class BenchmarkIndex:
    """q-grams of a block of benchmark items, with the places they occur."""

    def __init__(self, items: list[tuple[int, bytes]], q: int = Q, window: int = WINDOW, error: float = ERROR):
        self.q, self.window = q, window
        self.short: dict[bytes, list[int]] = {}
        for i, t in items:
            if 0 < len(t) < q:
                self.short.setdefault(t, []).append(i)
        self.short_words = sorted({t.count(b" ") + 1 for t in self.short})
        self.items = [(i, t) for i, t in items if len(t) >= q]
        self.spans = [min(window, len(t)) for _, t in self.items]
        # the budget of a short window is lowered until the bound asks for a shared q-gram
        self.edits = [min(int(m * error), max(0, (m - q) // q)) for m in self.spans]
        self.bound = np.array([m + 1 - q - k * q for m, k in zip(self.spans, self.edits, strict=True)], np.int64)
        self.most_edits = max(self.edits, default=0)
        self.longest = max((len(t) for _, t in self.items), default=0)
        grams = [self.grams(np.frombuffer(t, np.uint8)) for _, t in self.items]
        code = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.codes, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << BITS, bool)
        self.filter[self.slot(self.codes)] = True
        self.cache: dict[tuple[int, bytes, int, int], tuple | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def grams(self, raw: np.ndarray) -> np.ndarray:
        """Every q bytes as an integer (q is 8 at most)."""
        if len(raw) < self.q:
            return np.zeros(0, np.uint64)
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        view = np.ndarray((len(raw) - self.q + 1,), "<u8", padded.data, 0, (1,))
        return view & np.uint64((1 << 8 * self.q) - 1)

    @staticmethod
    def slot(codes: np.ndarray) -> np.ndarray:
        return ((codes * MIX) >> np.uint64(64 - BITS)).astype(np.int64)

    def hits(self, raw: np.ndarray):
        """(position, item, place in the item) of the q-grams that the text shares with an item, in blocks.

        Blocks overlap by as much as a window may cover, so the q-grams of every occurrence are together in one.
        """
        reach = self.window + self.most_edits
        apron = 2 * reach
        for start in range(0, max(0, len(raw) - self.q + 1), POSITIONS):
            first = max(0, start - apron)
            codes = self.grams(raw[first : start + POSITIONS + apron + self.q - 1])
            at = np.flatnonzero(self.filter[self.slot(codes)])
            if not len(at) or not len(self.codes):
                continue
            k = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
            real = self.codes[k] == codes[at]
            at, k = at[real], k[real]
            dense = self.dense(at)
            at, k = at[dense], k[dense]
            n = self.count[k]
            total = np.cumsum(n)
            a = 0
            while a < len(at):
                b = max(int(np.searchsorted(total, total[a] - n[a] + SHARED, side="right")), int(np.searchsorted(at, at[a] + 2 * reach)), a + 1)
                some, of = n[a:b], k[a:b]
                post = np.repeat(self.first[of] - np.cumsum(some) + some, some) + np.arange(some.sum())
                yield np.repeat(at[a:b], some) + first, self.owner[post], self.place[post]
                a = int(np.searchsorted(at, at[b - 1] - reach)) if b < len(at) else b

    def dense(self, at: np.ndarray) -> np.ndarray:
        """Which of the sorted positions lie in a stretch, as long as a window may get, with as many of them as any bound asks for."""
        reach = self.window + self.most_edits
        after = np.searchsorted(at, at + reach)
        good = after - np.arange(len(at)) >= self.bound.min()
        cover = np.zeros(len(at) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(good), 1)
        np.add.at(cover, after[good], -1)
        return np.cumsum(cover[:-1]) > 0

    def regions(self, raw: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, lowest and highest diagonal) of the bands that meet the bound, over texts laid end to end."""
        found: set[tuple[int, int, int, int]] = set()
        k = max(1, self.most_edits)
        for pos, item, place in self.hits(raw):
            diagonal = pos - place + self.longest
            for shift in (0, k):
                band = (diagonal + shift) // (2 * k)
                low = int(band.min())
                key = item * (int(band.max()) - low + 1) + band - low
                order = np.argsort(key, kind="stable")
                ordered = key[order]
                heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                sizes = np.diff(np.append(heads, len(ordered)))
                enough = sizes >= self.bound[item[order[heads]]]
                for head, size in zip(heads[enough].tolist(), sizes[enough].tolist(), strict=True):
                    some = order[head : head + size]
                    own = np.searchsorted(starts, pos[some], side="right") - 1
                    i = int(item[some[0]])
                    for text in np.unique(own).tolist():
                        mine = some[own == text]
                        if len(np.unique(place[mine])) >= self.bound[i]:
                            near = pos[mine] - place[mine] - starts[text]
                            found.add((text, i, int(near.min()), int(near.max())))
        return sorted(found)

    def verify(self, i: int, text: bytes, low: int, high: int) -> tuple[int, int, int] | None:
        """(start, end, edits) of the best window of item ``i`` that meets the budget, else None."""
        item, m, k = self.items[i][1], self.spans[i], self.edits[i]
        pad = self.most_edits
        begin, end = max(0, low - pad), min(len(text), high + pad + len(item) + 1)
        part = text[begin:end]
        key = (i, part, low - begin, high - begin)
        if key not in self.cache:
            if len(self.cache) >= CACHE_REGIONS:
                self.cache.clear()
            at = part.find(item)
            if at >= 0:
                self.cache[key] = (at, at + len(item), 0)
            else:
                edits, first, last = best_window(np.frombuffer(item, np.uint8), np.frombuffer(part, np.uint8), low - begin - pad, high - begin + pad, m)
                self.cache[key] = (max(0, first), min(len(part), last), edits) if edits <= k else None
        found = self.cache[key]
        return found and (found[0] + begin, found[1] + begin, found[2])

    def leaks(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(number of the text, item id, start, end, edits), one for each text and item, the fewest edits first."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        for text, i, low, high in self.regions(np.frombuffer(b"\0".join(texts), np.uint8), starts) if texts else []:
            key = (text, self.items[i][0])
            if best.get(key, (1,))[0] == 0 and best[key][1] <= low:
                continue  # nothing better follows: regions come in the order of their diagonals
            if found := self.verify(i, texts[text], low, high):
                best[key] = min(best.get(key, (found[2], found[0], found[1])), (found[2], found[0], found[1]))
        for n, text in enumerate(texts if self.short else ()):
            words = text.split()
            begins = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
            for width in self.short_words:
                for a in range(len(words) - width + 1):
                    phrase = b" ".join(words[a : a + width])
                    for item_id in self.short.get(phrase, ()):
                        best[n, item_id] = min(best.get((n, item_id), (1, 0, 0)), (0, begins[a], begins[a] + len(phrase)))
        return [(n, i, s, e, d) for (n, i), (d, s, e) in sorted(best.items())]


def index_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES):
    """Index the benchmark in blocks of bounded size; only one block is on the driver at a time."""
    rows = benchmark.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    for b in range(blocks):
        some = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield BenchmarkIndex(sorted((r.id, normalise(r.text)) for r in some.collect()))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, start, end, edits)``; start and end are byte offsets in the normalised text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    out = None
    for index in index_blocks(benchmark, item_col, item_text):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def make(held=held):
            def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = held.value.leaks([normalise(t) for t in batch.column(1).to_pylist()])
                cols = list(zip(*found, strict=True)) or [()] * 5
                return pa.record_batch([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "item_id", "start", "end", "edits"])

            return scan

        part = map_batches(rows, "text", "doc_id long, item_id long, start long, end long, edits long", make)
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns."""
    for index in index_blocks(benchmark, item_col, item_text):
        held, at = docs.sparkSession.sparkContext.broadcast(index), docs.columns.index(text_col)

        def make(held=held, at=at):
            def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
                bad = {x[0] for x in held.value.leaks([normalise(t) for t in batch.column(at).to_pylist()])}
                return batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

            return scan

        docs = map_batches(docs, text_col, docs.schema, make)
    return docs
