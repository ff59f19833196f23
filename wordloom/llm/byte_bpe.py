"""Byte-level BPE by overlapping chunks.

A text is cut into chunks that overlap; each chunk is pre-tokenised on its own, those of a long text as rows of their
own, in parallel.  Neighbouring chunks are stitched at the first boundary that both of them see, because from a shared
boundary on a left-to-right pre-tokeniser goes the same way; where they share none (one pre-token fills the overlap), the
pre-tokeniser walks on from the last sure boundary until it meets one of the next chunk.  Boundaries close to the end of
a chunk are not sure, for the cut may have made them.  The stitched pre-tokens are then encoded, a distinct one once.
Decoding concatenates raw bytes.

The pattern looks ahead by fewer than ``MARGIN`` characters, does not look back, and matches every character, as the
byte-level ones of the public vocabularies do.

Defined results: a null or empty text has no ids, and the hash of nothing; texts of any length are stitched chunk by
chunk, with one chunk and its pre-token in hand; a row repeated in the input is repeated in the output, and rows with one
id and different texts are a document each; a null id stays null; an empty table gives no rows; other columns of the
input, whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.shared import grouped, map_batches, map_in_arrow, text_slices

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 2_048
#: Characters before a cut in which no boundary is sure; more than the pattern looks ahead.
MARGIN = 3
#: Distinct pre-tokens whose ids a worker remembers.
CACHE_PRETOKENS = 300_000


class ChunkedBpe:
    """Encoder and decoder for a rank table and its pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        if not MARGIN < overlap <= chunk:
            raise ValueError("the overlap is longer than the margin, and a chunk at most")
        self.engine = tiktoken.Encoding("chunked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.chunk, self.overlap = regex.compile(pattern), chunk, overlap
        self.rank_of_line_end = ranks.get(b"\n")
        self.ids_of: dict[str, bytes] = {}  # what came lately
        self.old: dict[str, bytes] = {}  # and before that
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def chunks(self, text: str) -> Iterator[tuple[int, str, bool]]:
        """Start, characters and whether it is the last, of each chunk; the last one reaches the end of the text."""
        start, last = 0, False
        while not last:
            last = start + self.chunk + self.overlap >= len(text)
            yield start, text[start : start + self.chunk + self.overlap], last
            start += self.chunk

    def ends(self, chunk: str, last: bool) -> list[int]:
        """Ends of a chunk's pre-tokens, but for those that the cut may have made."""
        most = len(chunk) if last else len(chunk) - MARGIN
        return [e for m in self.pattern.finditer(chunk) if (e := m.end()) <= most]

    def pretokens(self, text: str) -> list[str]:
        """All pre-tokens of a text; those of a text of one chunk need no stitching."""
        if len(text) <= self.chunk + self.overlap:
            return self.pattern.findall(text)
        stitch = Stitcher(self)
        return [p for start, chunk, last in self.chunks(text) for p in stitch.feed(start, chunk, self.ends(chunk, last), last)]

    def learn(self, pretokens: list[str]) -> None:
        """Encode pre-tokens that aren't held yet: those without a line end in one call, with line ends between them.

        A line end there is a pre-token of its own, so its rank marks where one pre-token's ids end.
        """
        mark = self.rank_of_line_end
        plain = [p for p in pretokens if mark is not None and "\n" not in p and not p.isspace()]
        if plain:
            ids = self.engine.encode_to_numpy("\n".join(plain), disallowed_special=()).astype("<u4", copy=False)
            ends = np.append(np.flatnonzero(ids == mark), len(ids))
            if len(ends) == len(plain):
                raw, start = ids.tobytes(), 0
                for pretoken, end in zip(plain, (ends * 4).tolist(), strict=True):
                    self.ids_of[pretoken] = raw[start:end]
                    start = end + 4
        for pretoken in pretokens:
            if pretoken not in self.ids_of:
                self.ids_of[pretoken] = array("I", self.engine._core_bpe.encode_single_piece(pretoken.encode())).tobytes()

    def encode_pieces(self, pieces: list[list[str]]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each list of pre-tokens."""
        if len(self.ids_of) > CACHE_PRETOKENS // 2:
            self.ids_of, self.old = {}, self.ids_of
        held, old = self.ids_of, self.old
        new = set().union(*pieces).difference(held)
        held.update((p, old[p]) for p in new if p in old)
        self.learn([p for p in new if p not in held])
        get = held.__getitem__
        return [b"".join(map(get, x)) for x in pieces]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        return self.encode_pieces([self.pretokens(t) if t else [] for t in texts])

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_all([text])[0], "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


class Stitcher:
    """Takes a text's chunks with their pre-token ends, in order, and gives its pre-tokens."""

    def __init__(self, bpe: ChunkedBpe):
        self.bpe = bpe
        self.at, self.seen, self.tail = 0, 0, ""  # the last sure end, the end of what came, and the text between
        self.recent = {0}  # sure ends that the next chunk can see
        self.walked = 0  # length of a tail in which no end was found

    def feed(self, start: int, chunk: str, ends: list[int], last: bool) -> list[str]:
        text = self.tail + chunk[self.seen - start :]
        self.seen = start + len(chunk)
        places = [start, *(start + e for e in ends)]
        if any(p in self.recent for p in places):
            new = [p for p in places if p > self.at]
        else:
            new = self.walk(text, set(places), places, last)
        out, a = [], self.at
        for b in new:
            out.append(text[a - self.at : b - self.at])
            a = b
        self.tail, self.at = text[a - self.at :], a
        self.recent = {p for p in self.recent.union(new) if p >= start + self.bpe.chunk}
        return out

    def walk(self, text: str, own: set[int], places: list[int], last: bool) -> list[int]:
        """Sure ends after the last one.  A tail without an end is searched again when it has doubled."""
        if not last and len(text) < 2 * self.walked:
            return []
        new, most = [], self.at + len(text) - (0 if last else MARGIN)
        for m in self.bpe.pattern.finditer(text):
            p = self.at + m.end()
            if p > most:
                break
            new.append(p)
            if p in own:
                new += [x for x in places if x > p]
                break
        self.walked = 0 if new else len(text)
        return new


@functools.cache
def load(path: str, pattern: str) -> ChunkedBpe:
    with open(path, "rb") as f:
        return ChunkedBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def by_document(df: DataFrame, path: str, pattern: str, id_col: str, text_col: str, schema: str, made: Callable[[ChunkedBpe, list, list[bytes]], pa.RecordBatch]) -> DataFrame:
    """``made`` of the ids of every row's text: (encoder, document ids, token ids of each) to a batch of ``schema``.

    A text of one chunk is encoded where it is.  Chunks of longer ones are dealt out and pre-tokenised, then dealt by
    document, where they are stitched in order and encoded piece by piece.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    one = F.coalesce(F.char_length("text"), F.lit(0)) <= CHUNK_CHARS + OVERLAP_CHARS
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def make():
        bpe = load(path, pattern)
        return lambda batch: made(bpe, batch.column(0).to_pylist(), bpe.encode_all(batch.column(1).to_pylist()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for piece in text_slices(batch, "text"):
                for doc_id, text in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    raw = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
                    for start, chunk, last in bpe.chunks(text):
                        yield pa.record_batch([pa.array([doc_id], pa.int64()), pa.array([raw]), pa.array([start], pa.int64()), pa.array([last]), pa.array([chunk])], ["id", "text_hash", "start", "last", "text"])

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for piece in text_slices(batch, "text"):
                ends = [np.array(bpe.ends(t, last), "<i4").tobytes() for t, last in zip(piece.column(4).to_pylist(), piece.column(3).to_pylist(), strict=True)]
                yield pa.record_batch([*piece.columns, pa.array(ends, pa.binary())], ["id", "text_hash", "start", "last", "text", "ends"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, copies, stitcher, ids = load(path, pattern), 0, None, []
        for (doc_id, _, start), held in grouped(batches, 3):  # equal rows have equal chunks: their number is that of the copies
            text, ends, last = (held[0].column(k)[0].as_py() for k in (4, 5, 3))
            if start == 0:
                stitcher, ids, copies = Stitcher(bpe), [], sum(b.num_rows for b in held)
            ids += bpe.encode_pieces([stitcher.feed(start, text, np.frombuffer(ends, "<i4").tolist(), last)])
            if last:
                whole = b"".join(ids)
                for _ in range(copies):
                    yield made(bpe, [doc_id], [whole])

    short = map_batches(rows.where(one), "text", schema, make)
    chunks = map_in_arrow(rows.where(~one), cut, "id long, text_hash binary, start long, last boolean, text string").repartition(parts, "text_hash", "start")
    seen = map_in_arrow(chunks, pretokenise, "id long, text_hash binary, start long, last boolean, text string, ends binary")
    placed = seen.repartition(parts, "id", "text_hash").sortWithinPartitions("id", "text_hash", "start")
    return short.unionByName(map_in_arrow(placed, stitch, schema))


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids)`` per row; ids are little-endian unsigned 32-bit integers."""

    def made(_: ChunkedBpe, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    return by_document(df, path, pattern, id_col, text_col, "id long, n_tokens long, ids binary", made)


def round_trip_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` per row: encodes and decodes in one pass, so no ids are moved."""

    def made(bpe: ChunkedBpe, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
        ids_sha = [hashlib.sha256(x).hexdigest() for x in ids]
        text_sha = [hashlib.sha256(bpe.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in ids]
        return pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return by_document(df, path, pattern, id_col, text_col, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", made)
