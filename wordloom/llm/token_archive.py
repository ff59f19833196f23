"""Token-id archives: one zstandard dictionary for all documents, every document a frame of its own.

A file holds, one after another::

    magic "WLTOKEN1" | sha256 of the dictionary (32 bytes) | frames | index | footer

The index has, for each document in ascending id order, doc_id (int64), ids before it in the file (int64), number of
ids (int64), frame offset (int64) and frame length (int64).  The footer is the index's offset, the number of documents
(both int64) and the magic again.  A frame holds a width byte (2 or 4) before compression, then the ids as little-endian
unsigned integers of that width.  A reader takes the footer, the index and then only the frames it wants.

Defined results: a null text counts as empty and holds the end id alone; a text of any length is one frame; rows without
an id have no place in the order and are left out; equal doc_ids stay together, in the order of their texts; an empty
table gives no rows; extra columns, whatever their names, are ignored.  Files are written under a temporary name
and renamed, and hold the same bytes whenever a task is run again.
"""

from __future__ import annotations

import functools
import hashlib
import json
import posixpath
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.shared import bounded_sample, fresh_path, map_batches, materialise, text_slices

MAGIC = b"WLTOKEN1"
#: Documents that the dictionary is trained on, about, at most; text of theirs, about, at most; its size in bytes.
DICT_DOCS, DICT_TEXT, DICT_BYTES = 2_000, 16 << 20, 64 << 10
#: Bytes of a training sample: a longer id array is several.
SAMPLE_BYTES = 16 << 10
#: Distinct pre-tokens whose ids a worker remembers.
CACHE_UNITS = 300_000


# The pre-token pattern and the normalizers of the tokenizer whose pre-tokens are cut here.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
END_OF_WORD = "</w>"
# Letters in lower case, and marks, that the pattern sees alike in Python and that no normalizer changes.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e"
MARKS = "\u2018\u2019\u201c\u201d\u2013\u2014\u2026\u00ab\u00bb\u00bf\u00a1"

#: Anything but plain characters; the library sees runs that hold one whole.
ODD = re.compile(rf"[^\t-\r -~\u00c0-\u00d6\u00d8-\u00de{LETTERS}{MARKS}]")
RUN = re.compile(r"[^ \t\n\r\f\v]+")
#: Pre-tokens of plain characters in lower case.
UNIT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")


class PretokenCache:
    """The ids of a text, one pre-token at a time; a distinct one is encoded once by the library and remembered.

    Added tokens such as <|endoftext|> are cut out first, as the library does, and have their own ids.  Plain text is
    then cut into the tokenizer's own pre-tokens.  Runs with other characters (combining marks, letters that change
    their length in lower case, white space beyond ASCII) go to the library whole, for white space ends a pre-token and
    leaves no id.  A tokenizer with another pattern gets whole texts.
    """

    def __init__(self, path: str, most: int = CACHE_UNITS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.held, self.old = {}, {}  # what came lately, and before that
        made = json.loads(self.tokenizer.to_str())
        first, kinds = made.get("normalizer") or {}, (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.known = [n.get("type") for n in first.get("normalizers", ())] == NORMALIZERS and kinds[0].get("pattern") == {"Regex": PATTERN} and made["model"].get("end_of_word_suffix") == END_OF_WORD
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.known &= not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        self.names = sorted((t.content for t in added), key=len, reverse=True)  # the longest first, as the library matches them
        self.cut = re.compile("|".join(map(re.escape, self.names)))
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(END_OF_WORD)]] = True

    def units(self, text: str, odd: set[str]) -> list[str]:
        """Pre-tokens of a text in order; ``odd`` takes up those that are no plain ones."""
        if not self.known:
            odd.add(text)
            return [text]
        if not any(name in text for name in self.names):
            return self.plain_units(text, odd)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self.plain_units(text[at : m.start()], odd), m[0]]
            odd.add(m[0])
            at = m.end()
        return out + self.plain_units(text[at:], odd)

    @staticmethod
    def plain_units(text: str, odd: set[str]) -> list[str]:
        if not ODD.search(text):
            return UNIT.findall(text.lower())
        out, at = [], 0
        for m in RUN.finditer(text):
            if ODD.search(m[0]):
                out += [*UNIT.findall(text[at : m.start()].lower()), m[0]]
                odd.add(m[0])
                at = m.end()
        return out + UNIT.findall(text[at:].lower())

    def learn(self, plain: list[str], odd: list[str]) -> None:
        """Encode units; plain ones many at once, with spaces between: a unit ends where an id ends a word."""
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some) or int(ends[-1]) != len(ids):
                odd = odd + some
                continue
            raw, start = ids.tobytes(), 0
            for unit, end in zip(some, (4 * ends).tolist(), strict=True):
                self.held[unit] = raw[start:end]
                start = end
        for unit in odd:
            self.held[unit] = np.array(self.tokenizer.encode(unit, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        odd: set[str] = set()
        units = [self.units(t, odd) if t else [] for t in texts]
        if len(self.held) > self.most // 2:
            self.held, self.old = {}, self.held
        held, old = self.held, self.old
        new = set().union(*units).difference(held)
        for u in [u for u in new if u in old]:
            held[u] = old[u]
            new.discard(u)
        self.learn(list(new - odd), list(new & odd))
        get = self.held.__getitem__
        return [b"".join(map(get, x)) for x in units]


@functools.cache
def pretoken_cache(path: str) -> PretokenCache:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
    return PretokenCache(path)


def pack(ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return bytes([4 if wide else 2]) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if raw[0] == 4 else "<u2", offset=1).astype("<u4")


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A shared dictionary; with too little to train on, the samples themselves serve as a raw one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def encode_file(ids: list[int], arrays: list[np.ndarray], dictionary: bytes) -> bytes:
    """One whole archive file."""
    writer = FileWriter(dictionary)
    out = [writer.head(), *(writer.add(i, a) for i, a in zip(ids, arrays, strict=True)), writer.tail()]
    return b"".join(out)


class FileWriter:
    def __init__(self, dictionary: bytes):
        self.sha = hashlib.sha256(dictionary).digest()
        self.squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.at, self.tokens, self.index = 0, 0, []

    def head(self) -> bytes:
        self.at = len(MAGIC) + 32
        return MAGIC + self.sha

    def add(self, doc_id: int, ids: np.ndarray) -> bytes:
        frame = self.squeeze.compress(pack(ids))
        self.index.append((doc_id, self.tokens, len(ids), self.at, len(frame)))
        self.at += len(frame)
        self.tokens += len(ids)
        return frame

    def tail(self) -> bytes:
        return np.array(self.index, "<i8").reshape(-1, 5).tobytes() + np.array([self.at, len(self.index)], "<i8").tobytes() + MAGIC


class FileReader:
    """Reads an archive file by ranges; ``read(offset, length)`` is all that it needs of a store."""

    FOOTER = 16 + len(MAGIC)

    def __init__(self, read, size: int, dictionary: bytes):
        foot = read(size - self.FOOTER, self.FOOTER)
        if foot[16:] != MAGIC or read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token archive, or one cut short")
        if read(len(MAGIC), 32) != hashlib.sha256(dictionary).digest():
            raise ValueError("the archive was written with another dictionary")
        at, n = np.frombuffer(foot[:16], "<i8").tolist()
        self.read = read
        self.index = np.frombuffer(read(at, n * 40), "<i8").reshape(n, 5)
        self.expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        return unpack(self.expand.decompress(self.read(int(self.index[k, 3]), int(self.index[k, 4]))))

    def find(self, doc_id: int) -> np.ndarray | None:
        k = int(np.searchsorted(self.index[:, 0], doc_id))
        return self.ids(k) if k < len(self.index) and self.index[k, 0] == doc_id else None


def write_archive(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> tuple[str, DataFrame, bytes]:
    """Encode, range-partition by id and write; returns the folder, its manifest and the dictionary."""
    spark = df.sparkSession
    path = path or fresh_path(spark, "tokens")
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked = bounded_sample(rows, "id", DICT_DOCS)
    share = DICT_TEXT / max(DICT_TEXT, asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    def sample() -> object:
        cache = pretoken_cache(tokenizer)

        def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = [pack(np.frombuffer(x[at : at + 2 * SAMPLE_BYTES], "<u4")) for x in cache.encode_all(batch.column(1).to_pylist()) for at in range(0, len(x) or 1, 2 * SAMPLE_BYTES)]
            return pa.record_batch([pa.array([x for x in packed if zlib.crc32(x) < share * (1 << 32)], pa.binary())], ["sample"])

        return encode

    dictionary = train_dictionary(sorted(r.sample for r in map_batches(asked, "text", "sample binary", sample).collect()))  # about DICT_TEXT at most
    held = spark.sparkContext.broadcast(dictionary)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.wltok"
        store, root = pa.fs.FileSystem.from_uri(path)
        end, cache, writer = np.array([end_id], "<u4").tobytes(), pretoken_cache(tokenizer), FileWriter(held.value)
        batch = next(batches, None)
        if batch is None:
            return
        store.create_dir(root, recursive=True)
        draft = posixpath.join(root, f".{name}.{context.taskAttemptId()}")
        with store.open_output_stream(draft) as out:
            out.write(writer.head())
            while batch is not None:
                for piece in text_slices(batch, "text"):
                    for doc_id, raw in zip(piece.column(0).to_pylist(), cache.encode_all(piece.column(1).to_pylist()), strict=True):
                        out.write(writer.add(doc_id, np.frombuffer(raw + end, "<u4")))
                batch = next(batches, None)
            out.write(writer.tail())
        store.move(draft, posixpath.join(root, name))
        yield pa.record_batch([pa.array([name]), pa.array([len(writer.index)], pa.int64()), pa.array([writer.tokens], pa.int64())], ["name", "docs", "tokens"])

    placed = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    return path, materialise(placed.mapInArrow(write, "name string, docs long, tokens long"), "tokens-manifest"), dictionary


def read_archive(path: str, manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """``(doc_id, start, ids)`` of every document, a task a file; the manifest has one small row a file."""
    spark = manifest.sparkSession
    files, start = [], 0
    for r in sorted(manifest.collect()):
        files.append((r.name, start))
        start += r.tokens
    held = spark.sparkContext.broadcast(dictionary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(posixpath.join(root, name)) as f:
                    reader = FileReader(lambda at, n, f=f: f.read_at(n, at), f.size(), held.value)
                    for at in range(0, len(reader.index), 500):
                        some = reader.index[at : at + 500]
                        ids = [reader.ids(k).tobytes() for k in range(at, at + len(some))]
                        yield pa.record_batch([pa.array(some[:, 0]), pa.array(some[:, 1] + base), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    listed = spark.createDataFrame(files, "name string, base long").repartition(max(1, len(files)))
    return listed.mapInArrow(read, "doc_id long, start long, ids binary")


def digest(df: DataFrame) -> DataFrame:
    """The archive's documents with the number and crc32 of their ids."""

    def make():
        def check(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(2).to_pylist()
            return pa.record_batch([*batch.columns[:2], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

        return check

    return map_batches(df, "ids", "doc_id long, start long, n_tokens long, ids_crc32 long", make)
