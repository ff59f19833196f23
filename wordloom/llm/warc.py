"""WARC archives with a two-level capture index.

Archives are ``.warc.gz`` files, a gzip member a record.  A payload that occurs again is written once: the record with
the smallest page id is a response, the others revisit it.  The capture index has a line for each record, sorted by
reversed-host URL key.  Lines go into compressed blocks; each index file ends in a sparse directory with the first key,
place and length of its blocks, and a small table names the first and last key of every index file.  A look-up searches
the table and then a file's directory by halving, reads the blocks that can hold the key, and then the records' ranges.
Many look-ups go to their index files together, in the order of their keys, so that a block is read once.

Defined results: a null html is an empty payload; a payload of any length is one record; a null url is written as
``urn:page:<id>``; rows without a page id are left out; every row is a record, so a row that is repeated is written
again, as a response if its id is the smallest with that payload, and rows of one page id with different payloads each
go by their own; payloads under ``min_bytes`` are never revisits; extra columns, whatever their names, are ignored; an
empty table writes nothing and reads as no rows.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import posixpath
import re
import zlib
from base64 import b32encode
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.shared import fresh_path, map_in_arrow, materialise, text_slices

DATE = "2000-01-01T00:00:00Z"
BLOCK_LINES = 512
#: Bytes at the end of an index file: place and length of its directory.
FOOTER_BYTES = 16
#: Records of a file that are read at once, and the gap between two that is read over.
READ_BYTES, GAP_BYTES = 4 << 20, 64 << 10
LEVEL = 4


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, ``www`` and default ports dropped, path and query lower-cased."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    labels = host.removeprefix("www.").split(".")[::-1]
    at = f":{port}" if port and (parts.scheme, port) not in {("http", 80), ("https", 443)} else ""
    return (",".join(labels) + at + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def payload_digest(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, digest: str, response: int | None) -> bytes:
    """A response record, or a revisit of the page ``response``; both state the full payload's length in their HTTP head."""
    uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]|^`{}\"<>\\") if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if response is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if response is not None:
        head += [f"WARC-Refers-To: <urn:page:{response}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC head, HTTP head and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def members(raw: bytes | memoryview) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of the gzip members of a buffer."""
    at = 0
    while at < len(raw):
        expand = zlib.decompressobj(31)
        content = expand.decompress(raw[at:])
        length = len(raw) - at - len(expand.unused_data)
        yield at, length, content
        at += length


def digest_of(html: Column) -> Column:
    return F.sha1(html.cast("binary"))


def revisits(rows: DataFrame, min_bytes: int) -> DataFrame:
    """``(page_id, d, refers_to)`` of the pages and payload digests that have a smaller id elsewhere, over rows ``(page_id, html)``.

    Groups of copies are only counted; the join back spreads a group over salts, so a payload that a third of the pages
    share does not meet in one task.
    """
    salts = 32
    known = rows.where(F.octet_length("html") >= min_bytes).select("page_id", digest_of(F.col("html")).alias("d"))
    groups = known.groupBy("d").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select("d", "refers_to", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > salts, salts - 1).otherwise(0))).alias("salt"), (F.col("n") > salts).alias("wide"))
    keyed = known.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    spread = keyed.join(groups.where("wide"), ["d", "salt"]).select("page_id", "d", "refers_to")
    small = keyed.drop("salt").join(groups.where("not wide"), "d").select("page_id", "d", "refers_to")
    return spread.union(small).where("page_id > refers_to").distinct()


def write_archives(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", path: str | None = None) -> tuple[str, DataFrame]:
    """Write the archives; returns their folder and the captures ``(key, page_id, file, offset, length)``."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(text_col), F.lit("")).alias("html"))
    found = revisits(rows, min_bytes).withColumnRenamed("page_id", "own")
    rows = rows.join(found, (F.col("page_id") == F.col("own")) & (digest_of(F.col("html")) == F.col("d")), "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"pages-{context.partitionId():06d}.warc.gz"
        store, root = pa.fs.FileSystem.from_uri(path)
        batch = next(batches, None)
        if batch is None:
            return
        store.create_dir(root, recursive=True)
        draft, at = posixpath.join(root, f".{name}.{context.taskAttemptId()}"), 0
        with store.open_output_stream(draft) as out:
            while batch is not None:
                for piece in text_slices(batch, "html"):
                    lines = []
                    for page_id, url, html, response in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                        payload = html.encode("utf-8", "surrogatepass")
                        raw = member(record(page_id, url, payload, payload_digest(payload), response))
                        out.write(raw)
                        lines.append((url_key(url) if url else f"urn:page:{page_id}", page_id, name, at, len(raw)))
                        at += len(raw)
                    keys, ids, names, offsets, sizes = zip(*lines, strict=True)
                    yield pa.record_batch([pa.array(keys), pa.array(ids, pa.int64()), pa.array(names), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], ["key", "page_id", "file", "offset", "length"])
                batch = next(batches, None)
        store.move(draft, posixpath.join(root, name))

    return path, materialise(map_in_arrow(rows, write, "key string, page_id long, file string, offset long, length long"), "warc-captures")


class RangeReader:
    """Ranges of the files of a folder, one file open at a time."""

    def __init__(self, path: str):
        self.store, self.root = pa.fs.FileSystem.from_uri(path)
        self.name, self.file = None, None

    def size(self, name: str) -> int:
        return self.store.get_file_info(posixpath.join(self.root, name)).size

    def fetch(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.store.open_input_file(posixpath.join(self.root, name))
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.name = self.file = None


def write_index(path: str, captures: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort captures by key and write the index files; returns ``(name, first, last, lines)``, a row an index file."""
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"index-{context.partitionId():06d}.cdx.gz"
        store, root = pa.fs.FileSystem.from_uri(path)
        lines: list[tuple] = []
        batch = next(batches, None)
        if batch is None:
            return
        draft, at, blocks, total, last = posixpath.join(root, f".{name}.{context.taskAttemptId()}"), 0, [], 0, ""
        with store.open_output_stream(draft, compression=None) as out:
            while batch is not None or lines:
                while batch is not None and len(lines) < block_lines:
                    lines += zip(*(c.to_pylist() for c in batch.columns), strict=True)
                    batch = next(batches, None)
                some, lines = lines[:block_lines], lines[block_lines:]
                raw = squeezed(some)
                out.write(raw)
                blocks.append((some[0][0], at, len(raw)))
                at, total, last = at + len(raw), total + len(some), some[-1][0]
            raw = squeezed(blocks)
            out.write(raw + footer(at, len(raw)))
        store.move(draft, posixpath.join(root, name))
        yield pa.record_batch([pa.array([name]), pa.array([blocks[0][0]]), pa.array([last]), pa.array([total], pa.int64())], ["name", "first", "last", "lines"])

    placed = captures.repartitionByRange(parts, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    return materialise(map_in_arrow(placed, write, "name string, first string, last string, lines long"), "warc-index")


def squeezed(lines: list[tuple]) -> bytes:
    return gzip.compress("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines).encode("utf-8", "surrogatepass"), LEVEL, mtime=0)


def footer(at: int, length: int) -> bytes:
    return at.to_bytes(8, "little") + length.to_bytes(8, "little")


def unsqueezed(raw: bytes) -> list[list]:
    return [json.loads(x) for x in gzip.decompress(raw).decode("utf-8", "surrogatepass").split("\n")[:-1]]


class IndexFile:
    """Look-ups in one index file: its directory is held, and the block that was read last."""

    def __init__(self, ranges: RangeReader, name: str):
        self.ranges, self.name, self.at, self.lines = ranges, name, -1, []
        size = ranges.size(name)
        end = ranges.fetch(name, size - FOOTER_BYTES, FOOTER_BYTES)
        self.directory = unsqueezed(ranges.fetch(name, int.from_bytes(end[:8], "little"), int.from_bytes(end[8:], "little")))
        self.keys = [d[0] for d in self.directory]

    def block(self, k: int) -> list[list]:
        if k != self.at:
            self.at, self.lines = k, unsqueezed(self.ranges.fetch(self.name, *self.directory[k][1:]))
        return self.lines

    def captures(self, key: str) -> Iterator[tuple]:
        """Lines of a key, which may run over several blocks."""
        for k in range(max(0, bisect.bisect_left(self.keys, key) - 1), bisect.bisect_right(self.keys, key)):
            lines = self.block(k)
            at = bisect.bisect_left(lines, [key])
            while at < len(lines) and lines[at][0] == key:
                yield tuple(lines[at])
                at += 1


def files_of(files: list[tuple[str, str, str, int]], key: str) -> list[str]:
    """Names of the index files, which are in the order of their keys, that can hold a key."""
    a, b = bisect.bisect_left(files, key, key=lambda f: f[2]), bisect.bisect_right(files, key, key=lambda f: f[1])
    return [f[0] for f in files[a:b]]


class CaptureIndex:
    """Look-ups by URL, for a few at a time."""

    def __init__(self, path: str, files: list[tuple[str, str, str, int]]):
        self.ranges, self.files, self.opened = RangeReader(path), sorted(files), {}

    def captures(self, url: str) -> list[tuple[str, int, str, int, int]]:
        key, out = url_key(url), []
        for name in files_of(self.files, key):
            if name not in self.opened:
                self.opened[name] = IndexFile(self.ranges, name)
            out += self.opened[name].captures(key)
        return out

    def records(self, url: str) -> list[bytes]:
        return [zlib.decompress(self.ranges.fetch(*c[2:]), 31) for c in self.captures(url)]


def look_up(path: str, index: DataFrame, urls: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The captures ``(page_id, file, offset, length)`` of all URLs of a table; a null URL is its page's own."""
    files = sorted(tuple(r) for r in index.collect())  # a row an index file, as many as shuffle partitions at most
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = {url_key(url) if url else f"urn:page:{page_id}" for page_id, url in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
            found = [(name, key) for key in keys for name in files_of(files, key)]
            yield pa.record_batch([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["name", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, opened = RangeReader(path), None
        for batch in batches:
            out = []
            for name, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if opened is None or opened.name != name:
                    opened = IndexFile(ranges, name)
                out += [c[1:] for c in opened.captures(key)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["page_id", "file", "offset", "length"])
        ranges.close()

    rows = urls.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    keys = map_in_arrow(rows, place, "name string, key string").distinct()
    return map_in_arrow(keys.repartitionByRange(parts, "name", "key").sortWithinPartitions("name", "key"), search, "page_id long, file string, offset long, length long")


def runs_of(places: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Sorted places in runs that one read brings in: of one file, near one another, ``READ_BYTES`` together unless it's one."""
    held: list[tuple[str, int, int]] = []
    for place in places:
        if held and (place[0] != held[-1][0] or place[1] - held[-1][1] - held[-1][2] > GAP_BYTES or place[1] + place[2] - held[0][1] > READ_BYTES):
            yield held
            held = []
        held.append(place)
    if held:
        yield held


def read_archives(path: str, captures: DataFrame) -> DataFrame:
    """The records of captures ``(page_id, file, offset, length)``, checked against their digests.

    Captures are dealt out by file and offset, so archives are read in order, neighbouring records together.
    """

    def described(raw: bytes) -> tuple:
        head, http, payload = parse(zlib.decompress(raw, 31))
        if head["WARC-Type"] == "response" and (len(payload) != int(http["Content-Length"]) or payload_digest(payload) != head["WARC-Payload-Digest"][5:]):
            raise ValueError(f"{head['WARC-Record-ID']}: the payload differs from its record")
        own, to = (re.fullmatch(r"<urn:page:(-?\d+)>", head.get(k, "")) for k in ("WARC-Record-ID", "WARC-Refers-To"))
        return int(own[1]), int(http["Content-Length"]), head["WARC-Payload-Digest"][5:], head["WARC-Type"], int(to[1]) if to else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = RangeReader(path)
        for batch in batches:
            for run in runs_of(list(zip(*(batch.column(k).to_pylist() for k in ("file", "offset", "length")), strict=True))):
                first = run[0][1]
                raw = ranges.fetch(run[0][0], first, run[-1][1] + run[-1][2] - first)
                ids, sizes, digests, kinds, refers = zip(*(described(raw[at - first : at - first + n]) for _, at, n in run), strict=True)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(kinds), pa.array(refers, pa.int64())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        ranges.close()

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = captures.select("page_id", "file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return map_in_arrow(placed, read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
