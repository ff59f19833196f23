"""NDJSON backups: a meta record, then a record a row."""

from __future__ import annotations

import contextlib
import gzip as gz
import hashlib
import json
import shutil
import sys
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import IO, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from wordloom.errors import BackupError
from wordloom.operators.mutate import last_by_key
from wordloom.schemas import NULLABLE, TABLES, UNIQUE
from wordloom.scratch import fresh_path

VERSION = 1
WHOLE, TIME = r"^[+-]?\d+$", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"
NUMBERS, REALS = ("byte", "short", "integer", "long"), ("float", "double")


class Progress(Protocol):
    """What is told of each table's rows."""

    def start(self, table: str, total: int) -> None: ...
    def increment(self, table: str, rows: int) -> None: ...
    def finish(self, table: str) -> None: ...


class Silent:
    """Progress that nobody looks at."""

    def start(self, table: str, total: int) -> None:
        """Nothing."""

    def increment(self, table: str, rows: int) -> None:
        """Nothing."""

    def finish(self, table: str) -> None:
        """Nothing."""


class Printed:
    """A line every twentieth of a table, at least every thousand rows."""

    def __init__(self, out: IO[str] = sys.stderr):
        self.out, self.total, self.done, self.shown = out, 0, 0, 0

    def start(self, table: str, total: int) -> None:
        self.total, self.done, self.shown = total, 0, 0
        print(f"{table}: 0/{total}", file=self.out)

    def increment(self, table: str, rows: int) -> None:
        self.done += rows
        if self.done - self.shown >= min(max(self.total // 20, 1), 1000):
            self.shown = self.done
            print(f"{table}: {self.done}/{self.total}", file=self.out)

    def finish(self, table: str) -> None:
        print(f"{table}: {self.done} done", file=self.out)


def select_tables(names: list[str] | None, known=TABLES) -> list[str]:
    """Trimmed, lower-cased, checked and sorted; none means all."""
    wanted = sorted({n.strip().lower() for n in names or () if n.strip()})
    for n in wanted:
        if n not in known:
            raise BackupError(f"unknown table {n!r}")
    return wanted or sorted(known)


def fingerprint(tables: dict[str, StructType] = TABLES) -> str:
    """SHA-256 of tables, columns and keys in sorted order."""
    lines = [f"{t}|{f.name}|{f.dataType.simpleString()}" for t in sorted(tables) for f in sorted(tables[t], key=lambda f: f.name)]
    lines += [f"{t}|key|{','.join(k)}" for t in sorted(tables) for k in UNIQUE.get(t, ())]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def default_name(now: datetime, gzip: bool = False) -> str:
    return f"wordloom-backup-{now.astimezone(UTC):%Y%m%dT%H%M%SZ}.jsonl" + (".gz" if gzip else "")


def is_gzip(path: str, gzip: bool = False) -> bool:
    return gzip or path.lower().endswith(".gz")


def rfc3339(c: Column, kind: DataType) -> Column:
    """A time in UTC, whatever the session's zone, with the fraction that it has; times without a zone count as UTC."""
    if isinstance(kind, TimestampNTZType):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    else:
        micros = F.unix_micros(c)
        part = F.pmod(micros, F.lit(1_000_000))
        seconds = ((micros - part) / 1_000_000).cast("long")
        clock = F.pmod(seconds, F.lit(86_400))
        day = F.date_format(F.date_from_unix_date(((seconds - clock) / 86_400).cast("int")), "yyyy-MM-dd")
        digits = [F.format_string("%02d", x.cast("int")) for x in (F.floor(clock / 3600), F.floor(clock / 60) % 60, clock % 60)]
        text = F.when(c.isNotNull(), F.concat(day, F.lit("T"), F.concat_ws(":", *digits), F.lit("."), F.format_string("%06d", part)))
    return F.concat(F.regexp_replace(text, r"\.?0*$", ""), F.lit("Z"))


def plain(c: Column, kind: DataType) -> Column:
    """A value as JSON has it: times as text, bytes in base64, at any depth."""
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return rfc3339(c, kind)
    if isinstance(kind, BinaryType):
        return F.base64(c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: plain(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*(plain(c[f.name], f.dataType).alias(f.name) for f in kind)))
    return c


def record(table: str, df: DataFrame, columns: list[str] | None = None) -> Column:
    """The record of a row as text; nulls are written."""
    payload = F.struct(*(plain(F.col(c), df.schema[c].dataType).alias(c) for c in columns or df.columns))
    return F.to_json(F.struct(F.lit(table).alias("type"), payload.alias("payload")), {"ignoreNullFields": "false"})


def meta_record(tables: dict[str, DataFrame], counts: dict[str, int]) -> str:
    return json.dumps({"type": "meta", "version": VERSION, "exported_at": datetime.now(UTC).isoformat().replace("+00:00", "Z"), "schema_hash": fingerprint({n: tables[n].schema for n in tables}), "tables": sorted(tables), "row_counts": counts})


def ordered_records(name: str, df: DataFrame) -> DataFrame:
    """The table's records in the order of its key, over partitions and within them."""
    key = UNIQUE.get(name, [(df.columns[0],)])[0]
    return df.repartitionByRange(*key).sortWithinPartitions(*key).select(record(name, df).alias("value"))


def export(tables: dict[str, DataFrame], path: str, gzip: bool = False, progress: Progress | None = None) -> dict[str, int]:
    """Write ``path``/<nn>-<table> folders of text, ids ascending over their parts, with the meta record first; returns row counts."""
    spark, progress = next(iter(tables.values())).sparkSession, progress or Silent()
    counts = {n: df.count() for n, df in sorted(tables.items())}
    options = {"compression": "gzip"} if is_gzip(path, gzip) else {}
    spark.createDataFrame([(meta_record(tables, counts),)], "value string").write.options(**options).text(f"{path}/00-meta")
    for i, (name, df) in enumerate(sorted(tables.items()), 1):
        progress.start(name, counts[name])
        ordered_records(name, df).write.options(**options).text(f"{path}/{i:02d}-{name}")
        progress.increment(name, counts[name])
        progress.finish(name)
    return counts


def export_stream(tables: dict[str, DataFrame], target: str = "", gzip: bool = False, progress: Progress | None = None) -> str:
    """Write one ordered stream to a file, to ``-`` (standard output) or to a file of the default name; returns the name.

    Rows pass through the driver one partition at a time.
    """
    progress, target = progress or Silent(), target or default_name(datetime.now(UTC), gzip)
    counts = {n: df.count() for n, df in sorted(tables.items())}
    with contextlib.ExitStack() as held:
        raw = sys.stdout.buffer if target == "-" else held.enter_context(open(target, "wb"))
        out = held.enter_context(gz.GzipFile(fileobj=raw, mode="wb", mtime=0)) if is_gzip(target, gzip) else raw
        out.write(meta_record(tables, counts).encode() + b"\n")
        for name, df in sorted(tables.items()):
            progress.start(name, counts[name])
            for row in ordered_records(name, df).toLocalIterator():
                out.write(row.value.encode() + b"\n")
                progress.increment(name, 1)
            progress.finish(name)
    return target


@contextlib.contextmanager
def received(spark: SparkSession, path: str, gzip: bool = False) -> Iterator[str]:
    """The path itself, or a file of the shared folder that holds what ``-`` (standard input) brings."""
    if path != "-":
        yield path
        return
    import pyarrow.fs

    at = fresh_path(spark, "import") + (".jsonl.gz" if gzip else ".jsonl")
    store, name = pyarrow.fs.FileSystem.from_uri(at)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(name, compression=None) as out:
        shutil.copyfileobj(sys.stdin.buffer, out)
    try:
        yield at
    finally:
        store.delete_file(name)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(type, payload, value, __at)``; ``__at`` orders lines by file and place, however the files are read."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("__at"))
    lines = lines.where(F.trim("value") != "")
    return lines.select(F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.payload").alias("payload"), "value", "__at")


def parsed(raw: Column, kind: DataType) -> Column:
    """A value from a JSON value's text; null where it can't be one.  Numbers may stand as strings."""
    name = kind.typeName()
    if name in NUMBERS:
        return F.when(raw.rlike(WHOLE), raw.try_cast(kind))
    if name in REALS:
        return raw.try_cast(kind)
    if name == "boolean":
        low = F.lower(raw)
        return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False).when(raw.rlike(WHOLE), raw.try_cast("bigint") != 0)
    if name in ("timestamp", "timestamp_ntz"):
        time = F.when(raw.rlike(TIME), raw.try_cast("timestamp"))
        return time if name == "timestamp" else F.convert_timezone(F.current_timezone(), F.lit("UTC"), time.cast("timestamp_ntz"))
    if name == "binary":
        return F.try_to_binary(raw, F.lit("base64"))
    return F.from_json(raw, kind) if isinstance(kind, (ArrayType, StructType)) else raw


def import_tables(spark: SparkSession, path: str, targets: dict[str, DataFrame], names: list[str] | None = None, strict_hash: bool = False, progress: Progress | None = None) -> dict[str, DataFrame]:
    """Upsert a backup's rows into the targets by primary key; the caller writes them in one step.

    Of several records of a key the last line counts.  A column that a record doesn't have keeps the target's value, or
    gets its type's default in a new row.  Records of other tables are skipped; a line that isn't JSON, an unknown
    column, a value that its column can't hold and a missing time are errors.
    """
    records, progress = read_records(spark, path), progress or Silent()
    wanted = select_tables(names, targets)
    # one pass over the lines finds the first fault, the last meta record and the tables' numbers of rows
    fault = F.when(F.try_parse_json("value").isNull(), F.concat(F.lit("decode record: not JSON: "), F.substring("value", 1, 80)))
    for name in wanted:
        fault = fault.when(F.col("type") == name, faults(name, targets[name].schema, F.col("payload")))
    place = lambda c, cond: F.when(cond, F.struct("__at", c.alias("x")))
    seen = records.withColumn("__fault", fault).agg(
        F.min(place(F.col("__fault"), F.col("__fault").isNotNull())).alias("fault"),
        F.max(place(F.col("value"), F.col("type") == "meta")).alias("meta"),
        *(F.count(F.when(F.col("type") == n, 1)).alias(f"n_{n}") for n in wanted),
    ).first()
    if seen.fault:
        raise BackupError(seen.fault.x)
    if not seen.meta:
        raise BackupError("missing meta record")
    meta = json.loads(seen.meta.x)
    if meta.get("version") != VERSION:
        raise BackupError(f"unsupported format version {meta.get('version')}")
    if strict_hash and meta.get("schema_hash") != fingerprint({n: targets[n].schema for n in meta["tables"]}):
        raise BackupError("the backup's schema differs")
    out = {}
    for name in wanted:
        progress.start(name, seen[f"n_{name}"])
        target = targets[name]
        texts = texts_of(F.col("r"), target.schema)
        raw = records.where(F.col("type") == name).select(F.from_json("payload", text_schema(target.schema)).alias("r"), F.json_object_keys("payload").alias("__has"), "__at")
        filled = raw.select(*(default(parsed(texts[f.name], f.dataType), f, name).alias(f.name) for f in target.schema), "__has", "__at")
        key = list(UNIQUE.get(name, [(target.columns[0],)])[0])
        out[name] = merged(target, last_by_key(filled, key, "__at").drop("__at"), key)
        progress.increment(name, seen[f"n_{name}"])
        progress.finish(name)
    return out


def text_schema(schema: StructType) -> StructType:
    return StructType([StructField(f.name, StringType()) for f in schema])


def texts_of(r: Column, schema: StructType) -> dict[str, Column]:
    """The text of each column's value in a parsed payload; an empty time is an absent one."""
    return {f.name: F.when(r[f.name] != "", r[f.name]) if f.dataType.typeName().startswith("timestamp") else r[f.name] for f in schema}


def faults(name: str, schema: StructType, payload: Column) -> Column:
    """What is wrong with a record of a table, null if nothing is."""
    texts = texts_of(F.from_json(payload, text_schema(schema)), schema)
    unknown = F.get(F.array_except(F.json_object_keys(payload), F.lit(schema.fieldNames())), 0)
    lost = [F.when(texts[f.name].isNotNull() & parsed(texts[f.name], f.dataType).isNull(), F.concat(F.lit(f"convert {name}.{f.name}: invalid value "), texts[f.name])) for f in schema]
    needed = [f.name for f in schema if f.dataType.typeName().startswith("timestamp") and f.name not in NULLABLE.get(name, ())]
    absent = [F.when(texts[c].isNull(), F.lit(f"missing required value for {name}.{c}")) for c in needed]
    return F.coalesce(F.when(payload.isNull(), F.lit(f"missing payload for table {name}")), F.concat(F.lit("column "), unknown, F.lit(f" not found in table {name}")), *lost, *absent)


def merged(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both; where both have a key, the source's columns that its record had."""
    rest = [c for c in target.columns if c not in key]
    t = target.select(*key, F.struct(*rest).alias("__t"))
    s = source.select(*key, F.struct(*rest).alias("__s"), "__has")
    old, new, both = F.col("__t"), F.col("__s"), t.join(s, key, "full_outer")
    pick = lambda c: F.when(new.isNotNull() & (old.isNull() | F.array_contains("__has", c)), new[c]).otherwise(old[c])
    return both.select(*key, *(pick(c).alias(c) for c in rest)).select(*target.columns)


def default(c: Column, field, table: str) -> Column:
    """A null of a column that takes none becomes the type's default; times have none."""
    kind = field.dataType.typeName()
    if field.name in NULLABLE.get(table, ()) or kind.startswith("timestamp"):
        return c
    value = F.array() if kind == "array" else F.lit("") if kind == "string" else F.lit(False) if kind == "boolean" else F.lit(None) if kind in ("struct", "binary") else F.lit(0)
    return F.coalesce(c, value.cast(field.dataType))
