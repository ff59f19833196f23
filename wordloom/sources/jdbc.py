"""Data sources by name: files, SQLite and PostgreSQL, to read from and to write to."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Rows of a SQLite table that a task reads, and that go into it at once.
SQLITE_ROWS, SQLITE_BATCH = 100_000, 1_000
DRIVERS = {"jdbc:postgresql:": "org.postgresql.Driver"}


def resolve(dsn: str) -> tuple[str, dict[str, str]]:
    """(format, options) of a data source name: databases by their URL or key=value list, files by their suffix."""
    name = dsn.strip()
    low = name.lower()
    if low.startswith(("postgres://", "postgresql://")):
        return "jdbc", {"url": "jdbc:postgresql://" + name.split("://", 1)[1]}
    if "host=" in low and "dbname=" in low:
        kv = dict(x.split("=", 1) for x in name.split())
        return "jdbc", {"url": f"jdbc:postgresql://{kv['host']}:{kv.get('port', '5432')}/{kv['dbname']}", "user": kv.get("user", ""), "password": kv.get("password", "")}
    if low.split("?")[0].endswith((".db", ".sqlite", ".sqlite3")):
        return "sqlite", {"path": name.removeprefix("sqlite3://").removeprefix("sqlite://").removeprefix("file:").split("?")[0]}
    for suffix, kind in ((".csv", "csv"), (".json", "json"), (".jsonl", "json"), (".orc", "orc")):
        if low.endswith(suffix):
            return kind, {"path": name}
    return "parquet", {"path": name}


def read_source(spark: SparkSession, dsn: str, table: str, schema: StructType | None = None, id_range: tuple[int, int, int] | None = None) -> DataFrame:
    """A table of a database, or a file.

    ``schema``: what columns are cast to, arrays and structs from JSON text.  ``id_range`` (smallest, largest,
    partitions) deals the rows of a PostgreSQL table by id; a SQLite table is dealt by rowid.
    """
    kind, options = resolve(dsn)
    if kind == "sqlite":
        df = read_sqlite(spark, options["path"], table)
    elif kind == "jdbc":
        options |= {"dbtable": table} | {"driver": d for p, d in DRIVERS.items() if options["url"].startswith(p)}
        if id_range:
            options |= {"partitionColumn": "id", "lowerBound": str(id_range[0]), "upperBound": str(id_range[1]), "numPartitions": str(id_range[2])}
        df = spark.read.format("jdbc").options(**options).load()
    else:
        df = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {})).load(options["path"])
    return df if schema is None else df.select(*(typed(df, f).alias(f.name) for f in schema))


def typed(df: DataFrame, field):
    if field.name not in df.columns:
        return F.lit(None).cast(field.dataType)
    nested, have = isinstance(field.dataType, (ArrayType, StructType)), df.schema[field.name].dataType
    return F.from_json(F.col(field.name), field.dataType) if nested and have.typeName() == "string" else F.col(field.name).cast(field.dataType)


def write_source(df: DataFrame, dsn: str, table: str, mode: str = "append") -> None:
    """Write to a table of a database, or a file; nested columns go into databases as JSON text."""
    kind, options = resolve(dsn)
    if kind in ("sqlite", "jdbc"):
        df = df.select(*(F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (ArrayType, StructType)) else F.col(c) for c in df.columns))
    if kind == "sqlite":
        write_sqlite(df, options["path"], table, mode)
    elif kind == "jdbc":
        df.write.format("jdbc").options(**options, dbtable=table).mode(mode).save()
    else:
        df.write.format(kind).mode(mode).save(options["path"])


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def read_sqlite(spark: SparkSession, path: str, table: str, rows: int = SQLITE_ROWS) -> DataFrame:
    """A SQLite table as strings, a range of rowids a task; the file must be where executors see it."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        columns = [r[1] for r in db.execute(f"PRAGMA table_info({quoted(table)})")]
        if not columns:
            raise ValueError(f"no table {table!r} in {path}")
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(table)}").fetchone()
    ranges = [(a, min(a + rows, high + 1)) for a in range(low, high + 1, rows)] if low is not None else []
    wanted = ", ".join(f"CAST({quoted(c)} AS TEXT)" for c in columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for batch in batches:
                for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = db.execute(f"SELECT {wanted} FROM {quoted(table)} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (a, b))
                    while some := found.fetchmany(SQLITE_BATCH):
                        yield pa.record_batch([pa.array(x, pa.string()) for x in zip(*some, strict=True)], columns)

    dealt = spark.createDataFrame(ranges, "a long, b long").repartitionByRange(max(1, len(ranges)), "a")
    return dealt.mapInArrow(read, ", ".join(f"`{c}` string" for c in columns))


def write_sqlite(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """One connection writes all, for the file takes no more; rows come partition by partition."""
    with sqlite3.connect(path) as db:
        if mode == "overwrite":
            db.execute(f"DROP TABLE IF EXISTS {quoted(table)}")
        text, kinds = "TEXT", {"long": "INTEGER", "integer": "INTEGER", "short": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL"}
        db.execute(f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({', '.join(f'{quoted(f.name)} {kinds.get(f.dataType.typeName(), text)}' for f in df.schema)})")
        insert, held = f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * len(df.columns))})", []
        plain = df.select(*(F.col(f.name).cast("string") if f.dataType.typeName() not in kinds else F.col(f.name) for f in df.schema))
        for row in plain.toLocalIterator():
            held.append(tuple(row))
            if len(held) == SQLITE_BATCH:
                db.executemany(insert, held)
                held = []
        db.executemany(insert, held)
