"""Versioned Parquet snapshots behind a manifest that is switched atomically."""

from __future__ import annotations

import json
import posixpath
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.errors import ConstraintError
from wordloom.operators.mutate import check_constraints
from wordloom.schemas import NULLABLE, TABLES, UNIQUE


class Store:
    """Tables of a folder.  A write makes new files, checks them, and then moves the manifest over the old one.

    The manifest names the folders of each table's rows and its next id, which never goes back, so ids of deleted rows
    are not given again.  Moving the manifest is atomic; a writer that finds another manifest than it began with gives up,
    but two writers that look at the same moment are for the caller to keep apart.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs, self.path = pa.fs.FileSystem.from_uri(self.root)

    def manifest(self) -> dict[str, dict]:
        at = posixpath.join(self.path, "manifest.json")
        if self.fs.get_file_info(at).type == pa.fs.FileType.NotFound:
            return {}
        with self.fs.open_input_file(at) as f:
            return json.loads(f.read())

    def read(self, table: str) -> DataFrame:
        entry, schema = self.manifest().get(table), TABLES[table]
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{d}" for d in entry["dirs"])) if entry else self.spark.createDataFrame([], schema)

    def next_id(self, table: str) -> int:
        return self.manifest().get(table, {}).get("next_id", 1)

    def create(self) -> None:
        """Empty tables, where there are none yet."""
        if missing := [t for t in TABLES if t not in self.manifest()]:
            self.write({t: self.spark.createDataFrame([], TABLES[t]) for t in missing})

    def _put(self, table: str, df: DataFrame) -> tuple[str, DataFrame]:
        folder = f"{table}-{uuid.uuid4().hex}"
        df.select(TABLES[table].fieldNames()).write.parquet(f"{self.root}/{folder}")
        return folder, self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{folder}")

    def _switch(self, before: dict, after: dict) -> None:
        if self.manifest() != before:
            raise ConstraintError("the store was changed meanwhile")
        draft = posixpath.join(self.path, f".manifest-{uuid.uuid4().hex}")
        self.fs.create_dir(self.path, recursive=True)
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(after).encode())
        self.fs.move(draft, posixpath.join(self.path, "manifest.json"))

    def write(self, tables: dict[str, DataFrame]) -> None:
        """Replace tables in one step; nothing changes if a check fails."""
        before = self.manifest()
        after = dict(before)
        for name, df in tables.items():
            folder, new = self._put(name, df)
            check_constraints(new, UNIQUE[name], name == "words")
            top = new.agg(F.max("id")).first()[0] or 0
            after[name] = {"dirs": [folder], "next_id": max(top + 1, before.get(name, {}).get("next_id", 1))}
        self._switch(before, after)

    def append(self, table: str, df: DataFrame) -> int:
        """Add rows to a table's files; how many.  Their keys must be new among themselves and in the table."""
        before = self.manifest()
        old = self.read(table)
        folder, new = self._put(table, df)
        check_constraints(new, UNIQUE[table], table == "words")
        for key in UNIQUE[table]:
            if not old.join(new.select(*key), list(key), "left_semi").isEmpty():
                raise ConstraintError(f"duplicate key {key}")
        n, top = new.agg(F.count("*"), F.max("id")).first()
        entry = before.get(table, {"dirs": [], "next_id": 1})
        self._switch(before, before | {table: {"dirs": [*entry["dirs"], folder], "next_id": max((top or 0) + 1, entry["next_id"])}})
        return n


def ddl(tables: dict = TABLES) -> str:
    """The tables as CREATE TABLE statements, their keys as comments."""
    out = []
    for name, schema in sorted(tables.items()):
        columns = ",\n".join(f"  {f.name} {f.dataType.simpleString()}" + ("" if f.name in NULLABLE.get(name, ()) else " NOT NULL") for f in schema)
        keys = "; ".join(", ".join(k) for k in UNIQUE.get(name, ()))
        out.append(f"CREATE TABLE {name} (\n{columns}\n) USING parquet COMMENT 'unique: {keys}';")
    return "\n".join(out) + "\n"
