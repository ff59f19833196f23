"""Command line: db-init, export and import over a store's folder."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from wordloom.errors import BackupError
from wordloom.operators.lexicon import build_words, load_source
from wordloom.operators.mutate import upsert, with_ids
from wordloom.sources import backup
from wordloom.sources.store import Store, ddl


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wordloom", description=__doc__)
    p.add_argument("--store", default="file:///tmp/wordloom-store", help="folder of the tables, as a URI")
    sub = p.add_subparsers(dest="command", required=True)
    init = sub.add_parser("db-init", help="make the tables and fill words from a dictionary")
    init.add_argument("--source", help="dictionary: a SQLite, CSV, JSON or Parquet path, or a database URL")
    init.add_argument("--table", default="stardict", help="the dictionary's table in a database")
    init.add_argument("--schema-only", action="store_true", help="make empty tables and print them")
    for name in ("export", "import"):
        q = sub.add_parser(name)
        q.add_argument("--output" if name == "export" else "--input", "-o" if name == "export" else "-i", dest="path", default="", help="file or folder; - for standard output or input")
        q.add_argument("--gzip", action="store_true")
        q.add_argument("--tables", default="", help="names with commas between; none means all")
    sub.choices["export"].add_argument("--folder", action="store_true", help="write a folder of part files instead of one stream")
    return p


def db_init(spark: SparkSession, store: Store, args: argparse.Namespace) -> int:
    store.create()
    if args.schema_only:
        print(ddl(), end="")
        return 0
    if not args.source:
        raise SystemExit("db-init needs --source or --schema-only")
    return load_words(spark, store, args.source, args.table)


def load_words(spark: SparkSession, store: Store, source: str, table: str = "stardict") -> int:
    """Upsert a dictionary's words by (language, text, word_type): known rows keep their id and time of creation."""
    from pyspark.sql import functions as F

    from wordloom.schemas import WORDS

    new, old = build_words(load_source(spark, source, table)), store.read("words")
    keys = ["text", "language", "word_type"]
    now = F.current_timestamp()
    stamped = new.select(*((F.col(f.name) if f.name in new.columns else F.array() if f.dataType.typeName() == "array" else now if f.name in ("created_at", "updated_at") else F.lit(None)).cast(f.dataType).alias(f.name) for f in WORDS if f.name != "id"))
    known = old.select("id", *keys)
    fresh = with_ids(stamped.join(known, keys, "left_anti"), store.next_id("words"), keys).select(*WORDS.fieldNames())
    again = stamped.join(known, keys).select(*WORDS.fieldNames())
    both = upsert(old, again.unionByName(fresh), ["id"], "update")
    store.write({"words": both})
    return new.count()


def run(spark: SparkSession, argv: list[str]) -> int:
    """How many rows a command wrote."""
    args = parser().parse_args(argv)
    store = Store(spark, args.store)
    if args.command == "db-init":
        return db_init(spark, store, args)
    names = backup.select_tables([x for x in args.tables.split(",") if x.strip()])
    if args.command == "export":
        tables = {n: store.read(n) for n in names}
        if args.folder:
            return sum(backup.export(tables, args.path, args.gzip, backup.Printed()).values())
        backup.export_stream(tables, args.path, args.gzip, backup.Printed())
        return sum(df.count() for df in tables.values())
    if not args.path:
        raise BackupError("import needs --input")
    with backup.received(spark, args.path, args.gzip) as path:
        store.write(backup.import_tables(spark, path, {n: store.read(n) for n in names}, names, progress=backup.Printed()))
    return sum(store.read(n).count() for n in names)


def main() -> None:
    spark = SparkSession.builder.appName("wordloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run(spark, sys.argv[1:])
