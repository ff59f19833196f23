"""Helpers that the operators share: cluster folders, cut points, bounded samples, text batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.scratch import fresh_path, materialise, shared_dir  # noqa: F401

#: Most bytes of text that a Python worker takes up at once.
SLICE_BYTES = 1 << 20


def fold_of(doc_id: Column) -> Column:
    """Held-out fold: crc32 of the id written as text, modulo 5 (0 is held out; a null id is not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(1))


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows at most, the same ones on every run: rows whose key hashes under bound / count."""
    total = df.count()
    if total <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * bound / total))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of ``column`` (one row at least)."""
    start = held = 0
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def release() -> None:
    """Give freed memory back to the system: a Python worker is kept for tasks of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def map_in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose worker gives memory back before and after a task.

    The search for cycles of objects rests in between: the operators make none, and their many small objects set it off.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what tasks of an earlier stage held
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            release()

    return df.mapInArrow(tidy, schema)


def map_batches(df: DataFrame, column: str, schema, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices bounded in bytes; ``make`` runs once per task and returns the function of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for batch in batches:
            fn = fn or make()
            for piece in text_slices(batch, column, limit):
                yield fn(piece)

    return map_in_arrow(df, run, schema)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with equal values in the first ``keys`` columns, across batches; the values and the rows."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows - 1, bool)
        for c in batch.columns[:keys]:
            values = c.to_numpy(zero_copy_only=False)
            # an absent value differs from itself in floats: nulls are compared apart
            changed |= (values[1:] != values[:-1]) if not c.null_count else np.array([a != b for a, b in zip(c[1:].to_pylist(), c[:-1].to_pylist(), strict=True)], bool)
        cuts = np.flatnonzero(changed) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = tuple(c[a].as_py() for c in batch.columns[:keys])
            if held and key != last:
                yield last, held
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, held


#: Bits of an id filter: eight an id, in these bounds (128 KB to 8 MB).  Beyond them it takes more ids for known, which costs work only.
FILTER_BITS = 1 << 20, 1 << 26


class IdFilter:
    """A broadcast bitmap that knows every id of a table, and takes some others for known."""

    def __init__(self, ids: DataFrame, column: str):
        low, high = FILTER_BITS
        self.bits = min(high, max(low, 1 << (8 * ids.count()).bit_length()))
        bits = ids.select(F.explode(F.array(*self.spots(column))).alias("bit")).groupBy(F.shiftright("bit", 5).alias("word"))
        found = bits.agg(F.expr("bit_or(shiftleft(1L, cast(bit & 31 as int)))").alias("bits")).toArrow()  # bits / 32 rows at most
        table = np.zeros(self.bits // 32, np.uint32)
        table[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
        self.table = ids.sparkSession.sparkContext.broadcast(table)

    def spots(self, column: str) -> list[Column]:
        return [F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(self.bits)) for seed in (1, 2)]

    def spotted(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with the filter's places of an id behind its columns."""
        return df.select("*", *(x.alias(f"__spot{i}") for i, x in enumerate(self.spots(column))))

    @staticmethod
    def screened(batch: pa.RecordBatch, table, inside: bool = True) -> pa.RecordBatch:
        """Of a batch with places, the rows whose id the broadcast table takes for known, or those that it doesn't, without the places."""
        width = batch.num_columns - 2
        here = np.ones(batch.num_rows, bool)
        for k in (width, width + 1):
            bit = batch.column(k).to_numpy()
            here &= (table.value[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1
        return batch.select(range(width)).filter(pa.array(here == inside))

    def filtered(self, df: DataFrame, column: str, inside: bool) -> DataFrame:
        """Rows whose id the filter takes for known, or those that it doesn't; no shuffle."""
        table, screened = self.table, self.screened

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if (some := screened(batch, table, inside)).num_rows:
                    yield some

        return map_in_arrow(self.spotted(df, column), keep, df.schema)
