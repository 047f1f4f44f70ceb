"""Helpers shared by the training-data operators: input tables, Arrow batches, cluster-wide tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from incidentlens.workers import ship
from incidentlens.workspace import Workspace

# A table of at most this many bytes (rows times width) may be broadcast; larger ones are shuffled.
BROADCAST_BYTES = 16 << 20
# Bits of the table that tells which keys another one may hold, for joins with tables that are too large to broadcast.
MARKS = 1 << 26
# Python stages cut their batches so that one holds at most this much text.
BATCH_CHARS = 4 << 20
# Spark hands rows to Python in batches of this many bytes at most; by default they only end after 10,000
# rows, which of long texts take hundreds of megabytes. Both sides hold a few batches for every task.
ARROW_BYTES = 2 << 20
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

BatchFunction = Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# In a Python worker: how to drop what an operator keeps from task to task, by operator.
_kept: dict[str, Callable[[], None]] = {}


def keep(owner: str, drop: Callable[[], None]) -> None:
    """Tell how to drop what ``owner`` keeps in this worker; done before a task of another one begins."""
    _kept[owner] = drop


def drop_others(owner: str | None) -> None:
    """Workers outlive stages, so caches of earlier operators would add up in them."""
    others = [name for name in _kept if name != owner]
    for name in others:
        _kept.pop(name)()
    if others:
        gc.collect()


def return_memory() -> None:
    """Freed memory goes back to the system: Arrow's, which keeps its own, and that of the C library where it can."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def map_arrow(df: DataFrame, run, schema: str, owner: str | None = None) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors; ``owner``: whose caches may stay there."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ARROW_LIMIT).rstrip("b")) <= ARROW_BYTES:
        conf.set(_ARROW_LIMIT, str(ARROW_BYTES))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(owner)
        yield from run(batches)
        return_memory()

    return df.mapInArrow(start, schema)


_scratch: list[list[Workspace]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Delete, at the end, the intermediate tables of all operators called in between."""
    _scratch.append([])
    try:
        yield
    finally:
        for ws in _scratch.pop():
            ws.close()


def workspace(df_or_spark) -> Workspace:
    """Intermediate tables in the folder that ``spark.checkpoint.dir`` names."""
    ws = Workspace(getattr(df_or_spark, "sparkSession", df_or_spark))
    if _scratch:
        _scratch[-1].append(ws)
    return ws


def pieces(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with some BATCH_CHARS of text or bytes in ``columns`` each, one row at least."""
    if not columns:
        yield batch
        return
    offsets = list(map(sum, zip(*(text_ends(batch.column(column)) for column in columns))))
    start = 0
    while start < batch.num_rows:
        end, base = start + 1, offsets[start]
        while end < batch.num_rows and offsets[end + 1] - base <= BATCH_CHARS:
            end += 1
        yield batch.slice(start, end - start)
        start = end


def text_ends(array: pa.Array) -> list[int]:
    total, out = 0, [0]
    for n in pc.fill_null(pc.binary_length(array), 0).to_pylist():
        total += n
        out.append(total)
    return out


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[dict[str, list]], dict[str, Iterable]]],
    schema: str,
    text: str | None = "text",
    owner: str | None = None,
) -> DataFrame:
    """Run a function of plain column lists over Arrow batches.

    ``make`` is called once per task, so that what it builds (tables, caches) serves all batches.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in pieces(batch, text) if text else [batch]:
                out = work(part.to_pydict())
                arrays = [pa.array(out[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return map_arrow(df, run, schema, owner)


def map_rows(
    df: DataFrame, names: list[str], work: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str
) -> DataFrame:
    """Run a generator over a partition's rows as tuples; rows stream, only some BATCH_CHARS of them are unpacked."""
    arrow = arrow_schema(schema)
    long = [name for name in names if df.schema[name].dataType.simpleString() in ("string", "binary")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row
            for batch in batches
            for part in pieces(batch, *long)
            for row in zip(*(part.column(name).to_pylist() for name in names))
        )
        out = work(rows)
        while part := list(islice(out, 1000)):
            arrays = [pa.array(column, f.type) for column, f in zip(zip(*part), arrow)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return map_arrow(df.select(*names), run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A hint to broadcast a table of counted size, or the table as it is where it is too large."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def narrow_join(df: DataFrame, ids: DataFrame, rows: int, row_bytes: int, key: str, how: str = "inner") -> DataFrame:
    """``df`` joined (inner, left_semi or left_anti) with ``ids``, a table of counted size with a column ``key``.

    ``ids`` is broadcast if it is small. Otherwise a bitmap of fixed size (MARKS bits) of the hashed keys is, and
    only rows of ``df`` that it may hold are shuffled, so that texts without a match stay where they lie.
    """
    if rows * row_bytes <= BROADCAST_BYTES:
        return df.join(F.broadcast(ids), key, how)
    slot = F.pmod(F.xxhash64(key), F.lit(MARKS))
    bucket, bit = F.shiftright(slot, 15), slot.bitwiseAND(F.lit(32767))
    marks = ids.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_marks"))
    byte = F.conv(F.hex(F.substring("_marks", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.expr("shiftright(_byte, int(_bit)) & 1") == 1, F.lit(False))
    held = df.withColumn("_bucket", bucket).join(F.broadcast(marks), "_bucket", "left")
    held = held.withColumns({"_byte": byte, "_bit": bit.bitwiseAND(F.lit(7))})
    found = held.filter(maybe).select(*df.columns).join(ids, key, how)
    return found.unionByName(held.filter(~maybe).select(*df.columns)) if how == "left_anti" else found


def release_shuffles(spark: SparkSession) -> None:
    """Let the files of earlier shuffles go, which Spark keeps until the driver has dropped what stands for them."""
    gc.collect()
    spark._jvm.System.gc()


def mixed_partitions(df: DataFrame, factor: int = 1) -> int:
    return factor * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
