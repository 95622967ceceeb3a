"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that Python handles at once, so that a worker holds a small part of an Arrow batch as objects.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy() -> None:
    """Hands back what a task no longer holds, as its worker stays for other tasks: Arrow's pool, and freed memory of the C library where it can."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Rows of an Arrow batch where whole texts go to Python and memory is short.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on texts of this session go to Python BATCH_ROWS at a time, unless less is set; else a whole partition of texts is in the executor, on its way, and in Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def map_slices(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict[str, list]], columns: list[tuple[str, pa.DataType]], rows: int = SLICE_ROWS) -> DataFrame:
    """fn over slices of Arrow batches; it returns the columns of its output by name."""
    names = [c for c, _ in columns]
    arrow = pa.schema(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([pa.array(out[c], type=t) if not isinstance(out[c], pa.Array) else out[c] for c, t in columns], schema=arrow)
        tidy()

    assert [x.split()[0] for x in schema.split(",")] == names
    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, a null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    """Texts, a null as empty."""
    return [x or "" for x in column.to_pylist()]
