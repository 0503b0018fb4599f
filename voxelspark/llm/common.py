"""Helpers that the operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxelspark.session import checkpoint_dir

PART_BYTES = 4_000_000
BROADCAST_ROWS = 100_000  # counted before a hint is given; larger sides are shuffled


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later readers start from files that outlive executors, with column pruning and statistics.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; ``df`` should be stored."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_key(text: Column) -> list[Column]:
    """Two hashes (96 bits) that stand for a text in joins; equal texts have equal keys, also null."""
    return [F.xxhash64(text).alias("_t1"), F.hash(text).alias("_t2")]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that no column of ``df`` is called so."""
    while name in df.columns:
        name = f"_{name}"
    return name


def parts_of(batch: pa.RecordBatch, column: str = "text", size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``size`` bytes of text each, so that a task's memory follows them, not the batch."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else []
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def map_texts(df: DataFrame, key: Column, text: Column, make: Callable[[list[str]], tuple[np.ndarray | None, Sequence]], schema: str, extra: Sequence[Column] = ()) -> DataFrame:
    """Rows (key, extra columns, made columns) by Arrow batches; ids of any type pass untouched, also null.

    ``make`` gets the texts of a batch (null as '') and returns the input row of each output row (None: one
    each) and the made columns. ``schema`` names the made columns.
    """
    flat = df.select(key.alias("key"), *extra, text.cast("string").alias("text"))
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in flat.schema.fields[:-1]]
    names = [*flat.columns[:-1], *[x.split()[0] for x in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts_of(whole)):
            rows, made = make([t or "" for t in batch.column("text").to_pylist()])
            held = batch.columns[:-1] if rows is None else [c.take(pa.array(rows)) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*held, *[pa.array(m) for m in made]], names)

    return flat.mapInArrow(run, ", ".join([*kept, schema]))
