"""Hilbert-curve sharding: quantise metadata dimensions, order rows along the curve, cut equal runs.

Numbers are quantised at their approximate quantiles, strings by the rank of their whole values: the rows below
a value, counted over ordered ranges of distinct values, give its cell. So each shard covers narrow value ranges of every dimension and files can be
skipped by their minima and maxima. Only ids, hashes and curve indices move; texts don't.

Defined cases: a null dimension value lies below all others; ties on the curve are ordered by id, then by
text hash; fully equal rows take adjacent slots in any order; an empty table gives no rows; clashing extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import broadcast_if_small, stored

BITS = 6
RUN_ROWS = 200_000


def string_cells(df: DataFrame, name: str, bits: int) -> DataFrame:
    """Every distinct value of a string column with its cell: the share of all rows below it, times the number of cells."""
    counts = stored(df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "values")
    parts = max(1, -(-counts.count() // RUN_ROWS))
    runs = stored(counts.repartitionByRange(parts, "_v").withColumn("_run", F.spark_partition_id()), "value-runs")
    shift, total = [], 0
    for r in runs.groupBy("_run").agg(F.sum("_n").alias("_s")).orderBy("_run").collect():  # one row per range
        shift.append((r["_run"], total))
        total += r["_s"]
    inside = W.partitionBy("_run").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    below = F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    ordered = runs.join(F.broadcast(df.sparkSession.createDataFrame(shift, "_run int, _start long")), "_run")
    return ordered.select("_v", F.floor(below * F.lit(2**bits) / F.lit(max(total, 1))).cast("double").alias("_cell"))


def curve_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of integer coordinates: undo the excess rotations, Gray-decode, interleave."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] = np.where(high, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip, q = np.zeros(len(x), np.int64), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[:, n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def with_index(df: DataFrame, dims: Sequence[str], out: str = "curve", bits: int = BITS) -> DataFrame:
    """``df`` with its curve index; the quantile cuts are one small aggregate, string cells one table per dimension."""
    strings = {d for d, kind in df.dtypes if kind == "string" and d in dims}
    numbers = [d for d in dims if d not in strings]
    steps = [i / 2**bits for i in range(1, 2**bits)]
    cuts = df.agg(F.count(F.lit(1)), *[F.percentile_approx(F.col(d).cast("double"), steps, 10_000) for d in numbers]).first()[1:]
    edges = dict(zip(numbers, [np.unique(np.array(c if c is not None else [], float)) for c in cuts]))
    rows = df
    for i, d in enumerate(dims):
        if d in strings:
            cells = broadcast_if_small(stored(string_cells(df, d, bits), "cells")).withColumnRenamed("_cell", f"_d{i}")
            rows = rows.join(cells, rows[d] == cells["_v"], "left").drop("_v")
        else:
            rows = rows.withColumn(f"_d{i}", F.col(d).cast("double"))

    @F.pandas_udf("long")
    def index(values: pd.DataFrame) -> pd.Series:
        cells = []
        for d, v in zip(dims, values.astype(float).to_numpy().T):
            e = edges.get(d)
            cell = v if e is None else np.searchsorted(e, v, "right") + (len(e) == 0)
            cells.append(np.where(np.isnan(v), 0, cell).astype(np.int64))
        return pd.Series(curve_index(np.minimum(np.stack(cells, 1), 2**bits - 1), bits))

    made = [f"_d{i}" for i in range(len(dims))]
    return rows.withColumn(out, index(F.struct(*made))).drop(*made)


def ranked(df: DataFrame, order: Sequence[str], rows: int | None = None) -> DataFrame:
    """``df`` with ``rank`` (gapless from 0 in the given order): ranges of bounded size are numbered on their own and shifted by the counts before them."""
    n = df.count() if rows is None else rows
    parts = max(1, -(-n // RUN_ROWS))
    runs = stored(df.repartitionByRange(parts, *order).withColumn("_run", F.spark_partition_id()), "runs")
    sizes = runs.groupBy("_run").agg(F.count(F.lit(1)).alias("_n")).orderBy("_run").collect()  # one row per range
    starts, total = [], 0
    for r in sizes:
        starts.append((r[0], total))
        total += r[1]
    shift = df.sparkSession.createDataFrame(starts, "_run int, _start long")
    own = F.row_number().over(W.partitionBy("_run").orderBy(*order)) - 1
    return runs.withColumn("_own", own).join(broadcast_if_small(shift), "_run").withColumn("rank", (F.col("_own") + F.col("_start")).cast("long")).drop("_own", "_start", "_run")


def cut(df: DataFrame, n: int, shards: int) -> DataFrame:
    """shard and slot of each ``rank`` below ``n``: counts differ by one at most."""
    small, more = n // shards, n % shards
    border = more * (small + 1)
    first = F.col("rank") < border
    low = F.floor(F.col("rank") / (small + 1))
    high = more + F.floor((F.col("rank") - border) / max(small, 1))
    shard = F.when(first, low).otherwise(high).cast("int")
    start = F.when(F.col("shard") < more, F.col("shard") * (small + 1)).otherwise(border + (F.col("shard") - more) * small)
    return df.withColumn("shard", shard).withColumn("slot", (F.col("rank") - start).cast("long"))


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text", dims: Sequence[str] = ("source", "lang", "n_chars")) -> DataFrame:
    """One row per document: size, CRC of its text, shard and slot, by equal counts along the curve."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    flat = docs.select(F.col(id_col), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), *[d for d in dims if d != id_col])
    flat = stored(with_index(flat, dims).select(id_col, "size", "text_crc32", "curve"), "curve")
    n = flat.count()
    placed = cut(ranked(flat, ["curve", id_col, "text_crc32", "size"], n), n, shards)
    return placed.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text: str = "text", dims: Sequence[str] = ("source", "lang", "n_chars")) -> None:
    """Write whole rows as one folder per shard, each in curve order; ids must be unique, columns shard and slot are replaced."""
    places = assign(docs, shards, id_col, text, dims).select(id_col, "shard", "slot")
    files = max(1, -(-docs.count() // RUN_ROWS))
    rows = docs.drop("shard", "slot").join(places, id_col).repartitionByRange(max(shards, files), "shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)
