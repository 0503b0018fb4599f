"""Filter interaction audit by wide packed counters.

Every document fails some of five filters: a mask. In each of the 120 orders of the filters the mask says what becomes of
the document at each of the five steps, so a mask stands for 600 outcomes. These are the fields of one big integer
(a field for each outcome, order and step), made once for each mask and label pair. The integers of a part's documents
are added up: one sum per task, then in two levels, so no part meets in one task whatever its size. A field is as wide
as the number of all rows needs, hence a sum never carries into the next field, and unpacking gives the counts.

Defined cases: a null text is empty; a null source is the part ''; rows with a null id never repeat another text and
never are the one repeated; rows that repeat an id and a text don't repeat each other; of several labels of one id the
largest counts; null labels count as no; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_texts, stored

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
OUTCOMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
FEW_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 2
SYMBOLS = "#$%&*|"
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)  # bits above the mask
KINDS = 4 << len(FILTERS)
PARTS_HELD = 500  # sums that a task holds before it passes them on
FAN_IN = 64  # tasks of one group in the first level of sums
FIELDS = len(ORDERS) * len(FILTERS) * len(OUTCOMES)


def text_mask(text: str) -> int:
    """Bits of the filters A to D that the text fails."""
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII white space only
    b = np.frombuffer(raw, np.uint8)
    upper = int(((b >= 65) & (b <= 90)).sum())
    failed = [len(words) < FEW_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * len(words), 100 * upper > UPPER_PERCENT * len(text), any(c in text for c in SYMBOLS)]
    return sum(1 << i for i, f in enumerate(failed) if f)


def marks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key (the id), part, mask of A to D and digest of the text, for every row."""

    def make(texts: list[str]) -> tuple[None, list]:
        return None, [np.array([text_mask(t) for t in texts], np.int32), [hashlib.sha256(t.encode()).digest() for t in texts]]

    return map_texts(docs, F.col(id_col), F.col(text), make, "mask int, digest binary", [F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part")])


def with_repeats(rows: DataFrame) -> DataFrame:
    """Filter E: the bit of rows whose text a smaller id has. Only texts that occur twice take part in the join."""
    first = rows.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    fails = F.coalesce(F.col("key") > F.col("first"), F.lit(False))
    return rows.join(first, "digest", "left").withColumn("mask", F.col("mask") + F.when(fails, 1 << FILTERS.index("E")).otherwise(0)).drop("first", "digest")


def with_labels(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The bits GOOD and TOXIC of rows whose label says so."""
    own = labels.groupBy(F.col(id_col).alias("key")).agg(F.max("quality").alias("_good"), F.max("toxic").alias("_toxic"))
    bit = lambda c, b: F.when(F.coalesce(F.col(c) == 1, F.lit(False)), b).otherwise(0)
    return rows.join(own, "key", "left").select("part", (F.col("mask") + bit("_good", GOOD) + bit("_toxic", TOXIC)).alias("kind"))


def outcomes(kind: int) -> Iterator[bool]:
    """All fields of a kind: per order and step, in the order of OUTCOMES."""
    mask = kind % GOOD
    for order in ORDERS:
        before = False
        for f in order:
            fails = bool(mask >> FILTERS.index(f) & 1)
            gone = fails and not before
            yield not (fails or before)
            yield gone
            yield fails and before
            yield mask == 1 << FILTERS.index(f)
            yield gone and bool(kind & GOOD)
            yield gone and bool(kind & TOXIC)
            before = before or fails


def packed(kind: int, width: int) -> int:
    """The big integer of a kind: one in the field of each outcome that holds."""
    return sum(1 << width * i for i, held in enumerate(outcomes(kind)) if held)


def unpacked(total: int, width: int) -> np.ndarray:
    """The counts in the fields of a sum, as (order and step, outcome)."""
    ones = (1 << width) - 1
    raw = total.to_bytes((FIELDS * width + 7) // 8, "little")
    size = 8 * width  # eight fields fill ``width`` whole bytes
    out = np.zeros(-(-FIELDS // 8) * 8, np.int64)
    for i in range(0, FIELDS, 8):
        eight = int.from_bytes(raw[i // 8 * width : i // 8 * width + size // 8], "little")
        out[i : i + 8] = [eight >> width * k & ones for k in range(8)]
    return out[:FIELDS].reshape(-1, len(OUTCOMES))


def field_width(rows: int) -> int:
    """Bits that hold the number of all rows, the largest count there can be."""
    return max(1, int(rows).bit_length())


def _bytes(total: int, width: int) -> bytes:
    return total.to_bytes((FIELDS * width + 7) // 8, "little")


def task_sums(kinds: DataFrame, width: int) -> DataFrame:
    """part, lane, total: for each task the sum of the integers of its rows of a part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lane, table, sums = TaskContext.get().partitionId() // FAN_IN, {}, {}
        held = lambda: pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([lane] * len(sums), pa.int64()), pa.array([_bytes(t, width) for t in sums.values()], pa.binary())], ["part", "lane", "total"])
        for batch in batches:
            counts = pa.Table.from_batches([batch]).group_by(["part", "kind"]).aggregate([([], "count_all")])
            for part, kind, n in zip(*(counts[c].to_pylist() for c in ("part", "kind", "count_all"))):
                if kind not in table:
                    table[kind] = packed(kind, width)
                sums[part] = sums.get(part, 0) + n * table[kind]
                if len(sums) >= PARTS_HELD:
                    yield held()
                    sums.clear()
        if sums:
            yield held()

    return kinds.mapInArrow(run, "part string, lane long, total binary")


def added(sums: DataFrame, width: int, by: list[str]) -> DataFrame:
    """The sums of each group of ``by`` added up."""

    def run(rows: pa.Table) -> pa.Table:
        total = sum(int.from_bytes(x.as_py(), "little") for x in rows["total"])
        return rows.slice(0, 1).select(by).append_column("total", pa.array([_bytes(total, width)], pa.binary()))

    return sums.groupBy(*by).applyInArrow(run, ", ".join([f"{c} {sums.schema[c].dataType.simpleString()}" for c in by] + ["total binary"]))


def report(sums: DataFrame, width: int) -> DataFrame:
    """One row per part, order and step, with the counts of all outcomes and the filter's total over the orders."""
    letters = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    names, steps = [o for o in ORDERS for _ in FILTERS], np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(batch["part"].to_pylist(), batch["total"].to_pylist()):
                counts = unpacked(int.from_bytes(raw, "little"), width)
                shapley = np.bincount(letters, weights=counts[:, 1], minlength=len(FILTERS)) if counts[:, 1].sum() < 2**53 else np.array([sum(map(int, counts[letters == k, 1])) for k in range(len(FILTERS))])
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(names)), pa.array(names), pa.array(steps), *[pa.array(c) for c in counts.T], pa.array(shapley.astype(np.int64)[letters])], ["part", "filter_order", "step", *OUTCOMES, "shapley"])

    return sums.mapInArrow(run, ", ".join(["part string, filter_order string, step int", *[f"{c} long" for c in OUTCOMES], "shapley long"]))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per part, filter order and step: what was kept and removed, and what the step costs."""
    rows = stored(marks(docs, id_col, text, source), "filter-marks")
    width = field_width(rows.count())
    sums = task_sums(with_labels(with_repeats(rows), labels, id_col), width)
    return report(added(added(sums, width, ["part", "lane"]), width, ["part"]), width)
