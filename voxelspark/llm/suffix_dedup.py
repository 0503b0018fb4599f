"""Removal of byte strings that an earlier document also holds, by external induced suffix sorting.

1. Whole documents are packed into compressed blocks in the shared folder; only references to them move.
2. Every ``length``-byte window is named by the least hash of the ``GRAM``-byte strings in it. Runs of windows with
   one name are segments; equal windows have equal names. Names that only one document holds are done with:
   blocks send their distinct names (sorted, packed) by name range, and get back one bit per name.
3. Segments of shared names are sent by name range. Equal segments of a block travel once, under their least
   document id, and the block's later ones are hits at once; so a hot name sends a block's distinct segments.
4. Each range is a shard: its distinct segments are suffix-sorted by induced sorting with disk-backed queues
   (``suffix_sort``), and windows in a run of common prefixes of ``length`` share the least document id of the run.
5. Windows whose least id is smaller than their own document's are hits; the bytes they cover are removed.

A range holds about ``RANGE_NAMES`` names however large the table is. Defined cases: a null text is empty; a null id
is larger than any other, and equal ids never count as smaller; texts below ``length`` bytes lose nothing;
repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import shared_folder, stored
from .suffix_sort import equal_windows
from .warc import file_system

LENGTH = 50
GRAM = 20
BLOCK_BYTES = 4_000_000
CHUNK_BYTES = 1_000_000  # of a block, hashed at a time
RANGE_NAMES = 300_000
NAMES_PER_BYTE = 2 / (LENGTH - GRAM + 2)
NO_ID = np.iinfo(np.int64).max
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(data: bytes, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


# ---- blocks --------------------------------------------------------------------------------


def write_blocks(docs: DataFrame, folder: str, text: str) -> DataFrame:
    """Store the rows of ``docs`` as blocks of whole rows; returns block, file, at, size and bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(folder)
        store.create_dir(path, recursive=True)
        name, rows, at = uuid.uuid4().hex, [], 0
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                column = batch.column(text)
                sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
                part = np.cumsum(sizes) // BLOCK_BYTES
                edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)] if len(sizes) else []
                for a, b in zip(edges, edges[1:]):
                    sink = io.BytesIO()
                    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                        writer.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(a, b - a)]) for c in batch.columns], schema=batch.schema))
                    data = sink.getvalue()
                    out.write(data)
                    rows.append((f"{name}-{len(rows)}", name, at, len(data), int(sizes[a:b].sum())))
                    at += len(data)
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["block", "file", "at", "size", "bytes"])

    return stored(docs.mapInArrow(run, "block string, file string, at long, size long, bytes long"), "blocks")


class Block:
    """A block read back: its table, the bytes of its texts, their starts, sizes and document ids."""

    def __init__(self, folder: str, file: str, at: int, size: int, id_col: str, text: str):
        store, path = file_system(folder)
        with store.open_input_file(f"{path}/{file}") as f:
            self.table = pa.ipc.open_stream(f.read_at(size, at)).read_all().combine_chunks()
        values = self.table.column(text).cast(pa.large_binary())
        raw = [x.as_py() or b"" for x in values]
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.ids = np.array([NO_ID if x is None else x for x in self.table.column(id_col).to_pylist()], np.int64)


# ---- names and segments --------------------------------------------------------------------


def ahead(word: np.ndarray, step: int, size: int) -> np.ndarray:
    """``word`` shifted by ``step`` and filled with zeros; a GRAM is the words at 0, 8 and GRAM - 8."""
    return np.concatenate((word[step:], np.zeros(step, np.uint64)))[:size]


def names_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, name) of the segments of ``data``; ``ends`` are the ends of its texts."""
    starts, counts, names = [], [], []
    spread = length - GRAM + 1
    for a in range(0, len(data), CHUNK_BYTES):
        b = min(a + CHUNK_BYTES, len(data))
        part = np.concatenate((data[a : b + length], np.zeros(16, np.uint8)))
        size = min(b + length, len(data)) - a
        word = np.zeros(size + 8, np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | part[k : k + size + 8]
        h = word[:size] * ODD[0] ^ ahead(word, 8, size) * ODD[1]
        h ^= h >> np.uint64(31)
        h += ahead(word, GRAM - 8, size) * ODD[2]
        h ^= h >> np.uint64(29)
        h *= ODD[3]
        h ^= h >> np.uint64(32)
        least, width = h, 1
        while width < spread:
            step = min(width, spread - width)
            least = np.concatenate((np.minimum(least[: size - step], least[step:]), least[size - step :])) if size > step else least
            width += step
        at = np.arange(a, b)
        own_end = ends[np.searchsorted(ends, at, "right")]
        valid = at + length <= own_end
        least = least[: b - a]
        new = valid.copy()
        new[1:] &= ~(valid[:-1] & (least[1:] == least[:-1]) & (own_end[1:] == own_end[:-1]))
        first = np.flatnonzero(new)
        if len(first):
            total = np.cumsum(valid)
            upto = np.append(total[first[1:] - 1], total[-1])
            starts.append(first + a)
            counts.append(upto - np.concatenate(([0], upto[:-1])))
            names.append(least[first] * ODD[0])  # a least hash is small: spread the names evenly again
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(starts, np.int64), join(counts, np.int64), join(names, np.uint64)


def range_of(names: np.ndarray, ranges: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def block_names(block: Block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments (start, windows, document, index of name) with the distinct names, sorted, and which of them two documents hold."""
    ends = block.starts + block.sizes
    start, count, name = names_of(block.data, np.unique(ends), length)
    doc = np.searchsorted(ends, start, "right")
    distinct, index = np.unique(name, return_inverse=True)
    low, high = np.full(len(distinct), len(ends)), np.full(len(distinct), -1)
    np.minimum.at(low, index, doc)
    np.maximum.at(high, index, doc)
    return start, count, doc, index, distinct, low != high


def blockwise(blocks: DataFrame, run: Callable[[pd.Series], Iterator[tuple]], schema: str, tasks: int) -> DataFrame:
    """Apply ``run`` to every row of ``blocks``; its tuples are the rows of the result."""
    names = [c.split()[0] for c in schema.split(", ")]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame(list(run(row)), columns=names)

    return blocks.repartition(tasks).mapInPandas(go, schema)


# ---- shards --------------------------------------------------------------------------------


def shared_bits(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one name range: per block one bit for each of its names, set if several documents hold it."""
    lists = [np.cumsum(unpack(r, np.uint64), dtype=np.uint64) for r in rows["names"]]
    sizes = [len(x) for x in lists]
    several = np.concatenate([np.unpackbits(unpack(m), count=n).astype(bool) for m, n in zip(rows["several"], sizes)])
    _, index, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    hit = counts > 1
    np.logical_or.at(hit, index, several)
    bits = np.split(hit[index], np.cumsum(sizes)[:-1])
    return pd.DataFrame({"block": rows["block"], "range": rows["range"], "bits": [np.packbits(b).tobytes() for b in bits]})


def shard_hits(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Of one shard: per block and segment whether none (0), all (1) or some (2) of its windows start in a smaller document."""
    number: dict[bytes, int] = {}
    least: list[int] = []
    members = []
    for r in rows.itertuples():
        docs, sizes, data = np.frombuffer(r.ids, np.int64), np.frombuffer(r.sizes, np.int32).astype(np.int64), unpack(r.data).tobytes()
        ends = np.cumsum(sizes)
        own = np.empty(len(docs), np.int64)
        for i, (a, b, d) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), docs.tolist())):
            g = number.setdefault(data[a:b], len(least))
            if g == len(least):
                least.append(d)
            elif d < least[g]:
                least[g] = d
            own[i] = g
        members.append((r.block, r.range, docs, own))
    sizes = np.array([len(x) for x in number], np.int64)
    ids, rank = np.unique(np.array(least, np.int64), return_inverse=True)  # ids by rank: small numbers for every position
    owner = np.repeat(rank.astype(np.int32), sizes + 1)
    body = np.frombuffer(b"".join(x + b"\x00" for x in number), np.uint8).astype(np.int16) + 2
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    body[starts + sizes] = 1
    found = equal_windows(np.append(body, np.int16(0)), length, np.append(owner, np.int32(len(ids))))
    # Positions too near a segment's end hold no window: leave them out of the least and largest.
    inside = np.ones(len(body), bool)
    for k in range(length):
        inside[starts + sizes - k] = False
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    windows = found[at]
    lowest, highest = ids[np.minimum.reduceat(windows, first)], ids[np.maximum.reduceat(windows, first)]
    edge = np.append(first, len(windows))
    out = []
    for block, span, docs, own in members:
        state = np.where(highest[own] < docs, 1, np.where(lowest[own] >= docs, 0, 2)).astype(np.uint8)
        some = []
        for i in np.flatnonzero(state == 2):
            hit = np.concatenate(([0], (ids[windows[edge[own[i]] : edge[own[i] + 1]]] < docs[i]).astype(np.int8), [0]))
            turns = np.flatnonzero(np.diff(hit))
            some += [(i, a, b) for a, b in zip(turns[::2], turns[1::2])]
        out.append((block, span, state.tobytes(), np.array(some, np.int32).tobytes()))
    return pd.DataFrame(out, columns=["block", "range", "state", "some"])


# ---- the job -------------------------------------------------------------------------------


def _with_hits(docs: DataFrame, id_col: str, text: str, length: int, finish: Callable[[Block, np.ndarray], pa.RecordBatch], schema) -> DataFrame:
    """Run all steps; ``finish`` turns a block and its mask of removed bytes into rows of ``schema``."""
    folder = shared_folder(docs.sparkSession, "suffixes")
    blocks = write_blocks(docs, folder, text)
    n, total = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks, ranges = max(1, -(-n // 2)), max(1, round(total * NAMES_PER_BYTE / RANGE_NAMES))

    def opened(row) -> Block:
        return Block(folder, row.file, row.at, row.size, id_col, text)

    def send_names(row) -> Iterator[tuple]:
        *_, distinct, several = block_names(opened(row), length)
        edges = np.searchsorted(range_of(distinct, ranges), np.arange(ranges + 1))
        for k in np.flatnonzero(np.diff(edges)):
            a, b = edges[k], edges[k + 1]
            steps = np.diff(distinct[a:b], prepend=np.uint64(0))
            yield row.block, int(k), pack(steps.tobytes()), pack(np.packbits(several[a:b]).tobytes())

    def send_segments(row) -> Iterator[tuple]:
        block = opened(row)
        start, count, doc, index, distinct, _ = block_names(block, length)
        shared = np.zeros(len(distinct), bool)
        spans = range_of(distinct, ranges)
        edges = np.searchsorted(spans, np.arange(ranges + 1))
        for k, bits in zip(row.ranges, row.bits):
            a, b = edges[k], edges[k + 1]
            shared[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        use = np.flatnonzero(shared[index])
        use = use[np.argsort(spans[index[use]], kind="stable")]
        span = spans[index[use]]
        raw, ids = block.data.tobytes(), block.ids[doc[use]]
        number = np.empty(len(use), np.int64)
        least = np.empty(len(use), np.int64)
        cuts = np.searchsorted(span, np.arange(ranges + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            seen: dict[bytes, int] = {}
            own: list[int] = []
            for i in range(cuts[k], cuts[k + 1]):
                s = start[use[i]]
                g = seen.setdefault(raw[s : s + count[use[i]] + length - 1], len(own))
                if g == len(own):
                    own.append(ids[i])
                elif ids[i] < own[g]:
                    own[g] = ids[i]
                number[i] = g
            least[cuts[k] : cuts[k + 1]] = np.array(own)[number[cuts[k] : cuts[k + 1]]]
            yield row.block, int(k), np.array(own, np.int64).tobytes(), np.array([len(x) for x in seen], np.int32).tobytes(), pack(b"".join(seen))
        kept = np.stack((span, number, start[use], count[use], ids > least)) if len(use) else np.zeros((5, 0), np.int64)
        yield row.block, -1, b"", b"", pack(kept.astype(np.int64).tobytes())

    def cover(row) -> tuple[Block, np.ndarray]:
        block = opened(row)
        span, number, start, count, later = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.kept), np.int64).reshape(5, -1)
        turn = np.zeros(len(block.data) + 1, np.int32)

        def add(first: np.ndarray, windows: np.ndarray) -> None:
            np.add.at(turn, first, 1)
            np.add.at(turn, first + windows + length - 1, -1)

        whole = later.astype(bool)
        cuts = np.searchsorted(span, np.arange(ranges + 1))
        for k, state, some in zip(row.ranges if row.ranges is not None else [], row.states if row.states is not None else [], row.somes if row.somes is not None else []):
            at = np.arange(cuts[k], cuts[k + 1])
            whole[at] |= np.frombuffer(state, np.uint8)[number[at]] == 1
            parts = np.frombuffer(some, np.int32).reshape(-1, 3).astype(np.int64)
            if len(parts):
                order = at[np.argsort(number[at], kind="stable")]
                low, high = np.searchsorted(number[order], parts[:, 0]), np.searchsorted(number[order], parts[:, 0], "right")
                for (_, a, b), x, y in zip(parts, low, high):
                    add(start[order[x:y]] + a, np.full(y - x, b - a))
        add(start[whole], count[whole])
        return block, np.cumsum(turn[:-1], dtype=np.int32) > 0

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pandas().itertuples(index=False):
                yield finish(*cover(row))

    sent = blockwise(blocks, send_names, "block string, range long, names binary, several binary", tasks)
    bits = sent.groupBy("range").applyInPandas(shared_bits, "block string, range long, bits binary")
    lists = bits.groupBy("block").agg(F.collect_list(F.struct("range", "bits")).alias("_b"))
    asked = blocks.join(lists, "block").select("block", "file", "at", "size", F.col("_b.range").alias("ranges"), F.col("_b.bits").alias("bits"))
    segments = stored(blockwise(asked, send_segments, "block string, range long, ids binary, sizes binary, data binary", tasks), "segments")
    shards = segments.where("range >= 0").groupBy("range").applyInPandas(lambda rows: shard_hits(rows, length), "block string, range long, state binary, some binary")
    hits = shards.groupBy("block").agg(F.collect_list(F.struct("range", "state", "some")).alias("_h"))
    kept = segments.where("range < 0").select("block", F.col("data").alias("kept"))
    all_rows = blocks.join(kept, "block", "left").join(hits, "block", "left").select(
        "block", "file", "at", "size", F.coalesce("kept", F.lit(pack(b""))).alias("kept"),
        F.col("_h.range").alias("ranges"), F.col("_h.state").alias("states"), F.col("_h.some").alias("somes"),
    )
    return all_rows.repartition(tasks).mapInArrow(result, schema)


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""

    def finish(block: Block, gone: np.ndarray) -> pa.RecordBatch:
        edge = np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1
        removed, spans, digest = [], [], []
        for a, n in zip(block.starts.tolist(), block.sizes.tolist()):
            mask = gone[a : a + n]
            removed.append(int(mask.sum()))
            spans.append(int(edge[a + 1 : a + n].sum()) + int(n > 0 and mask[0]))
            digest.append(hashlib.sha256(block.data[a : a + n][~mask].tobytes()).hexdigest())
        columns = [block.table.column("key").combine_chunks().cast(pa.int64()), pa.array(block.sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    flat = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text).alias("text"))
    out = _with_hits(flat, "key", "text", length, finish, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("key", id_col)


def remove(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; a character that loses some of its bytes goes whole. Null texts stay."""

    def finish(block: Block, gone: np.ndarray) -> pa.RecordBatch:
        nulls = block.table.column(text).is_null().to_pylist()
        left = [
            None if null else block.data[a : a + n][~gone[a : a + n]].tobytes().decode("utf-8", "ignore")
            for a, n, null in zip(block.starts.tolist(), block.sizes.tolist(), nulls)
        ]
        at = block.table.schema.get_field_index(text)
        table = block.table.set_column(at, block.table.schema.field(at), pa.array(left, block.table.schema.field(at).type))
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.columns], schema=table.schema)

    return _with_hits(docs, id_col, text, length, finish, docs.schema)
