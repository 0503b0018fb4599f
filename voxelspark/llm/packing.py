"""Sum-of-squares packing of token sequences.

Texts become token ids plus an end id; longer ones are cut into full pieces, the remainder in front. Pieces
are dealt into groups of a bounded number of rows and packed, longest first: a piece goes to the open bin
whose choice leaves the sum of the squared numbers of open bins per residual gap smallest, and a new bin is
opened only when none fits. A choice needs the counts per gap alone, at most ``limit`` numbers.

Defined cases: a null or empty text is the end id alone; ties go to the bin opened last; repeated rows are
packed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_texts, stored

LIMIT = 2048
END = 0
GROUP_ROWS = 50_000
SPECIAL = "<|endoftext|>"  # the vocabulary's one added token, id 50256
SPECIAL_ID = 50256


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


def default_vocabulary() -> tuple[str, str]:
    """The rank file of the byte-level vocabulary (its ids equal those of ``byte_bpe_50k.json``) and the pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def reference(path: str):
    """The tokenizer file beside a rank file, by the library that defines the ids."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json")
    made.no_truncation()
    made.no_padding()
    return made


def plain_ids(text: str, path: str, pattern: str) -> np.ndarray:
    """Ids of ``text``. Very long white space is more than the pattern engine takes; such texts go to ``reference``."""
    try:
        return encoder(path, pattern).encode_to_numpy(text, allowed_special="all", disallowed_special=())
    except ValueError:
        return np.array(reference(path).encode(text, add_special_tokens=False).ids, np.uint32)


def token_ids(text: str, path: str, pattern: str) -> np.ndarray:
    """Ids of ``text`` and the end id, as unsigned 32-bit numbers."""
    return np.append(plain_ids(text, path, pattern), END).astype("<u4")


def cuts(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, after a shorter first one if ``n`` isn't a multiple."""
    first = n % limit
    starts = [0] if first else []
    starts += range(first, n, limit)
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT, vocabulary: tuple[str, str] | None = None, keep_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32, a row number of the batch (``salt``), and with ``keep_ids`` the ids as bytes."""
    path, pattern = vocabulary or default_vocabulary()

    def make(texts: list[str]) -> tuple[np.ndarray, list]:
        rows, spans, sums, parts = [], [], [], []
        for i, value in enumerate(texts):
            ids = token_ids(value, path, pattern)
            raw = ids.tobytes()
            for k, (start, n) in enumerate(cuts(len(ids), limit)):
                part = raw[4 * start : 4 * (start + n)]
                rows.append(i)
                spans.append((k, start, n))
                sums.append(zlib.crc32(part))
                parts.append(part if keep_ids else b"")
        piece, start, length = np.array(spans, np.int64).reshape(-1, 3).T
        return np.array(rows, np.int64), [piece.astype(np.int32), start, length, np.array(sums, np.int64), np.arange(len(rows)), parts]

    out = map_texts(docs, F.col(id_col), F.col(text), make, "piece int, start long, length long, ids_crc32 long, salt long, ids binary")
    return (out if keep_ids else out.drop("ids")).withColumnRenamed("key", id_col)


def place(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, by the sum-of-squares rule, longest pieces first."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(limit + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(limit + 1)]
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        have = count[n:]
        if have.any():
            # Moving a bin from gap g to g - n changes the sum by 2 (count[g - n] - count[g]) + 2; a filled bin no longer counts.
            change = 2 * (count[: limit + 1 - n] - have) + 2
            change[0] = 1 - 2 * have[0]
            gap = int(np.argmin(np.where(have > 0, change, np.iinfo(np.int64).max))) + n
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            b, gap = made, limit
            made += 1
        bins[i], offsets[i] = b, limit - gap
        if gap > n:
            open_bins[gap - n].append(b)
            count[gap - n] += 1
    return bins, offsets


def pack(parts: DataFrame, id_col: str = "doc_id", limit: int = LIMIT, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``parts`` (as from ``pieces``) with sequence_id and offset; groups hold about ``group_rows`` rows."""
    parts = stored(parts, "pieces")
    groups = max(1, -(-parts.count() // group_rows))
    dealt = parts.withColumn("_group", F.pmod(F.xxhash64(id_col, "piece", "salt"), F.lit(groups)))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(id_col, "ascending"), ("piece", "ascending"), ("salt", "ascending")])
        bins, offsets = place(rows.column("length").to_numpy(), limit)
        ids = rows.column("_group").to_numpy() * 2**32 + bins
        return rows.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("_group").applyInArrow(run, f"{fields}, sequence_id long, offset long").drop("_group", "salt")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids (bytes) of each packed sequence; ``packed`` must carry ``ids``."""
    joined = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(joined, "")).alias("ids"), F.sum("length").alias("length"))
