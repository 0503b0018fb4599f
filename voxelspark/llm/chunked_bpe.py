"""Byte-level BPE with content-defined chunks that are encoded once.

A rolling hash over the last 32 bytes cuts every text where its top bits are zero, so equal passages have equal chunks
wherever they stand. Chunks that occur more than once in the distinct texts are encoded once, by the text that owns
their first occurrence, and their ids are sent to all texts that hold them. What lies between shared chunks is encoded
in place. Ids on both sides of a joint may differ from those of the whole text, so every joint is repaired: a window
from a sync point on the left to one on the right is encoded again, and grows until the ids on both sides agree with it
in position. A sync point is a single space between two printable ASCII characters: the pattern always starts a new
word there, whatever else the text holds, so ids before and after it don't depend on each other.

Texts travel once, compressed, one copy per task, and are met by the ids of their shared chunks in a sorted stream; a
text is held as a whole, other groups never are.

``tokenizers`` defines the ids. ``Codec`` takes them from the rank table of the same vocabulary, which is faster: there
a pair merges when the joined bytes are a token, here when the pair is the token's own. In a trained table ranks rise
along every merge, so the state inside a token's bytes is the same in both when its rank is due. Texts that the pattern
engine refuses (very long white space) go to ``tokenizers``.

Defined cases: null and empty texts have no ids and decode to ''; ids of any type pass untouched, also null; repeated
rows keep one result each; an empty table gives no rows; extra columns are ignored; the name of the vocabulary's
special token inside a text is that one token.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import broadcast_if_small, parts_of, stored
from .packing import SPECIAL, SPECIAL_ID, default_vocabulary, encoder, plain_ids

WINDOW = 32  # bytes under the rolling hash
CUT_BITS = 9  # a cut every 512 bytes on average
LEAST, MOST = 128, 16_384  # bytes of a chunk
KEY = 16  # bytes of the digests of texts and chunks
GEAR = np.random.default_rng(1).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
PIECE = 1 << 22  # bytes hashed at a time


class Codec:
    """Ids of a text and the bytes of ids."""

    def __init__(self, vocabulary: tuple[str, str] | None = None):
        self.vocabulary = vocabulary or default_vocabulary()
        ranks = encoder(*self.vocabulary)
        self.tokens = [ranks.decode_single_token_bytes(i) for i in range(SPECIAL_ID)] + [SPECIAL.encode()]
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.names = [str(i).encode() for i in range(len(self.tokens))]

    def encode(self, text: str) -> np.ndarray:
        return plain_ids(text, *self.vocabulary).astype(np.uint16)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def ids_sha256(self, ids: np.ndarray) -> str:
        return hashlib.sha256(b",".join(map(self.names.__getitem__, ids.tolist()))).hexdigest()


@lru_cache(maxsize=2)
def codec(vocabulary: tuple[str, str] | None = None) -> Codec:
    return Codec(vocabulary)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the hash of the ``WINDOW`` bytes that end there, by doubling; at the start, of fewer."""
    h, span = GEAR[data], 1
    while span < WINDOW:
        shifted = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += shifted
        span *= 2
    return h


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of a UTF-8 text: where the hash says so, never inside a character."""
    b = np.frombuffer(raw, np.uint8)
    found = []
    for at in range(0, len(b), PIECE):
        start = max(0, at - WINDOW)
        h = rolling(b[start : at + PIECE])[at - start :]
        found.append(np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + at + 1)
    inside = np.concatenate(found) if found else np.zeros(0, np.int64)
    inside = inside[inside < len(b)]
    ends, last = [], 0
    for e in [*inside[(b[inside] & 0xC0) != 0x80].tolist(), len(b)]:
        while e - last > MOST:
            forced = last + MOST
            while b[forced] & 0xC0 == 0x80:
                forced -= 1
            ends.append(forced)
            last = forced
        if e - last >= LEAST or e == len(b) and e > last:
            ends.append(e)
            last = e
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=KEY).digest()


def sync_points(raw: bytes) -> np.ndarray:
    """Positions of single spaces between printable ASCII characters."""
    b = np.frombuffer(raw, np.uint8)
    plain = (b > 32) & (b < 127)
    return np.flatnonzero((b[1:-1] == 32) & plain[:-2] & plain[2:]) + 1 if len(b) > 2 else np.zeros(0, np.int64)


def assembled(raw: bytes, shared: list[tuple[int, int, np.ndarray]], coder: Codec) -> np.ndarray:
    """Ids of a whole text from those of its shared chunks (start, length, ids; in order, disjoint)."""
    if not shared:
        return coder.encode(raw.decode())
    spans, at = [], 0
    for start, n, ids in shared:
        if start > at:
            spans.append((at, start, None))
        spans.append((start, start + n, ids))
        at = start + n
    if at < len(raw):
        spans.append((at, len(raw), None))
    pieces = [coder.encode(raw[a:b].decode()) if ids is None else ids for a, b, ids in spans]
    return joined(raw, [a for a, _, _ in spans], pieces, coder)


def joined(raw: bytes, starts: list[int], pieces: list[np.ndarray], coder: Codec) -> np.ndarray:
    """Ids of ``raw`` from the ids of its consecutive pieces, with every joint encoded again up to agreement."""
    marks = [np.cumsum(coder.sizes[p]) + a for a, p in zip(starts, pieces)]  # where each id ends
    ends = [*starts[1:], len(raw)]
    safe = sync_points(raw)
    out, done, k = [], 0, 0  # ``done``: bytes whose ids are in ``out``
    while k < len(pieces):
        if k + 1 == len(pieces):
            out.append(pieces[k][np.searchsorted(marks[k], done, "right") :])
            break
        # Left: the last sync point of piece k after ``done`` at which one of its ids ends; else all from ``done`` on.
        i = np.searchsorted(safe, ends[k] - 1) - 1
        left = done
        while i >= 0 and safe[i] > max(done, starts[k]):
            at = np.searchsorted(marks[k], safe[i])
            if at < len(marks[k]) and marks[k][at] == safe[i]:
                left = int(safe[i])
                out.append(pieces[k][np.searchsorted(marks[k], done, "right") : at + 1])
                break
            i -= 1
        # Right: the first sync point of a later piece at which one of its ids ends; pieces without one are passed over.
        right, k = len(raw), k + 1
        while k < len(pieces) and right == len(raw):
            j = np.searchsorted(safe, starts[k] + 1)
            while j < len(safe) and safe[j] < ends[k] - 1:
                at = np.searchsorted(marks[k], safe[j])
                if marks[k][at] == safe[j]:
                    right = int(safe[j])
                    break
                j += 1
            k += right == len(raw)
        out.append(coder.encode(raw[left:right].decode()))
        done = right
    return np.concatenate(out) if out else np.zeros(0, np.uint16)


def _sent(docs: DataFrame, select: list, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    flat = docs.select(*select)

    def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(part for whole in batches for part in parts_of(whole))

    return flat.mapInArrow(slices, schema)


def marked(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """key (the id), digest of the text, chunks (their digests) and starts (in bytes, with the end) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, chunks, starts = [], [], []
            for t in batch["text"].to_pylist():
                raw = (t or "").encode()
                edges = [0, *cuts(raw)]
                digests.append(digest(raw))
                chunks.append([digest(raw[a:b]) for a, b in zip(edges, edges[1:])])
                starts.append(edges)
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(digests, pa.binary()), pa.array(chunks, pa.list_(pa.binary())), pa.array(starts, pa.list_(pa.int64()))], ["key", "digest", "chunks", "starts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _sent(docs, [F.col(id_col).alias("key"), F.col(text).cast("string").alias("text")], run, f"key {kind}, digest binary, chunks array<binary>, starts array<long>")


def occurrences(marks: DataFrame) -> DataFrame:
    """chunk, digest, start, n: the chunks of every distinct text."""
    texts = marks.groupBy("digest").agg(F.any_value(F.struct("chunks", "starts")).alias("_c"))
    each = texts.select("digest", F.col("_c.starts").alias("_s"), F.posexplode("_c.chunks").alias("_i", "chunk"))
    start, end = F.get("_s", F.col("_i")), F.get("_s", F.col("_i") + 1)
    return each.select("chunk", "digest", start.alias("start"), (end - start).alias("n"))


def sent_texts(docs: DataFrame, text: str) -> DataFrame:
    """digest and compressed text, at most once per task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            out = {}
            for t in batch["text"].to_pylist():
                raw = (t or "").encode()
                d = digest(raw)
                if d not in seen:
                    seen.add(d)
                    out[d] = pack.compress(raw)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], ["digest", "payload"])

    return _sent(docs, [F.col(text).cast("string").alias("text")], run, "digest binary, payload binary")


def met(texts: DataFrame, pieces: DataFrame, make: Callable[[bytes, bytes, list[tuple[int, int, bytes]]], list[tuple]], columns: list[pa.Field], schema: str) -> DataFrame:
    """Rows of ``make`` (digest, text, its pieces in order) for each distinct text; ``pieces`` has digest, start, n, payload.

    One shuffle by digest; a sorted stream holds the pieces and the text of one digest at a time.
    """
    both = texts.select("digest", F.lit(None).cast("long").alias("start"), F.lit(0).cast("long").alias("n"), "payload").unionByName(pieces.select("digest", "start", "n", "payload"))
    dealt = both.repartition("digest").sortWithinPartitions("digest", F.col("start").asc_nulls_last())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, now, held, done = zstandard.ZstdDecompressor(), None, [], False
        for batch in (part for whole in batches for part in parts_of(whole, "payload")):
            rows = []
            for d, start, n, payload in zip(*(batch[c].to_pylist() for c in ("digest", "start", "n", "payload"))):
                if d != now:
                    now, held, done = d, [], False
                if start is not None:
                    held.append((start, n, payload))
                elif not done:  # further copies of the text are passed over
                    rows += make(d, unpack.decompress(payload), held)
                    done, held = True, []
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(columns), columns)], [f.name for f in columns])

    return dealt.mapInArrow(run, schema)


def shared_ids(docs: DataFrame, occ: DataFrame, text: str, vocabulary: tuple[str, str] | None) -> tuple[DataFrame, DataFrame]:
    """(repeated, encoded): the chunks that occur more than once with their owner, and the ids of each, made once."""
    first = F.min(F.struct("digest", "start", "n")).alias("_o")
    repeated = stored(occ.groupBy("chunk").agg(first, F.count(F.lit(1)).alias("_n")).where("_n > 1").select("chunk", "_o.*"), "shared-chunks")
    owners = broadcast_if_small(stored(repeated.select("digest").distinct(), "owners"))
    texts = sent_texts(docs, text).join(owners, "digest", "left_semi")

    def make(_: bytes, raw: bytes, held: list[tuple[int, int, bytes]]) -> list[tuple]:
        coder = codec(vocabulary)
        return [(chunk, coder.encode(raw[a : a + n].decode()).tobytes()) for a, n, chunk in held]

    fields = [pa.field("chunk", pa.binary()), pa.field("ids", pa.binary())]
    return repeated, stored(met(texts, repeated.withColumnRenamed("chunk", "payload"), make, fields, "chunk binary, ids binary"), "chunk-ids")


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: tuple[str, str] | None = None, keep_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every row, and with ``keep_ids`` the ids (unsigned 16-bit) and the decoded text."""
    marks = stored(marked(docs, id_col, text), "chunk-marks")
    occ = stored(occurrences(marks), "occurrences")
    _, encoded = shared_ids(docs, occ, text, vocabulary)
    pieces = occ.join(encoded, "chunk").select("digest", "start", "n", F.col("ids").alias("payload"))

    def make(d: bytes, raw: bytes, held: list[tuple[int, int, bytes]]) -> list[tuple]:
        coder = codec(vocabulary)
        ids = assembled(raw, [(a, n, np.frombuffer(x, np.uint16)) for a, n, x in held], coder)
        decoded = coder.decode(ids).decode("utf-8", "replace")
        row = (d, len(ids), coder.ids_sha256(ids), hashlib.sha256(decoded.encode()).hexdigest())
        return [(*row, ids.tobytes(), decoded) if keep_ids else row]

    fields = [pa.field("digest", pa.binary()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    schema = "digest binary, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields, schema = [*fields, pa.field("ids", pa.binary()), pa.field("decoded", pa.string())], f"{schema}, ids binary, decoded string"
    results = met(sent_texts(docs, text), pieces, make, fields, schema)
    return marks.select(F.col("key").alias(id_col), "digest").join(results, "digest").drop("digest")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Number and digest of the ids of every row, and digest of what they decode to."""
    return encode(docs, id_col, text)
