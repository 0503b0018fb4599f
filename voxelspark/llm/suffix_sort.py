"""External induced suffix sorting with common-prefix values, for one shard of segments.

Suffixes are split into L and S types. The S* suffixes (S after L) are ordered first; a pass in ascending order
induces the L suffixes and a pass in descending order the S suffixes. Tuples (position, common prefix with
the tuple before it) wait in a priority queue ordered by first symbol, then by arrival, which within a symbol is
their rank; the queue keeps a bounded number of tuples in memory and the rest in a file. The common prefix
of two induced suffixes is one more than the least common prefix between the suffixes that induced them.

Common prefixes are cut at ``cap``, beyond which order doesn't matter here; that also ends the recursion on
the S* suffixes at once, as their first ``cap`` symbols rank them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

SYMBOLS = 258  # 0 the end, 1 a separator, then the byte values


class TupleQueue:
    """Tuples by symbol in order of arrival; beyond ``memory`` tuples the fullest symbols go to a file."""

    def __init__(self, memory: int):
        self.memory, self.held = memory, 0
        self.ram: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(SYMBOLS)]
        self.disk: list[list[tuple[int, int]]] = [[] for _ in range(SYMBOLS)]
        self.size = np.zeros(SYMBOLS, np.int64)
        self.file = None

    def push(self, symbol: int, position: np.ndarray, prefix: np.ndarray) -> None:
        self.ram[symbol].append((position, prefix))
        self.size[symbol] += len(position)
        self.held += len(position)
        while self.held > self.memory:
            self.spill(max(range(SYMBOLS), key=lambda s: sum(len(p) for p, _ in self.ram[s])))

    def spill(self, symbol: int) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for position, prefix in self.ram[symbol]:
            self.disk[symbol].append((self.file.seek(0, 2), len(position)))
            self.file.write(position.tobytes() + prefix.tobytes())
            self.held -= len(position)
        self.ram[symbol] = []

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks in order of arrival, also those pushed meanwhile; they leave the queue."""
        while self.disk[symbol] or self.ram[symbol]:
            if self.disk[symbol]:
                at, n = self.disk[symbol].pop(0)
                self.file.seek(at)
                data = self.file.read(5 * n)
                yield np.frombuffer(data, np.int32, n), np.frombuffer(data, np.uint8, n, 4 * n)
            else:
                blocks, self.ram[symbol] = self.ram[symbol], []
                position, prefix = (np.concatenate(x) for x in zip(*blocks))
                self.held -= len(position)
                yield position, prefix

    def close(self) -> None:
        if self.file:
            self.file.close()


def range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of ``values[first..last]`` for each pair, by blocks of doubling width."""
    width = last - first + 1
    out = np.empty(len(first), values.dtype)
    level, table = 0, values
    while True:
        now = np.flatnonzero((width >> level) == 1)
        if len(now):
            out[now] = np.minimum(table[first[now]], table[last[now] - (1 << level) + 1])
        if not len(width) or (1 << (level + 1)) > width.max():
            return out
        table = np.minimum(table[: len(table) - (1 << level)], table[1 << level :])
        level += 1


class Inducer:
    """One pass: scans suffixes in order and queues the predecessors of the wanted type."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, cap: int, memory: int):
        self.text, self.wanted, self.cap = text, wanted, cap
        self.queue = TupleQueue(memory)

    def start_symbol(self) -> None:
        """Suffixes of another first symbol follow: nothing is shared with what was scanned before."""
        self.emitted = np.zeros(SYMBOLS, bool)
        self.least = np.full(SYMBOLS, self.cap, np.uint8)

    def scan(self, position: np.ndarray, prefix: np.ndarray) -> None:
        before = position - 1
        at = np.flatnonzero((before >= 0) & self.wanted[before])
        if not len(at):
            np.minimum(self.least, prefix.min(), out=self.least)
            return
        symbol = self.text[before[at]]
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        new = np.concatenate(([True], symbol[1:] != symbol[:-1]))
        shared = np.zeros(len(at), np.int64)
        old = np.flatnonzero(~new)
        shared[old] = range_least(prefix, at[old - 1] + 1, at[old]).astype(np.int64) + 1
        firsts = np.flatnonzero(new)
        so_far = np.minimum(np.minimum.accumulate(prefix)[at[firsts]], self.least[symbol[firsts]]).astype(np.int64)
        shared[firsts] = np.where(self.emitted[symbol[firsts]], so_far + 1, self.queue.size[symbol[firsts]] > 0)
        ends = np.concatenate((firsts[1:], [len(at)]))
        after = np.append(np.minimum.accumulate(prefix[::-1])[::-1], self.cap).astype(np.uint8)
        np.minimum(self.least, prefix.min(), out=self.least)
        self.least[symbol[firsts]] = after[at[ends - 1] + 1]
        self.emitted[symbol[firsts]] = True
        found, shared = before[at], np.minimum(shared, self.cap).astype(np.uint8)
        for a, b in zip(firsts, ends):
            self.queue.push(int(symbol[a]), found[a:b], shared[a:b])


def shared_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at each pair of positions, at most ``cap``."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    n = len(text)
    for k in range(cap):
        x, y = a[live] + k, b[live] + k
        live = live[(x < n) & (y < n) & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])]
        if not len(live):
            break
        out[live] += 1
    return out.astype(np.uint8)


def order_seeds(text: np.ndarray, seeds: np.ndarray, cap: int) -> np.ndarray:
    """``seeds`` ordered by their first ``cap`` symbols: four symbols at a time, only ties go on."""
    padded = np.concatenate((text, np.zeros(cap + 4, text.dtype)))
    rank, live = np.zeros(len(seeds), np.int32), np.arange(len(seeds), dtype=np.int32)
    order = seeds.copy()
    for k in range(0, cap, 4):
        part = order[live]
        key = np.zeros(len(live), np.uint64)
        for j in range(4):
            key = (key << np.uint64(16)) | padded[part + k + j].astype(np.uint64)
        by = np.lexsort((key, rank[live]))
        order[live], key, group = part[by], key[by], rank[live][by]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
        rank[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live), dtype=np.int32), 0))]
        tied = ~new
        tied[:-1] |= ~new[1:]
        live = live[tied]
        if not len(live):
            break
    return order


def suffix_array(text: np.ndarray, cap: int, memory: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (positions, common prefix with the position before) of the suffixes of ``text`` in descending order.

    ``text`` holds symbols below ``SYMBOLS``, ends with its only 0 and is shorter than 2^31. Order is exact for the first ``cap`` symbols.
    """
    n = len(text)
    step = np.diff(text.astype(np.int16))
    nearest = np.minimum.accumulate(np.where(step != 0, np.arange(n - 1, dtype=np.int32), np.int32(n))[::-1])[::-1]
    s_type = np.ones(n, bool)
    s_type[:-1] = step[nearest] > 0  # the end differs from its left, so a step always follows
    star = (np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1).astype(np.int32)
    star = order_seeds(text, star, cap)
    star_prefix = np.concatenate(([0], shared_prefix(text, star[:-1], star[1:], cap))).astype(np.uint8)
    star_from = np.searchsorted(text[star], np.arange(SYMBOLS + 1))

    low = Inducer(text, ~s_type, cap, memory)
    done = TupleQueue(memory)
    last_of = np.full(SYMBOLS, -1, np.int32)
    for c in range(SYMBOLS):
        low.start_symbol()
        for position, prefix in low.queue.pop(c):
            low.scan(position, prefix)
            done.push(c, position, prefix)
            last_of[c] = position[-1]
        a, b = star_from[c], star_from[c + 1]
        if a < b:
            prefix = star_prefix[a:b].copy()
            prefix[0] = shared_prefix(text, last_of[c : c + 1], star[a : a + 1], cap)[0] if last_of[c] >= 0 else 0
            low.scan(star[a:b], prefix)
    low.queue.close()

    high = Inducer(text, s_type, cap, memory)
    for c in range(SYMBOLS - 1, -1, -1):
        high.start_symbol()
        before = np.zeros(0, np.int32)
        for position, prefix in high.queue.pop(c):
            high.scan(position, prefix)
            yield position, prefix
            before = position[-1:]
        blocks = list(done.pop(c))
        follow = None  # common prefix of the block's last suffix with the one scanned before it
        for position, prefix in reversed(blocks):
            if follow is None:
                follow = shared_prefix(text, position[-1:], before, cap) if len(before) else np.zeros(1, np.uint8)
            turned = np.concatenate((follow, prefix[:0:-1]))
            follow = prefix[:1]
            high.scan(position[::-1], turned)
            yield position[::-1], turned
    done.close()
    high.queue.close()


def equal_windows(text: np.ndarray, length: int, owner: np.ndarray) -> np.ndarray:
    """Per position the least ``owner`` of the positions that start with the same ``length`` symbols.

    Walks the suffix array once; a run of neighbours that share ``length`` symbols is a group, also across blocks.
    """
    out = owner.copy()
    held: list[np.ndarray] = []  # the open group's positions, block by block

    def settle() -> None:
        if sum(map(len, held)) > 1:
            group = np.concatenate(held)
            out[group] = owner[group].min()
        held.clear()

    for position, prefix in suffix_array(text, length):
        cut = np.flatnonzero(prefix < length)
        if not len(cut):
            held.append(position)
            continue
        if cut[0]:
            held.append(position[: cut[0]])
        settle()
        inner = position[cut[0] : cut[-1]]
        if len(inner):
            starts = cut[:-1] - cut[0]
            least = np.minimum.reduceat(owner[inner], starts)
            out[inner] = np.repeat(least, np.diff(np.append(starts, len(inner))))
        held.append(position[cut[-1] :])
    settle()
    return out
