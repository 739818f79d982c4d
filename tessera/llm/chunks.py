"""A table of text chunks by hash, looked up for a whole batch of bytes at once with numpy.

Chunks are hashed with two polynomials over random byte values. The first finds the slot of an open-addressing
table, the second (with the length in both) must agree too, so a lookup rests on 128 bits.
"""

from __future__ import annotations

import numpy as np

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_FIRST, _SECOND = mix(np.arange(1, 257, dtype=np.uint64) * _M1), mix(np.arange(1, 257, dtype=np.uint64) * _M3)


BLOCK = 1 << 16


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = _M2 | np.uint64(1)
_POWER, _INVERSE = _powers(_BASE), _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)))


def prefix_sums(data: np.ndarray, table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """At each of places, ascending, the sum of table[data[i]] times the i-th power of the base over the bytes before it.

    The bytes are taken BLOCK at a time, which bounds what is held beside them."""
    out, total = np.empty(len(places), np.uint64), np.zeros(BLOCK + 1, np.uint64)
    edges = np.arange(0, len(data) + BLOCK + 1, BLOCK)
    cut = np.searchsorted(places, edges).tolist()
    before, up = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for k, lo in enumerate(edges[:-1].tolist()):
        values = table.take(data[lo : lo + BLOCK])
        values *= _POWER[: len(values)]
        np.cumsum(values, out=total[1 : len(values) + 1])
        out[cut[k] : cut[k + 1]] = total[places[cut[k] : cut[k + 1]] - lo] * up + before
        before = before + total[len(values)] * up
        up = up * _POWER[BLOCK]
    return out


def shifts_back(places: np.ndarray) -> np.ndarray:
    """What moves a sum that begins at each of places to place 0."""
    blocks = np.full(int(places[-1]) // BLOCK + 1, _INVERSE[BLOCK], np.uint64)
    blocks[0] = 1
    return _INVERSE[places % BLOCK] * np.multiply.accumulate(blocks)[places // BLOCK]


def hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each chunk of data; chunks begin at starts and fill data."""
    edges = np.append(starts, len(data))
    n, back = np.diff(edges).astype(np.uint64) * _M1, shifts_back(starts)
    one, two = (mix(np.diff(prefix_sums(data, table, edges)) * back ^ n) for table in (_FIRST, _SECOND))
    return np.maximum(one, np.uint64(1)), two


class ChunkTable:
    """Places of chunks, 0 on, in the order in which they were added, up to half as many as it has slots."""

    def __init__(self, bits: int = 21) -> None:
        self.bits, self.most = bits, 1 << (bits - 1)
        self.clear()

    def clear(self) -> None:
        self.slots, self.place = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.first, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.first)

    def _at(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Places, -1 where a chunk isn't there."""
        out, left, at = np.full(len(one), -1, np.int64), np.arange(len(one)), self._at(one)
        while len(left):
            slot = self.slots[at]
            hit = slot == one[left]
            out[left[hit]] = self.place[at[hit]]
            on = ~hit & (slot != 0)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        there = out >= 0
        out[there] = np.where(self.second[out[there]] == two[there], out[there], -1)
        return out

    def add(self, one: np.ndarray, two: np.ndarray) -> None:
        """Adds chunks whose first hashes are distinct and not there."""
        left, at = np.arange(len(one)), self._at(one)
        while len(left):
            free = np.flatnonzero(self.slots[at] == 0)
            _, k = np.unique(at[free], return_index=True)
            put = free[k]
            self.slots[at[put]], self.place[at[put]] = one[left[put]], len(self) + left[put]
            on = np.ones(len(left), bool)
            on[put] = False
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        self.first, self.second = np.concatenate([self.first, one]), np.concatenate([self.second, two])


class IdTable:
    """Ids, and further numbers, of chunks. `search` finds those of chunks that aren't kept."""

    def __init__(self, search, extra: int = 0, bits: int = 21) -> None:  # noqa: ANN001
        """search(list of chunks) gives a list of (ids as little-endian unsigned 32-bit integers, extra numbers ...)."""
        self.search, self.extra, self.table = search, extra, ChunkTable(bits)
        self.clear()

    def clear(self) -> None:
        self.table.clear()
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.numbers, self.uses = np.zeros((0, self.extra)), np.zeros(0, np.int64)

    def halve(self) -> None:
        """Keeps the more used half, at most."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: self.table.most // 2])
        kept = kept[self.size[kept] <= 64]
        first, second, ids, size = self.table.first[kept], self.table.second[kept], self.gather(kept), self.size[kept]
        numbers, uses = self.numbers[kept], self.uses[kept] // 2
        self.clear()
        self.table.add(first, second)
        self.append(ids, size, numbers)
        self.uses[:] = uses

    def append(self, ids: np.ndarray, size: np.ndarray, numbers: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(size) - size])
        self.size, self.numbers = np.concatenate([self.size, size]), np.concatenate([self.numbers, numbers])
        self.uses = np.concatenate([self.uses, np.zeros(len(size), np.int64)])
        self.used += len(ids)

    def gather(self, places: np.ndarray) -> np.ndarray:
        """The ids of chunks at places, in turn."""
        size = self.size[places]
        shift = self.begin[places] - (np.cumsum(size) - size)
        return self.ids[np.repeat(shift, size) + np.arange(size.sum())]

    def places(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Places of the chunks of data, after those that weren't kept were searched."""
        if not len(starts):
            return np.zeros(0, np.int64)
        one, two = hashes(data, starts)
        at = self.table.find(one, two)
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            self.uses += np.bincount(at, minlength=len(self.uses))
            return at
        new, k = np.unique(one[missing], return_index=True)
        if len(self.table) + len(new) > self.table.most or self.used > 16 * self.table.most:
            self.halve()
            at = self.table.find(one, two)
            missing = np.flatnonzero(at < 0)
            new, k = np.unique(one[missing], return_index=True)
            if len(self.table) + len(new) > self.table.most:
                self.clear()
                self.table = ChunkTable(self.table.bits + 2)
                return self.places(data, starts)
        ends = np.append(starts[1:], len(data))
        raw, k = data.tobytes(), missing[k]
        found = self.search([raw[a:b].decode() for a, b in zip(starts[k].tolist(), ends[k].tolist())])
        self.table.add(new, two[k])
        self.append(np.frombuffer(b"".join(x[0] for x in found), "<u4"), np.array([len(x[0]) // 4 for x in found], np.int64), np.array([x[1:] for x in found], float).reshape(len(found), self.extra))
        at[missing] = self.table.find(one[missing], two[missing])
        if (at < 0).any():
            raise RuntimeError("two chunks of a batch agree in one hash only")
        self.uses += np.bincount(at, minlength=len(self.uses))
        return at
