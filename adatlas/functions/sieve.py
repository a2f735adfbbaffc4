"""A sieve of byte strings: which pieces of texts may be one of very many keys.

A key is told by a hash of its bytes, whose bits stand in one bounded array: a piece that is a key always passes, few
others do. Hashes of all pieces of a batch of texts come from running sums; pieces of four bytes or more are tried only
where a key of their size begins with the same four.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bits for each key; bytes by which a piece is told first, bits of their table; bytes of text that are looked at in one go.
PROBES, HEAD, HEAD_BITS, CHUNK = 3, 4, 20, 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and where each begins and the last ends."""
    column = pa.concat_arrays([column.cast(pa.large_binary())])
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return body, at - at[0]


def mixed(h: np.ndarray) -> np.ndarray:
    for m in MIX:
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


def cut(body: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Pieces of some bytes as a column."""
    at = np.concatenate([[0], np.cumsum(size)])
    taken = body[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(taken))])


class Hashes:
    """Hashes of any pieces of one run of bytes."""

    powers = {b: np.ones(1, np.uint64) for b in (BASE, INVERSE)}

    def __init__(self, body: np.ndarray):
        n = len(body) + 1
        for b, have in self.powers.items():
            if len(have) < n:
                more = np.full(2 * n, b, np.uint64)
                more[0] = 1
                self.powers[b] = np.multiply.accumulate(more)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * self.powers[INVERSE][: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return mixed((self.sums[start + size] - self.sums[start]) * self.powers[BASE][start] + np.asarray(size).astype(np.uint64) * MIX[1])


class Sieve:
    """sizes: of each size of keys the longest string that such a key stands for; a piece comes with as much of its text. ends: only at texts' ends."""

    def __init__(self, bits: int, sizes: dict[int, int], ends: bool):
        self.bits, self.sizes, self.ends = bits, sorted(sizes.items()), ends
        self.words, self.heads = np.zeros(1 << (bits - 6), np.uint64), np.zeros(1 << HEAD_BITS, np.uint64)
        self.place = {n: k for k, (n, _) in enumerate(self.sizes)}

    def probe(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where hashes have one of their PROBES bits: words and masks."""
        bit = (h + np.uint64(k) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64((1 << self.bits) - 1)
        return bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63))

    def slots(self, keys: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """What keys set in the array of bits and in the table of heads."""
        body, at = bytes_of(keys)
        hashes, start, size = Hashes(body), at[:-1], np.diff(at)
        h = hashes.of(start, size)
        words, masks = map(np.concatenate, zip(*(self.probe(h, k) for k in range(PROBES))))
        long = size >= HEAD
        heads = hashes.of(start[long], HEAD) >> np.uint64(64 - HEAD_BITS)
        places = np.array([self.place[n] for n in size[long].tolist()], np.uint64)
        return (words, masks), (heads, np.uint64(1) << places)

    def fill(self, found: pa.Table) -> None:
        for kind, array in enumerate((self.words, self.heads)):
            own = found.filter(pa.compute.equal(found["kind"], kind))
            array[own["slot"].to_numpy()] = own["mask"].to_numpy().view(np.uint64)

    def among(self, hashes: Hashes, start: np.ndarray, size: int) -> np.ndarray:
        """Where the pieces that pass begin."""
        h = hashes.of(start, size)
        for k in range(PROBES):
            word, mask = self.probe(h, k)
            passed = (self.words[word] & mask) != 0
            start, h = start[passed], h[passed]
        return start

    def found(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, start and size of key, start and size of piece of all that passes in some texts."""
        hashes, out = Hashes(body), []
        if not self.ends:
            end = np.repeat(at[1:], np.diff(at))  # of the text of each byte
            room = end - np.arange(len(body))
            long = np.flatnonzero(room >= HEAD)
            masks = self.heads[hashes.of(long, HEAD) >> np.uint64(64 - HEAD_BITS)]
            long, masks = long[masks != 0], masks[masks != 0]
        for place, (size, most) in enumerate(self.sizes):
            if self.ends:
                start = at[1:][np.diff(at) >= size] - size
            elif size < HEAD:
                start = np.flatnonzero(room >= size)
            else:
                start = long[(masks >> np.uint64(place)) & np.uint64(1) != 0]
                start = start[room[start] >= size]
            start = self.among(hashes, start, size)
            row = np.searchsorted(at, start, "right") - 1
            if self.ends:  # as much of the text as stands before
                first = np.maximum(at[row], start + size - most)
                out.append((row, start, np.full(len(row), size), first, start + size - first))
                continue
            if most == size <= 8 and len(row) > 1:  # short pieces, which repeat, once for each text
                value = sum(body[start + k].astype(np.uint64) << np.uint64(8 * k) for k in range(size))
                order = np.lexsort((value, row))
                keep = np.concatenate([[True], (np.diff(row[order]) != 0) | (np.diff(value[order]) != 0)])
                row, start = row[order][keep], start[order][keep]
            out.append((row, start, np.full(len(row), size), start, np.minimum(most, end[start] - start) if len(start) else start))
        return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.int64),) * 5

    def passing(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Ids and texts to ids, keys and pieces; a piece that is its key is null."""
        body, at = bytes_of(batch.column(1))
        ids, low = batch.column(0).to_numpy(zero_copy_only=False), 0
        while low < len(ids):
            high = max(low + 1, int(np.searchsorted(at, at[low] + CHUNK, "right")) - 1)
            part = body[at[low] : at[high]]
            row, start, size, first, most = self.found(part, at[low : high + 1] - at[low])
            keys, pieces = cut(part, start, size), cut(part, first, most)
            pieces = pa.compute.if_else(pa.array(most == size), pa.scalar(None, pa.binary()), pieces)
            yield pa.RecordBatch.from_arrays([pa.array(ids[low:high][row]), keys, pieces], names=["__id", "__key", "__piece"])
            low = high
