"""A wavelet matrix over token ids: one compressed file with token access, counting and occurrence lookup.

Bit-planes go from the highest bit down; after each plane the ids are split stably, zeros first. A file holds,
little-endian: the magic TLWM, version, number of planes and of blocks of rank directory (u32 each), the number
of ids and of documents (u64 each), the sizes of its frames (u64 each), then the frames, each compressed by zstd on its own. The first
has the end offset of each document (u64), its id (i64) and a byte that tells a missing id (1); the second the number of
zeros (u64) and the rank directory (u32 for every 512 bits) of each plane; then follows a frame for each plane's bits, packed, lowest
first, and padded to 64 bytes. A plane's frame is unpacked when a query first needs it.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC, VERSION, BLOCK = b"TLWM", 2, 512
_HEAD = struct.Struct("<4sIIIQQ")


class Planes:
    """The planes of a file, unpacked on first use."""

    def __init__(self, frames: list[bytes]):
        self.frames, self.open = frames, {}

    def __len__(self) -> int:
        return len(self.frames)

    def __getitem__(self, k: int) -> np.ndarray:
        if k not in self.open:
            self.open[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.frames[k]), np.uint8)
        return self.open[k]


class WaveletMatrix:
    def __init__(self, n: int, zeros: list[int], planes, ranks: list[np.ndarray], ends: np.ndarray, doc_ids: list[int | None]):
        self.n, self.zeros, self.planes, self.ranks, self.ends, self.doc_ids = n, zeros, planes, ranks, ends, doc_ids

    @classmethod
    def build(cls, ids: np.ndarray, ends: np.ndarray, width: int | None = None, doc_ids: list[int | None] | None = None) -> "WaveletMatrix":
        """ids: unsigned integers; ends: where each document ends, ascending; width: number of planes; doc_ids: of each document."""
        rest = np.ascontiguousarray(ids, np.uint32)
        width = width or max(1, int(rest.max(initial=0)).bit_length())
        if width <= 16:
            rest = rest.astype(np.uint16)
        zeros, planes, ranks = [], [], []
        for bit in range(width - 1, -1, -1):
            on = (rest >> bit & 1).astype(bool)
            low = np.flatnonzero(~on)
            zeros.append(len(low))
            packed = np.packbits(on, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)])
            counts = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint64)
            planes.append(packed)
            ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32))
            rest = np.concatenate([rest.take(low), rest.take(np.flatnonzero(on))])
        return cls(len(ids), zeros, planes, ranks, np.ascontiguousarray(ends, np.uint64), [None] * len(ends) if doc_ids is None else list(doc_ids))

    def to_bytes(self) -> bytes:
        names = np.array([0 if i is None else i for i in self.doc_ids], "<i8").tobytes() + bytes(i is None for i in self.doc_ids)
        parts = [self.ends.astype("<u8").tobytes() + names, b"".join(struct.pack("<Q", z) + r.astype("<u4").tobytes() for z, r in zip(self.zeros, self.ranks))]
        pack = zstandard.ZstdCompressor(level=1).compress
        frames = [pack(x) for x in (*parts, *(self.planes[k].tobytes() for k in range(len(self.planes))))]
        head = _HEAD.pack(MAGIC, VERSION, len(self.planes), len(self.ranks[0]) if self.ranks else 1, self.n, len(self.ends))
        return b"".join([head, *(struct.pack("<Q", len(f)) for f in frames), *frames])

    @classmethod
    def from_bytes(cls, data: bytes) -> "WaveletMatrix":
        """Reads the head, the documents and the rank directory; planes wait until they are asked for."""
        magic, version, width, blocks, n, docs = _HEAD.unpack_from(data)
        sizes = struct.unpack_from(f"<{width + 2}Q", data, _HEAD.size) if magic == MAGIC and version == VERSION else ()
        at = _HEAD.size + 8 * len(sizes)
        if not sizes or len(data) != at + sum(sizes):
            raise ValueError("not a whole wavelet file")
        frames = []
        for size in sizes:
            frames.append(data[at : at + size])
            at += size
        unpack = zstandard.ZstdDecompressor().decompress
        first, second = unpack(frames[0]), unpack(frames[1])
        ends, ids, missing = np.frombuffer(first, "<u8", docs), np.frombuffer(first, "<i8", docs, 8 * docs).tolist(), first[16 * docs :]
        step = 8 + 4 * blocks
        zeros = [struct.unpack_from("<Q", second, k * step)[0] for k in range(width)]
        ranks = [np.frombuffer(second, "<u4", blocks, k * step + 8) for k in range(width)]
        return cls(n, zeros, Planes(frames[2:]), ranks, ends, [None if m else i for i, m in zip(ids, missing)])

    # -- succinct queries ---------------------------------------------------------------------------------
    def _rank1(self, plane: int, at: int) -> int:
        """Set bits before position `at`."""
        block = at // BLOCK
        first = block * (BLOCK // 8)
        part = self.planes[plane][first : first + (at % BLOCK + 7) // 8]
        bits = np.unpackbits(part, bitorder="little")[: at % BLOCK]
        return int(self.ranks[plane][block]) + int(bits.sum())

    def _select(self, plane: int, k: int, bit: int) -> int:
        """Position of the k-th (from 0) bit of that value."""
        ranks, low, high = self.ranks[plane], 0, len(self.ranks[plane]) - 1
        before = lambda b: int(ranks[b]) if bit else b * BLOCK - int(ranks[b])
        while high - low > 1:  # the last block with at most k such bits before it
            middle = (low + high) // 2
            low, high = (middle, high) if before(middle) <= k else (low, middle)
        part = np.unpackbits(self.planes[plane][low * BLOCK // 8 : (low + 1) * BLOCK // 8], bitorder="little")
        return low * BLOCK + int(np.flatnonzero(part == bit)[k - before(low)])

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for k in range(len(self.planes)):
            ones = self._rank1(k, at)
            bit = int(self.planes[k][at // 8] >> (at % 8)) & 1
            value = value << 1 | bit
            at = self.zeros[k] + ones if bit else at - ones
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        width = len(self.planes)
        if token >> width:
            return 0, 0
        for k in range(width):
            a, b = self._rank1(k, start), self._rank1(k, end)
            start, end = (self.zeros[k] + a, self.zeros[k] + b) if token >> (width - 1 - k) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token at positions start to end, end excluded."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of a token; -1 if there are fewer."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        at = a + k
        for plane in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - plane) & 1
            at = self._select(plane, at - self.zeros[plane] if bit else at, bit)
        return at

    # -- many positions at once ---------------------------------------------------------------------------
    def _rank1_at(self, plane: int, at: np.ndarray) -> np.ndarray:
        words = np.append(self.planes[plane].view("<u8"), np.uint64(0))
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        return before[at >> 6] + np.bitwise_count(words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def access_at(self, at: np.ndarray) -> np.ndarray:
        """Ids at many positions, each below n."""
        at, value = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for k in range(len(self.planes)):
            ones = self._rank1_at(k, at)
            bit = (self.planes[k][at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(np.int64)
            value = value << 1 | bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return value

    def count_in(self, token: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Occurrences of a token in many ranges, ends excluded."""
        at = np.concatenate([starts, ends]).astype(np.int64)
        width = len(self.planes)
        if token >> width:
            return np.zeros(len(starts), np.int64)
        for k in range(width):
            ones = self._rank1_at(k, at)
            at = self.zeros[k] + ones if token >> (width - 1 - k) & 1 else at - ones
        return at[len(starts) :] - at[: len(starts)]

    # -- whole shards -------------------------------------------------------------------------------------
    def decode(self) -> np.ndarray:
        """All ids in order: planes are undone from the lowest bit up."""
        out = np.zeros(self.n, np.uint32 if len(self.planes) > 16 else np.uint16)
        for k in range(len(self.planes) - 1, -1, -1):
            on = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            back = np.empty_like(out)
            back[np.flatnonzero(~on)] = out[: self.zeros[k]]
            back[np.flatnonzero(on)] = out[self.zeros[k] :] | out.dtype.type(1 << (len(self.planes) - 1 - k))
            out = back
        return out.astype(np.uint32, copy=False)
