"""Directly addressable codes: non-negative integers in chunk levels with continuation bitmaps.

Each id is cut into chunks of ``chunk_bits`` bits, lowest first. Level k holds the k-th chunk of every
id that has one, in order; its bitmap tells which of them go on to level k + 1, and a rank directory
holds the number of set bits before every 512th, so the place of id i on the next level is one
directory read and a popcount away. Any id is read without decoding others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 512


@dataclass
class Levels:
    """chunks, bitmaps and ranks, one entry a level; the last level's bitmap and ranks are empty."""

    chunks: list[np.ndarray]
    bitmaps: list[np.ndarray]
    ranks: list[np.ndarray]

    @classmethod
    def of(cls, ids: np.ndarray, chunk_bits: int = 8) -> Levels:
        if chunk_bits not in (8, 16):
            raise ValueError("chunk_bits must be 8 or 16")
        kind, rest = np.dtype(f"<u{chunk_bits // 8}"), np.asarray(ids, np.uint64)
        out = cls([], [], [])
        while True:
            out.chunks.append((rest & np.uint64((1 << chunk_bits) - 1)).astype(kind))
            rest = rest >> np.uint64(chunk_bits)
            more = rest > 0
            if not more.any():
                out.bitmaps.append(np.zeros(0, np.uint8))
                out.ranks.append(np.zeros(0, "<u4"))
                return out
            bits = np.packbits(more, bitorder="little")
            padded = np.zeros(-(-len(bits) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            padded[: len(bits)] = bits
            sums = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
            out.bitmaps.append(padded)
            out.ranks.append((np.cumsum(sums) - sums).astype("<u4"))
            rest = rest[more]

    @classmethod
    def from_bytes(cls, chunk_bits: int, chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes]) -> Levels:
        return cls([np.frombuffer(x, f"<u{chunk_bits // 8}") for x in chunks], [np.frombuffer(x, np.uint8) for x in bitmaps], [np.frombuffer(x, "<u4") for x in ranks])

    def __len__(self) -> int:
        return len(self.chunks[0])

    def rank(self, level: int, at: int) -> int:
        """Set bits of the level's bitmap before position ``at``."""
        bits, block = self.bitmaps[level], at // BLOCK
        if 8 * len(bits) <= at:
            return int(np.bitwise_count(bits).sum(dtype=np.int64))
        whole = int(np.bitwise_count(bits[block * BLOCK // 8 : at // 8]).sum(dtype=np.int64))
        return int(self.ranks[level][block]) + whole + (int(bits[at // 8]) & ((1 << at % 8) - 1)).bit_count()

    def slice(self, start: int, stop: int) -> np.ndarray:
        """ids start..stop-1; only the chunks of these are touched."""
        ids = np.zeros(stop - start, np.uint64)
        places, bits = np.arange(stop - start), self.chunks[0].dtype.itemsize * 8
        for level, chunks in enumerate(self.chunks):
            ids[places] |= chunks[start:stop].astype(np.uint64) << np.uint64(bits * level)
            if level + 1 == len(self.chunks) or start == stop:
                break
            first = start // 8 * 8
            more = np.unpackbits(self.bitmaps[level][first // 8 : -(-stop // 8)], bitorder="little")[start - first : stop - first].astype(bool)
            start = self.rank(level, start)
            places, stop = places[more], start + int(more.sum())
        return ids

    def __getitem__(self, at: int) -> int:
        if not 0 <= at < len(self):
            raise IndexError(at)
        return int(self.slice(at, at + 1)[0])
