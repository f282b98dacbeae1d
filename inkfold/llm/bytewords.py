"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PRIME, WORD_STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
PIECE_BYTES = 1 << 18
GROUP_BYTES = 1 << 17  # arrays of 64-bit numbers per byte stay at a megabyte each


def byte_table(words: set[int], lower: bool = True) -> np.ndarray:
    """Byte to itself (A-Z to a-z) if it belongs to words, else to zero."""
    table = np.zeros(256, np.uint8)
    for byte in range(1, 256):
        folded = byte + 32 if lower and 65 <= byte <= 90 else byte
        if folded in words:
            table[byte] = folded
    return table


#: Letters and digits of ASCII and every byte of longer characters.
ALNUM = byte_table({*range(48, 58), *range(97, 123), *range(128, 256)})


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """Null texts become empty ones."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


class WordHasher:
    """Word boundaries and 64-bit hashes; powers of the multiplier grow as pieces need them."""

    def __init__(self, table: np.ndarray = ALNUM):
        self.table = table
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if size > len(self.powers):
            odd = np.uint64(PRIME)
            back = np.uint64(pow(PRIME, -1, 1 << 64))
            self.powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, odd))))
            self.inverse = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, back))))

    def piece(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends (byte offsets) and hashes of the words of ``data``."""
        folded = self.table[np.frombuffer(data, np.uint8)]
        inside = np.zeros(len(folded) + 2, np.int8)
        inside[1:-1] = folded != 0
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return starts, ends, np.zeros(0, np.uint64)
        self._grow(len(folded))
        sums = np.zeros(len(folded) + 1, np.uint64)
        np.cumsum(folded.astype(np.uint64) * self.powers[: len(folded)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.inverse[starts]
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
        return starts, ends, hashes

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``piece`` for a text of any length: cut between words, so memory follows the words."""
        if len(data) <= PIECE_BYTES:
            return self.piece(data)
        found, at = [], 0
        while at < len(data):
            end = min(at + PIECE_BYTES, len(data))
            while end < len(data) and self.table[data[end]]:
                end += 1
            starts, ends, hashes = self.piece(data[at:end])
            found.append((starts + at, ends + at, hashes))
            at = end
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def group(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of several texts: starts and ends within ``\\0``.join(texts), hashes, and first word of each text."""
        if len(texts) == 1:
            starts, ends, hashes = self.words(texts[0])
            return starts, ends, hashes, np.array([0, len(starts)])
        joined = b"\0".join(texts)
        starts, ends, hashes = self.piece(joined)
        begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
        return starts, ends, hashes, np.searchsorted(starts, begins)


def groups(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of up to ``GROUP_BYTES`` together; a longer text stands alone."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= GROUP_BYTES:
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words, by the index of its first word."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, length):
        out *= np.uint64(WORD_STEP)
        out += hashes[k : k + n]
    return out
