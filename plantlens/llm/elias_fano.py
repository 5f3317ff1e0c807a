"""Elias-Fano lists of where the code points of a text begin.

A text of n code points and u bytes has the rising list of its n + 1 boundaries,
0 and u included. The low bits of each, about log2(u / n) of them, are packed one
after the other; the high bits are told in unary: the i-th boundary sets the bit
at (high part + i). That is some two bits for a code point of plain text. To
select the i-th boundary, a directory of ones before each block of BLOCK bytes
leads to the block that holds the i-th one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 512


@dataclass
class Boundaries:
    """``n`` + 1 boundaries: bits of a low part, packed low parts, unary high parts, and ones before each block."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    ones: bytes

    @classmethod
    def of(cls, text: bytes) -> Boundaries:
        """Boundaries of UTF-8: every byte that continues no code point begins one."""
        raw = np.frombuffer(text, dtype=np.uint8)
        at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        low_bits = max(0, (len(raw) // len(at)).bit_length() - 1)
        shifts = np.arange(low_bits)
        low = np.packbits(((at[:, None] >> shifts) & 1).astype(np.uint8), bitorder="little")
        bits = np.zeros((len(raw) >> low_bits) + len(at), dtype=np.uint8)
        bits[(at >> low_bits) + np.arange(len(at))] = 1
        high = np.packbits(bits, bitorder="little")
        per_byte = np.bitwise_count(high).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(np.add.reduceat(per_byte, np.arange(0, len(high), BLOCK)))[:-1]])
        return cls(len(at) - 1, low_bits, low.tobytes(), high.tobytes(), ones.astype("<u8").tobytes())

    def select(self, i: int) -> int:
        """The byte at which code point ``i`` begins; the end of the text for ``n``."""
        ones = np.frombuffer(self.ones, dtype="<u8")
        block = int(np.searchsorted(ones, i, side="right")) - 1
        part = np.frombuffer(self.high, dtype=np.uint8, offset=block * BLOCK, count=min(BLOCK, len(self.high) - block * BLOCK))
        place = block * BLOCK * 8 + int(np.flatnonzero(np.unpackbits(part, bitorder="little"))[i - int(ones[block])])
        begin = i * self.low_bits
        low = int.from_bytes(self.low[begin // 8 : (begin + self.low_bits + 7) // 8], "little") >> begin % 8
        return ((place - i) << self.low_bits) | (low & ((1 << self.low_bits) - 1))
