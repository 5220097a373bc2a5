"""Packed bit vectors with constant-time counting and selection, in numpy."""

from __future__ import annotations

import numpy as np

#: Words of 64 bits under one entry of the directory.
BLOCK = 8


def _places() -> np.ndarray:
    """Row b holds the places of the set bits of the byte b, in order."""
    out = np.zeros((256, 8), np.uint8)
    for byte in range(256):
        ones = [k for k in range(8) if byte >> k & 1]
        out[byte, : len(ones)] = ones
    return out


PLACES = _places()


class BitVector:
    """``length`` bits in 64-bit words, and before every block of ``BLOCK`` words the number of ones so far.

    ``rank`` reads one entry of the directory and one block; ``select`` finds the block by bisection
    of the directory, then the word, the byte and the bit within it.  Both take whole arrays.
    """

    def __init__(self, bits: np.ndarray):
        self.length = len(bits)
        packed = np.packbits(bits, bitorder="little")
        width = 8 * BLOCK
        room = np.zeros((len(packed) // width + 1) * width, np.uint8)
        room[: len(packed)] = packed
        self.words = room.view("<u8")
        ones = np.bitwise_count(self.words).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        self.directory = np.concatenate([np.zeros(1, np.int64), np.cumsum(ones)])

    @property
    def ones(self) -> int:
        """The total popcount."""
        return int(self.directory[-1])

    def get(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place (0 to length)."""
        at = np.asarray(at, np.int64)
        word, block = at >> 6, (at >> 6) // BLOCK
        out = self.directory[block]
        for k in range(BLOCK - 1):
            step = block * BLOCK + k
            out = out + np.where(step < word, np.bitwise_count(self.words[step]), 0)
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(self.words[word] & below)

    def select(self, number: np.ndarray) -> np.ndarray:
        """Places of the ones of these numbers, counted from 0; each number is under ``ones``."""
        number = np.asarray(number, np.int64)
        block = np.searchsorted(self.directory, number, side="right") - 1
        left = number - self.directory[block]
        word = block * BLOCK
        inside = np.ones(len(number), bool)
        for k in range(BLOCK - 1):
            here = np.bitwise_count(self.words[block * BLOCK + k]).astype(np.int64)
            inside &= left >= here
            left = np.where(inside, left - here, left)
            word = np.where(inside, block * BLOCK + k + 1, word)
        value, at = self.words[word], word << 6
        inside = np.ones(len(number), bool)
        byte = value & np.uint64(255)
        for k in range(7):
            here = np.bitwise_count(byte).astype(np.int64)
            inside &= left >= here
            left = np.where(inside, left - here, left)
            at = np.where(inside, at + 8, at)
            byte = np.where(inside, (value >> np.uint64(8 * k + 8)) & np.uint64(255), byte)
        return at + PLACES[byte.astype(np.int64), left]
