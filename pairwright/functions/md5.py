"""MD5 of many short texts that end alike, in numpy: whole blocks of numbers at once."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
#: Numbers of a block: those that differ in their last four digits alone. Shorter ranges are hashed one by one.
BLOCK, FEW = 10_000, 2_000
_DIGITS = np.array([b"%04d" % i for i in range(BLOCK)]).view(np.uint8).reshape(-1, 4).astype(np.uint32)


def _block(head: bytes, tail: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First two words of md5(head, four digits, tail) for all four digits; head and tail have at most 51 bytes."""
    size = len(head) + 4 + len(tail)
    text = np.zeros(64, np.uint32)
    text[: len(head)], text[len(head) + 4 : size], text[size] = list(head), list(tail), 128
    text[56], text[57] = 8 * size & 255, 8 * size >> 8
    words = (text.reshape(16, 4) << np.arange(0, 32, 8, dtype=np.uint32)).sum(axis=1).tolist()
    digits: dict[int, np.ndarray] = {}  # what they add to the words that they are in
    for j in range(4):
        k, at = divmod(len(head) + j, 4)
        x = _DIGITS[:, j] << np.uint32(8 * at)
        digits[k] = digits[k] + x if k in digits else x
    a, b, c, d = (np.full(BLOCK, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f = np.empty(BLOCK, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += np.uint32((_ADDED[i] + words[g]) & 0xFFFFFFFF)
        if g in digits:
            f += digits[g]
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=a)
        f <<= np.uint32(_TURNS[i])
        f |= a
        f += b
        a, b, c, d, f = d, f, b, c, a
    return a + np.uint32(0x67452301), b + np.uint32(0xEFCDAB89)


def first48(numbers: range, tail: bytes) -> Iterator[np.ndarray]:
    """The first 12 hex digits of md5(number, tail) as numbers, for a range of numbers from 0 up: in order, some at a time."""
    start, stop = numbers.start, numbers.stop
    while start < stop:
        head = start // BLOCK
        end = min(stop, (head + 1) * BLOCK)
        if not head or end - start < FEW:
            digests = b"".join([hashlib.md5(b"%d%s" % (i, tail)).digest() for i in range(start, end)])
            yield np.frombuffer(digests, np.uint8).reshape(-1, 16)[:, :6].astype(np.int64) @ (1 << np.arange(40, -8, -8, dtype=np.int64))
        else:
            a, b = (x[start - head * BLOCK : end - head * BLOCK].byteswap() for x in _block(b"%d" % head, tail))
            yield (a.astype(np.int64) << 16) | (b >> np.uint32(16)).astype(np.int64)
        start = end
