"""Hashed draws for whole ranges of numbers: MD5 of short texts, a column at a time."""

import numpy as np

BLOCK = 1 << 14  # numbers hashed together, so that the work columns stay in the cache

_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_ADDED = [int(abs(np.sin(i + 1)) * 2 ** 32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ORDER = (lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16)


def _md5_head(words: list, size: int) -> np.ndarray:
    """The first eight bytes, as a number, of the MD5 of one 64-byte block; a word is a column or the same number for all."""
    a, b, c, d = (np.full(size, v, dtype=np.uint32) for v in _START)
    f, g = np.empty(size, dtype=np.uint32), np.empty(size, dtype=np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f)
            f ^= d
        elif kind == 1:
            np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f)
            f ^= c
        elif kind == 2:
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
        else:
            np.bitwise_or(np.invert(d, out=f), b, out=f)
            f ^= c
        f += a
        word = words[_ORDER[kind](i)]
        if isinstance(word, np.ndarray):
            f += word
            word = 0
        f += np.uint32((word + _ADDED[i]) & 0xFFFFFFFF)
        turn = _TURNS[kind][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=g)
        np.left_shift(f, np.uint32(turn), out=f)
        f |= g
        f += b
        a, d, c, b, f = d, c, b, f, a
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()


def decimal_blocks(low: int, high: int):
    """(first number, digits) of the numbers from low up to high in blocks of one length; digits are columns of their signs."""
    while low < high:
        length = len(str(low))
        top = min(high, low + BLOCK, 10 ** length)
        left, digits = np.arange(low, top, dtype=np.uint64), []
        for _ in range(length):
            rest = left // np.uint64(10)
            digits.append((left - rest * np.uint64(10) + np.uint64(48)).astype(np.uint32))
            left = rest
        yield low, digits[::-1]
        low = top


def hashed_numbers(prefix: str, digits: list[np.ndarray]) -> np.ndarray:
    """First 15 hex digits, as numbers, of md5(prefix + decimal number) for a block of `decimal_blocks`."""
    head = prefix.encode()
    size = len(head) + len(digits)
    if size > 55:
        raise ValueError("the text is longer than one block")
    words: list = [0] * 16
    for place, sign in enumerate(head):
        words[place // 4] += sign << 8 * (place % 4)
    words[size // 4] += 0x80 << 8 * (size % 4)
    words[14] = 8 * size
    for place, column in enumerate(digits, len(head)):
        shifted = column << np.uint32(8 * (place % 4))
        base = words[place // 4]
        words[place // 4] = base + shifted if isinstance(base, np.ndarray) else shifted + np.uint32(base)
    return _md5_head(words, len(digits[0])) >> np.uint64(4)
