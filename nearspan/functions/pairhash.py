"""MD5 of pairs of numbers, 'a:b', for whole blocks of pairs: every step is one operation on arrays."""

from __future__ import annotations

import math

import numpy as np

_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_WORD = (lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


class Digits:
    """Numbers as the parts they have in the one block of 64 bytes that their pairs' texts fill."""

    def __init__(self, numbers: np.ndarray):
        texts = numbers.astype("S20")
        self.lengths = np.char.str_len(texts)
        self.bytes = texts.view("u1").reshape(len(numbers), 20)
        self._second: dict[int, np.ndarray] = {}

    def first(self, some: np.ndarray) -> np.ndarray:
        """(word, number): the text and a colon."""
        out = np.zeros((len(some), 64), "u1")
        out[:, :20] = self.bytes[some]
        out[np.arange(len(some)), self.lengths[some]] = ord(":")
        return np.ascontiguousarray(out.view("<u4").T)

    def second(self, some: np.ndarray, before: int) -> np.ndarray:
        """(word, number): the text after a first one of so many digits, the end mark and the length in bits."""
        if before not in self._second:
            out, n = np.zeros((len(self.lengths), 64), "u1"), np.arange(len(self.lengths))
            out[:, before + 1 : before + 21] = self.bytes
            out[n, before + 1 + self.lengths] = 0x80
            words = out.view("<u4")
            words[:, 14] = 8 * (before + 1 + self.lengths)
            self._second[before] = words
        return np.ascontiguousarray(self._second[before][some].T)


def md5_heads(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The first 32 bits, as a number, of the MD5 of every text of a first part (rows) and a second (columns)."""
    shape = first.shape[1], second.shape[1]
    words = {k: first[k][:, None] | second[k][None, :] for k in range(16) if first[k].any() or second[k].any()}
    a, b, c, d = (np.full(shape, x, "u4") for x in _START)
    t, u = np.empty(shape, "u4"), np.empty(shape, "u4")
    for i in range(61):  # what the last three steps change is not asked for
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        t += a
        t += np.uint32(_K[i])
        word = words.get(_WORD[turn](i))
        if word is not None:
            t += word
        left = _TURNS[turn][i % 4]
        np.left_shift(t, np.uint32(left), out=u)
        t >>= np.uint32(32 - left)
        t |= u
        t += b
        a, b, c, d, t = d, t, b, c, a
    return (b + np.uint32(_START[0])).byteswap()
