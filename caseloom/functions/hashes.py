"""Hashed draws of many keys at once, equal to :func:`caseloom.functions.distributions.uniform`."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().tolist()
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_WORDS = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
#: a message of one MD5 block has at most this many bytes
_BLOCK = 55


def md5_heads(words: np.ndarray) -> np.ndarray:
    """The first 52 bits of the MD5 of one-block messages, given as (16, n) words."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(words.shape[1], x) for x in start)
    for i in range(64):
        if i < 16:
            f = d ^ (b & (c ^ d))
        elif i < 32:
            f = c ^ (d & (b ^ c))
        elif i < 48:
            f = b ^ c ^ d
        else:
            f = c ^ (b | ~d)
        f += a
        f += words[_WORDS[i]]
        f += _SINES[i]
        turned = f << np.uint32(_SHIFTS[i])
        turned |= f >> np.uint32(32 - _SHIFTS[i])
        turned += b
        a, d, c, b = d, c, b, turned
    first, second = (a + start[0]).byteswap().astype(np.uint64), (b + start[1]).byteswap().astype(np.uint64)
    return first << np.uint64(20) | second >> np.uint64(12)


class Keys:
    """Keys that are hashed many times, each time with another ending."""

    def __init__(self, keys: list[bytes]) -> None:
        self.keys = keys
        self.size = np.array([len(k) for k in keys], dtype=np.int64)
        self.bytes = np.zeros((len(keys), 64), np.uint8)
        fits = [k if len(k) <= _BLOCK else b"" for k in keys]
        self.bytes[:, :56] = np.array(fits, dtype="S56").view(np.uint8).reshape(len(keys), 56)

    def uniform(self, who: np.ndarray, tail: bytes) -> np.ndarray:
        """Uniform in [0, 1) of the chosen keys, each followed by ``tail``."""
        size = self.size[who] + len(tail)
        block, row = self.bytes[who], np.arange(len(who))
        short = size <= _BLOCK
        at = np.where(short, self.size[who], 0)
        for j, byte in enumerate((*tail, 0x80)):
            block[row, at + j] = byte
        block[:, 56:58] = (size * 8).astype("<u2").view(np.uint8).reshape(-1, 2)
        found = md5_heads(np.ascontiguousarray(block.view("<u4").T)).astype(float)
        for k in np.flatnonzero(~short).tolist():
            found[k] = int(hashlib.md5(self.keys[who[k]] + tail).hexdigest()[:13], 16)
        return found / float(16**13)
