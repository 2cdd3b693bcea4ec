"""Draws by hash on arrays: what ``edits.draw(r, i, seed=seed)`` gives for many ``i`` at once."""

from __future__ import annotations

import math

import numpy as np

_TURN = (7, 12, 17, 22) * 4 + (5, 9, 14, 20) * 4 + (4, 11, 16, 23) * 4 + (6, 10, 15, 21) * 4
_ADD = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_FIRST = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_WORD = [k if k < 16 else (5 * k + 1) % 16 if k < 32 else (3 * k + 5) % 16 if k < 48 else 7 * k % 16 for k in range(64)]


def md5_heads(texts: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of each row of ``texts``, bytes of one length below 56."""
    n, size = texts.shape
    used = (size + 4) // 4
    block = np.zeros((n, 4 * used), np.uint8)
    block[:, :size], block[:, size] = texts, 0x80
    words = list(np.ascontiguousarray(block.view("<u4").T)) + [0] * (16 - used)
    if used < 15:
        words[14] = 8 * size
    a, b, c, d = (np.full(n, x, np.uint32) for x in _FIRST)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(64):
        if k < 16:
            np.bitwise_xor(d, np.bitwise_and(b, np.bitwise_xor(c, d, out=f), out=f), out=f)
        elif k < 32:
            np.bitwise_xor(c, np.bitwise_and(d, np.bitwise_xor(b, c, out=f), out=f), out=f)
        elif k < 48:
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
        else:
            np.bitwise_xor(c, np.bitwise_or(b, np.invert(d, out=f), out=f), out=f)
        f += a
        word = words[_WORD[k]]
        if isinstance(word, int):
            f += np.uint32((_ADD[k] + word) & 0xFFFFFFFF)
        else:
            f += np.uint32(_ADD[k])
            f += word
        np.right_shift(f, 32 - _TURN[k], out=g)
        np.left_shift(f, _TURN[k], out=a)
        a |= g
        a += b
        a, b, c, d = d, a, b, c
    return (a + np.uint32(_FIRST[0])).byteswap()


def draws(seed: int, r: int, first: int, end: int) -> np.ndarray:
    """``draw(r, i, seed=seed)`` for ``i`` from ``first`` to before ``end``."""
    out = []
    while first < end:  # numbers of as many digits
        digits = len(str(first))
        until = min(end, 10**digits)
        head = np.frombuffer(f"{seed}:{r}:".encode(), np.uint8)
        texts = np.empty((until - first, len(head) + digits), np.uint8)
        texts[:, : len(head)], rest = head, np.arange(first, until)
        for k in range(digits):
            texts[:, -1 - k] = 48 + rest % 10
            rest //= 10
        out.append(md5_heads(texts))
        first = until
    return np.concatenate(out) / 4294967296.0
