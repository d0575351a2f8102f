"""First bits of the md5 of many short numbered keys at once, as numpy arrays inside a task."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Longest key of one block of md5.
ONE_BLOCK = 55
#: Keys that are hashed at once.
AT_ONCE = 16_384


def _words(block: list[np.ndarray], shape: tuple[int, ...]) -> list[np.ndarray]:
    """The md5 of one-block messages as four numbers of 8 hex digits; ``block``: 16 words that broadcast to ``shape``."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, high = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        k = i // 16
        if k == 0:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif k == 1:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif k == 2:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = (7 * i) % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += block[g] + np.uint32(_SINES[i])
        s = _SHIFTS[k][i % 4]
        np.right_shift(f, np.uint32(32 - s), out=high)
        f <<= np.uint32(s)
        f |= high
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [(x + np.uint32(start)).byteswap() for x, start in zip((a, b, c, d), _START, strict=True)]


def numbered(heads: list[bytes], numbers: list[np.ndarray], wide: bool = False) -> list[np.ndarray]:
    """First 32 bits (``wide``: 64) of md5(head + decimal number), for each head and its array of numbers.

    Keys of many heads are hashed together; those that need several blocks go through hashlib."""
    n = np.array([len(x) for x in numbers], np.int64)
    flat = np.concatenate([np.empty(0, np.int64), *(x.astype(np.int64) for x in numbers)])
    out = np.empty(len(flat), np.uint64 if wide else np.uint32)
    cuts = np.cumsum(n)[:-1]
    if not len(flat):
        return np.split(out, cuts)
    values, at = np.unique(flat, return_inverse=True)
    texts = np.array([str(x).encode() for x in values.tolist()])
    digits = np.char.str_len(texts)
    letters = texts.view(np.uint8).reshape(len(texts), -1)
    sizes, of = np.array([len(x) for x in heads]), np.repeat(np.arange(len(heads)), n)
    for size in np.unique(sizes).tolist():
        these = np.flatnonzero(sizes == size)
        where = np.flatnonzero(sizes[of] == size)
        if size + int(digits.max()) > ONE_BLOCK:
            made = b"".join([hashlib.md5(heads[i] + texts[j]).digest()[:8] for i, j in zip(of[where].tolist(), at[where].tolist(), strict=True)])
            made = np.frombuffer(made, ">u8")
            out[where] = made if wide else made >> np.uint64(32)
            continue
        number = np.zeros((len(texts), 64), np.uint8)
        number[:, size : size + letters.shape[1]] = letters
        number[np.arange(len(texts)), size + digits] = 0x80
        number[:, 56], number[:, 57] = (size + digits) * 8 % 256, (size + digits) * 8 // 256
        number = np.ascontiguousarray(number.view("<u4").astype(np.uint32).T)
        head = np.zeros((len(these), 64), np.uint8)
        head[:, :size] = np.frombuffer(b"".join([heads[i] for i in these.tolist()]), np.uint8).reshape(len(these), size)
        head = np.ascontiguousarray(head.view("<u4").astype(np.uint32).T)
        place = np.zeros(len(heads), np.int64)
        place[these] = np.arange(len(these))
        has = [(bool(head[w].any()), bool(number[w].any())) for w in range(16)]
        for k in range(0, len(where), AT_ONCE):
            some = where[k : k + AT_ONCE]
            h, v = place[of[some]], at[some]
            zero = np.zeros(1, np.uint32)
            block = [head[w][h] + number[w][v] if x and y else head[w][h] if x else number[w][v] if y else zero for w, (x, y) in enumerate(has)]
            a, b, *_ = _words(block, (len(some),))
            out[some] = (a.astype(np.uint64) << np.uint64(32)) | b if wide else a
    return np.split(out, cuts)


def first_words(head: bytes, tails: list[bytes], n: int) -> Iterator[tuple[int, slice, np.ndarray]]:
    """First 32 bits of md5(head + decimal r + tail) for 0 ≤ r < n and every tail, all of one length.

    Yields (first r, slice of the tails, array of tails by r).  Numbers of one length are hashed together; keys that
    need several blocks go through hashlib."""
    size = len(tails[0])
    for digits in range(1, len(str(max(n - 1, 0))) + 1):
        low, high = 10 ** (digits - 1) if digits > 1 else 0, min(10**digits, n)
        total = len(head) + digits + size
        step = max(1, AT_ONCE // (high - low))
        if total > ONE_BLOCK:
            for i, tail in enumerate(tails):
                made = (hashlib.md5(head + str(r).encode() + tail).digest()[:4] for r in range(low, high))
                yield low, slice(i, i + 1), np.frombuffer(b"".join(made), ">u4").astype(np.uint32).reshape(1, -1)
            continue
        # bytes of the number, the rest being zero, and of the key around it: they are added word by word
        number = np.zeros((high - low, 64), np.uint8)
        r = np.arange(low, high)
        for j in range(digits):
            number[:, len(head) + j] = r // 10 ** (digits - 1 - j) % 10 + ord("0")
        number = number.view("<u4").astype(np.uint32)
        around = np.zeros((len(tails), 64), np.uint8)
        around[:, : len(head)] = np.frombuffer(head, np.uint8)
        around[:, len(head) + digits : total] = np.frombuffer(b"".join(tails), np.uint8).reshape(len(tails), size)
        around[:, total] = 0x80
        around[:, 56:58] = (total * 8 % 256, total * 8 // 256)
        around = around.view("<u4").astype(np.uint32)
        moves = [bool(number[:, k].any()) for k in range(16)]
        for at in range(0, len(tails), step):
            rows = slice(at, min(at + step, len(tails)))
            block = [around[rows, k : k + 1] + number[None, :, k] if moves[k] else around[rows, k : k + 1] for k in range(16)]
            yield low, rows, _words(block, (rows.stop - at, high - low))[0]
