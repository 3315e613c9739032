"""Counter-based randomness: a pure function of (seed, key), the same on any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def hash32(*parts) -> Column:
    """Unsigned 32-bit integer from the md5 of the ``:``-joined parts."""
    return F.conv(F.substring(F.md5(_text(parts)), 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """Uniform double in [0, 1)."""
    return hash32(*parts).cast("double") / F.lit(4294967296.0)


def hash60(*parts) -> Column:
    """Unsigned 60-bit integer: the first 15 hex digits of the md5 of the ``:``-joined parts."""
    return F.conv(F.substring(F.md5(_text(parts)), 1, 15), 16, 10).cast("long")


def index(n, *parts) -> Column:
    """Uniform integer in [0, n), for pools of any size."""
    return F.pmod(hash60(*parts), (n if isinstance(n, Column) else F.lit(n)).cast("long"))


def normal(*parts) -> Column:
    """Standard normal draw by Box-Muller on two keyed uniforms."""
    u1 = (hash32(*parts, "u1").cast("double") + 1.0) / F.lit(4294967297.0)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * uniform(*parts, "u2"))


def poisson1(*parts, kmax: int = 20) -> Column:
    """Poisson(1) draw by inverting the distribution function at a keyed uniform."""
    u, cdf, term, out = hash60(*parts).cast("double") / F.lit(2.0**60), 0.0, math.exp(-1.0), F.lit(0)
    for k in range(kmax):
        cdf += term
        term /= k + 1
        out = out + (u >= F.lit(cdf)).cast("int")
    return out


def row_seed(seed, *key) -> Column:
    """Per-row 63-bit seed: the first 15 hex digits of sha256 over (seed, key)."""
    return F.conv(F.substring(F.sha2(_text((seed, *key)), 256), 1, 15), 16, 10).cast("long")


def fold_seed(*ints) -> Column:
    """Order-sensitive 31-bit seed of integers: xor, then multiply by the 64-bit FNV prime.

    Only the low half of the product reaches the result, so 32-bit arithmetic is exact.
    """
    # Low 32 bits of the 64-bit FNV offset basis and prime.
    basis, prime, low = 0x84222325, 0x1B3, F.lit(0xFFFFFFFF).cast("long")
    acc = F.lit(basis).cast("long")
    for v in ints:
        v = v if isinstance(v, Column) else F.lit(v)
        acc = (acc.bitwiseXOR(v.cast("long").bitwiseAND(low)) * F.lit(prime)).bitwiseAND(low)
    return acc.bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))


# Constants and rotations of md5 (RFC 1321).
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]


def _md5_head(words, n: int):
    """First two little-endian words of the md5 of ``n`` one-block messages; each of the 16 words is an array or a number."""
    import numpy as np

    start = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(n, v, np.uint32) for v in start)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(b, f, out=f)
            np.bitwise_xor(d, f, out=f)
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(d, f, out=f)
            np.bitwise_xor(c, f, out=f)
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            k = 7 * i % 16
            np.bitwise_not(d, out=f)
            np.bitwise_or(b, f, out=f)
            np.bitwise_xor(c, f, out=f)
        np.add(f, a, out=f)
        if isinstance(words[k], int):
            np.add(f, np.uint32((words[k] + _SINES[i]) % 2**32), out=f)
        else:
            np.add(f, words[k], out=f)
            np.add(f, np.uint32(_SINES[i]), out=f)
        np.left_shift(f, np.uint32(_TURNS[i]), out=g)
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)  # The old a is done with; it becomes the new b.
        a, b, c, d = d, a, b, c
    return a + start[0], b + start[1]


def hash60_range(head: str, n: int, digits: int = 5):
    """``hash60`` of ``head``:i for i from 0 to ``n`` - 1, as ``(first i, uint64 array)`` pieces of at most 10^``digits``.

    Numbers of one piece differ in their last digits only, so a piece is hashed at once by operations on arrays.
    """
    import numpy as np

    def message(text: bytes, size: int):
        """Words of the messages ``text`` followed by ``size`` digits, and these digits' words by place."""
        length = len(text) + size
        if length > 55:
            raise ValueError("the text is too long for one md5 block")
        block = bytearray(text + b"0" * size + b"\x80" + bytes(55 - length) + (8 * length).to_bytes(8, "little"))
        for j in range(len(text), length):
            block[j] = 0
        return [int.from_bytes(block[4 * w: 4 * w + 4], "little") for w in range(16)]

    tails = {}

    def tail(at: int, size: int):
        """Words that the digits of 0 to 10^``size`` - 1 fill when they begin at byte ``at``."""
        if (at, size) not in tails:
            i, out = np.arange(10**size), {}
            for j in range(size):
                digit = (48 + i // 10 ** (size - 1 - j) % 10).astype(np.uint32) << np.uint32(8 * ((at + j) % 4))
                w = (at + j) // 4
                out[w] = out[w] | digit if w in out else digit
            tails[at, size] = out
        return tails[at, size]

    def piece(text: bytes, size: int, lo: int, hi: int):
        words = message(text, size)
        for w, v in tail(len(text), size).items():
            words[w] = v[lo:hi] | np.uint32(words[w])
        a, b = (x.byteswap().astype(np.uint64) for x in _md5_head(words, hi - lo))
        return (a << np.uint64(28)) | (b >> np.uint64(4))

    text = f"{head}:".encode()
    for size in range(1, digits + 1):  # numbers of fewer digits
        lo, hi = (0 if size == 1 else 10 ** (size - 1)), min(10**size, n)
        if lo < hi:
            yield lo, piece(text, size, lo, hi)
    for first in range(10**digits, n, 10**digits):
        yield first, piece(text + str(first // 10**digits).encode(), digits, 0, min(10**digits, n - first))
