"""Scalar functions as column expressions: nothing here leaves whole-stage codegen but decode_mask's array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 0xFFFFFFFF


def _long(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("bigint")


def radix_hash(key: Column, mask: int, shift: int) -> Column:
    """(key & mask) >> shift: the partition of a key by some of its bits."""
    return F.shiftright(_long(key).bitwiseAND(F.lit(mask).cast("bigint")), shift)


def sim_hash(key: Column, mod: int) -> Column:
    """The unsigned 32-bit key modulo `mod`."""
    return F.pmod(_long(key).bitwiseAND(F.lit(U32)), F.lit(mod).cast("bigint"))


def djb2(key: Column) -> Column:
    """h = 33 h + byte from 5381 over the key's four bytes, lowest first, kept to 32 bits."""
    h = F.lit(5381).cast("bigint")
    for i in range(4):
        h = h * 33 + F.shiftright(_long(key), 8 * i).bitwiseAND(F.lit(0xFF).cast("bigint"))
    return h.bitwiseAND(F.lit(U32))


def next_pow2(v: Column) -> Column:
    """The least power of two that is v or more (v in 1 .. 2^31), without floating point."""
    x = _long(v) - 1
    for s in (1, 2, 4, 8, 16):
        x = x.bitwiseOR(F.shiftright(x, s))
    return x + 1


def align(num: Column, width: int, word: int) -> Column:
    """num items of `width` bits, rounded up to whole words of `word` bits, in items."""
    per = word // width
    return (F.floor((_long(num) - 1) / per).cast("bigint") + 1) * per


def to_fixed(x: Column, bits: int) -> Column:
    """x * 2^bits, truncated toward zero."""
    return (x.cast("double") * float(1 << bits)).cast("bigint")


def from_fixed(x: Column, bits: int) -> Column:
    return _long(x) / float(1 << bits)


def min_plus(u: Column, w: Column, v: Column) -> Column:
    """The shorter of v and the way over u."""
    return F.least(u + w, v)


def high_low(u: Column, v: Column) -> tuple[Column, Column]:
    return F.greatest(u, v), F.least(u, v)


def mask_count(mask: Column) -> Column:
    """Set bits of an 8-bit mask."""
    return F.bit_count(_long(mask).bitwiseAND(F.lit(0xFF).cast("bigint")))


def decode_mask(mask: Column) -> Column:
    """Positions of the set bits of an 8-bit mask, from bit 0 on, packed by three bits."""
    m, packed = _long(mask), F.lit(0).cast("bigint")
    for bit in range(8):
        on = F.shiftright(m, bit).bitwiseAND(F.lit(1).cast("bigint"))
        place = F.call_function("shiftleft", F.lit(bit).cast("bigint"), 3 * mask_count(m.bitwiseAND(F.lit((1 << bit) - 1).cast("bigint"))))
        packed = packed + on * place
    return packed
