"""Unsigned 64-bit helpers as built-in column expressions (no UDF, no ANSI overflow)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the hash: multiplier, increment, second multiplier.
HASH_MULTIPLIER_1 = 3935559000370003845
HASH_INCREMENT = 2691343689449507681
HASH_MULTIPLIER_2 = 4768777513237032717

_LIMB = 0xFFFF


def _limbs(value: int) -> list[int]:
    return [value >> s & _LIMB for s in (0, 16, 32, 48)]


def wrapping_multiply_add(x: Column, factor: int, addend: int = 0) -> Column:
    """``x * factor + addend`` modulo 2**64, in a bigint's 64 bits.

    Schoolbook multiplication on 16-bit limbs: no partial sum reaches 2**36, so
    nothing overflows under ANSI rules, and the whole is one codegen expression.
    """
    f, a = _limbs(factor), _limbs(addend)
    limbs = [F.shiftrightunsigned(x, s).bitwiseAND(F.lit(_LIMB)) for s in (0, 16, 32, 48)]
    carry, out = F.lit(0).cast("bigint"), None
    for k in range(4):
        total = carry + F.lit(a[k])
        for i in range(k + 1):
            total = total + limbs[i] * F.lit(f[k - i]).cast("bigint")
        low = F.shiftleft(total.bitwiseAND(F.lit(_LIMB)), 16 * k)
        out = low if out is None else out.bitwiseOR(low)
        carry = F.shiftrightunsigned(total, 16)
    return out


def ranhash(x: Column) -> Column:
    """The 64-bit multiply-add-xorshift hash; a bigint holding the unsigned result's bits."""
    from functools import reduce

    right = lambda h, n: h.bitwiseXOR(F.shiftrightunsigned(h, n))
    left = lambda h, n: h.bitwiseXOR(F.shiftleft(h, n))
    # Each step is bound as a one-element array, so that its value is computed once.
    steps = [
        lambda h: wrapping_multiply_add(h, HASH_MULTIPLIER_1, HASH_INCREMENT),
        lambda h: right(h, 21),
        lambda h: left(h, 37),
        lambda h: right(h, 4),
        lambda h: wrapping_multiply_add(h, HASH_MULTIPLIER_2),
        lambda h: left(h, 20),
        lambda h: right(h, 41),
        lambda h: left(h, 5),
    ]
    return reduce(lambda h, step: F.transform(h, step), steps, F.array(x.cast("bigint")))[0]


def unsigned_mod_pow2(x: Column, bits: int) -> Column:
    """An unsigned 64-bit value modulo 2**bits (``bits`` up to 62)."""
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def pow2(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int"))


def nth_bit(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n).bitwiseAND(F.lit(1))


def low_bits(x: Column, n: int) -> Column:
    return x.bitwiseAND(F.lit((1 << n) - 1))


def pow2_at_least(x: Column) -> Column:
    """The smallest power of two that is ``x`` or more; 1 for 0."""
    x = x.cast("bigint")
    return F.when(x <= 1, F.lit(1).cast("bigint")).otherwise(pow2(F.length(F.bin(x - 1))))
