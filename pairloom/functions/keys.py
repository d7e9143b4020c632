"""Pair keys and hashes as column expressions.

Hashes wrap at 64 bits. Spark's ANSI arithmetic raises on overflow, so products that can overflow are added up from 16-bit
parts, none of whose sums does; where they cannot (token ids below 2^31), long arithmetic is used directly. Both stay in
generated code. Null inputs give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers of the pair hash, and of the sketch hashes by depth.
MIX_A, MIX_B = 2654435761, 40503
SKETCH_A = (6364136223846793005, 3202034522624059733, 3935559000370003845)
SKETCH_B = (1442695040888963407, 2691343689449507681, 4768777513237032717)
SKETCH_SIGN = (2862933555777941757, 7046029254386353131, 3935559000370003845)
MOST_CANTOR_SUM = 3_037_000_498

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wrapping_sum(products: list[tuple[Column, int]], plus: int = 0) -> Column:
    """Sum of ``column * constant`` and of ``plus``, as 64-bit two's complement arithmetic wraps it.

    Each factor is cut into four parts of 16 bits; the parts of the sum of equal weight stay below 2^40, and what they
    carry is handed to the next.
    """
    low = 0xFFFF
    parts: list[Column] = [F.lit(plus >> 16 * k & low).cast("long") for k in range(4)]
    for column, constant in products:
        x = column.cast("long")
        own = [F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(low)) for k in range(4)]
        by = [constant >> 16 * k & low for k in range(4)]
        for i in range(4):
            for j in range(4 - i):
                if by[j]:
                    parts[i + j] = parts[i + j] + own[i] * F.lit(by[j]).cast("long")
    out, carry = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(4):
        total = parts[k] + carry
        out = out.bitwiseOR(F.shiftleft(total.bitwiseAND(F.lit(low)), 16 * k))
        carry = F.shiftright(total, 16)
    return out


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is evaluated once however often ``f`` uses it: code does not grow with nesting."""
    return F.transform(F.array(x), lambda v: f(v))[0]


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of longs."""
    return ((a - F.pmod(a, b)).cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast("long")


def _half(s: Column) -> Column:
    """``s (s + 1) / 2`` without a product beyond the result."""
    even = s % 2 == 0
    return F.when(even, F.shiftright(s, 1) * (s + 1)).otherwise(s * F.shiftright(s + 1, 1))


def spread(seed: int, *columns) -> Column:
    """32 hexadecimal digits that order rows at random, always the same for a seed: a digest that SQL has as well."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(c).cast("string") for c in columns]))


def fraction(digest) -> Column:
    """The first 48 bits of a digest as a number from 0 to 1."""
    return F.conv(F.left(_c(digest), F.lit(12)), 16, 10).cast("double") / float(1 << 48)


def pair_key(left, right, base: int) -> Column:
    """``left * base + right``; ``base`` is the size of the vocabulary, markers included."""
    return _c(left).cast("long") * F.lit(base).cast("long") + _c(right).cast("long")


def key_left(key, base: int) -> Column:
    return _div(_c(key).cast("long"), F.lit(base).cast("long"))


def key_right(key, base: int) -> Column:
    return F.pmod(_c(key), F.lit(base).cast("long"))


def pair_hash(left, right, buckets: int) -> Column:
    """Bucket of a pair of token ids below 2^31."""
    return F.abs(_c(left).cast("long") * F.lit(MIX_A) + _c(right).cast("long") * F.lit(MIX_B)) % F.lit(buckets).cast("long")


def ngram_hash(ids: list, buckets: int) -> Column:
    """Bucket of an n-gram: ``v = v * A + id * B + place`` over the ids, wrapping at 64 bits."""
    v = F.lit(0).cast("long")
    for place, x in enumerate(ids):
        step = lambda before, x=_c(x), place=place: wrapping_sum([(before, MIX_A), (x, MIX_B)], place)
        v = _once(v, step) if place else wrapping_sum([(_c(x), MIX_B)])
    return F.abs(v) % F.lit(buckets).cast("long")


def sketch_bucket(key, depth: int, width: int) -> Column:
    """Floor-modulus of the wrapped hash of ``key`` at ``depth``."""
    return F.pmod(wrapping_sum([(_c(key), SKETCH_A[depth])], SKETCH_B[depth]), F.lit(width).cast("long"))


def sketch_sign(key, depth: int) -> Column:
    """+1 where the low bit of the sign hash is set, else -1; the low bit needs no wide product."""
    low = _c(key).bitwiseAND(F.lit(1)).cast("int") * (SKETCH_SIGN[depth] & 1) + (SKETCH_B[depth] & 1)
    return (low % 2) * 2 - 1


def cantor_key(left, right) -> Column:
    """Pairing that does not depend on the vocabulary: ``s(s+1)/2 + right`` with ``s = left + right``.

    Null where an id is negative or the sum is beyond what a 64-bit key can hold.
    """
    a, b = _c(left).cast("long"), _c(right).cast("long")
    s = a + b
    return F.when((a >= 0) & (b >= 0) & (s <= F.lit(MOST_CANTOR_SUM)), _half(s) + b)


def cantor_sum(key) -> Column:
    """``left + right`` of a key; the square root of a double is corrected by one where it is off."""
    k = _c(key).cast("long")
    s = F.floor((F.sqrt(k.cast("double") * 8 + 1) - 1) / 2).cast("long")
    return F.when(_half(s) > k, s - 1).when(_half(s + 1) <= k, s + 1).otherwise(s)


def cantor_right(key) -> Column:
    k, s = _c(key).cast("long"), cantor_sum(key)
    return k - _half(s)


def cantor_left(key) -> Column:
    return cantor_sum(key) - cantor_right(key)
