"""MinHash signatures and their buckets, as column expressions and in plain Python for the planner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The coefficients of the signature's hash functions.
A = (1629905861, 1225010071, 324837614, 1166384513, 1883039818)
B = (708017477, 14444113, 2112273117, 1539134273, 779189906)
# The modulus, which is also the signature of an empty set, and the number of buckets.
MODULUS, BUCKETS = 2147483647, 1013
_GOLDEN = 0x9E3779B9
_TWO32 = 1 << 32


def wrap32(x: Column) -> Column:
    """A bigint as a wrapped signed 32-bit number."""
    return F.pmod(x + F.lit(1 << 31), F.lit(_TWO32)) - F.lit(1 << 31)


def hashed(x: Column, j: int) -> Column:
    """Hash function ``j`` of a bigint; the remainder keeps the sign."""
    return wrap32(wrap32(x) * F.lit(A[j]).cast("bigint") + F.lit(B[j])) % F.lit(MODULUS)


def signature(items: Column, size: int) -> Column:
    """The least hash of an array of bigint, by function; MODULUS for an empty array."""
    one = lambda j: F.coalesce(F.array_min(F.transform(items, lambda x: hashed(x, j))), F.lit(MODULUS).cast("bigint"))
    return F.array(*[one(j) for j in range(size)])


def signature_hash(sig: Column) -> Column:
    """The least entry that is not negative, MODULUS without one."""
    return F.coalesce(F.array_min(F.filter(sig, lambda s: s >= 0)), F.lit(MODULUS).cast("bigint"))


def bucket(sig: Column) -> Column:
    """The bucket of a signature of at most five entries."""
    step = lambda s, i: s.bitwiseXOR(F.pmod(i + F.lit(_GOLDEN), F.lit(_TWO32)) + F.shiftleft(s, 6) + F.shiftright(s, 2))
    return F.aggregate(sig, F.size(sig).cast("bigint"), step) % BUCKETS


def _wrap(x: int) -> int:
    return (x + (1 << 31)) % _TWO32 - (1 << 31)


def signature_of(items: list[int], size: int) -> tuple[int, ...]:
    """:func:`signature` of a Python list."""

    def h(x: int, j: int) -> int:
        v = _wrap(_wrap(x) * A[j] + B[j])
        return v % MODULUS if v >= 0 else -(-v % MODULUS)

    return tuple(min((h(x, j) for x in items), default=MODULUS) for j in range(size))


def bucket_of(sig: tuple[int, ...]) -> int:
    """:func:`bucket` of a Python tuple."""
    seed = len(sig)
    for i in sig:
        seed ^= (i + _GOLDEN) % _TWO32 + (seed << 6) + (seed >> 2)
    return seed % BUCKETS
