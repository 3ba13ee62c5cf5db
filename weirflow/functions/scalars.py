"""Scalar expressions that several operators share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without whitespace of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def ordered(column: str, descending: bool = False, nulls_last: bool = False) -> Column:
    """A sort key with its null place spelled out: first unless asked otherwise, either way."""
    c = F.col(column)
    if descending:
        return c.desc_nulls_last() if nulls_last else c.desc_nulls_first()
    return c.asc_nulls_last() if nulls_last else c.asc_nulls_first()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if either has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    """Logistic function that overflows on neither side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def utc_date(ms: Column) -> Column:
    """The UTC date of epoch milliseconds as ISO text, whatever the session's zone."""
    days = F.floor(ms / 86_400_000).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")


def all_equal(names: Sequence[str], prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + n) for n in names])


def bind(col: Column, f) -> Column:
    """f of a column that is evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(col), f), F.lit(0))


def _limbs(x: Column) -> list[Column]:
    """The four 16-bit parts of a long's bits, lowest first."""
    return [F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(4)]


def _of_limbs(sums: list[Column]) -> Column:
    """The long whose 16-bit parts are these sums, with what they carry over but for the last."""
    def carry(done: list[Column], over: Column, rest: list[Column]) -> Column:
        if not rest:
            return reduce(Column.bitwiseOR, done)
        place = 16 * len(done)
        return bind(rest[0] + over, lambda c: carry(
            [*done, F.shiftleft(c.bitwiseAND(F.lit(0xFFFF).cast("long")), place)], F.shiftright(c, 16), rest[1:]
        ))

    return carry([], F.lit(0).cast("long"), sums)


def wrapping_add(x: Column, n: int) -> Column:
    """x + n modulo 2 ** 64, where Spark's own sum raises."""
    return _of_limbs([a + F.lit(n >> 16 * i & 0xFFFF).cast("long") for i, a in enumerate(_limbs(x))])


def wrapping_multiply(x: Column, n: int) -> Column:
    """x * n modulo 2 ** 64, where Spark's own product raises."""
    a, b = _limbs(x), [F.lit(n >> 16 * i & 0xFFFF).cast("long") for i in range(4)]
    return _of_limbs([reduce(Column.__add__, [a[i] * b[k - i] for i in range(k + 1)]) for k in range(4)])


def splitmix64(x: Column) -> Column:
    """The published 64-bit mixer: the constants are fixed values."""
    def step(v: Column, shift: int, factor: int) -> Column:
        return bind(v, lambda y: wrapping_multiply(y.bitwiseXOR(F.shiftrightunsigned(y, shift)), factor))

    mixed = step(step(wrapping_add(x, 0x9E3779B97F4A7C15), 30, 0xBF58476D1CE4E5B9), 27, 0x94D049BB133111EB)
    return bind(mixed, lambda y: y.bitwiseXOR(F.shiftrightunsigned(y, 31)))
