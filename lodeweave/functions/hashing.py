"""Hashes of text as numbers, the same on every engine: exact integer arithmetic on SHA-1 digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(text: Column) -> Column:
    return F.sha1(text.cast("string").cast("binary"))


def unit_interval(text: Column) -> Column:
    """The SHA-1 of text as a fraction of 16^40, in [0, 1): 156 of its 160 bits, in three exact parts."""
    h = _digits(text)

    def part(at: int, bits: int) -> Column:
        return F.conv(F.substring(h, at, 13), 16, 10).cast("double") * F.lit(2.0**-bits)

    return part(1, 52) + part(14, 104) + part(27, 156)


def bucket(text: Column, buckets: int) -> Column:
    """The SHA-1 of text modulo `buckets` (below 2^23), by Horner's rule over four parts of ten digits."""
    h = _digits(text)
    out = F.lit(0).cast("long")
    for at in (1, 11, 21, 31):
        out = (out * F.lit((1 << 40) % buckets) + F.conv(F.substring(h, at, 10), 16, 10).cast("long")) % F.lit(buckets)
    return out


def draw(seed: int, what: str, *parts) -> Column:
    """A uniform draw in (0, 1) for what is named: half a step above 52 bits of the SHA-1 of `seed:what:part:part`.

    It depends on nothing but the names, so every engine, partitioning and rerun draws alike. A null part is left out.
    """
    named = [F.lit(str(seed)), F.lit(what), *[(p if isinstance(p, Column) else F.col(p)).cast("string") for p in parts]]
    return (F.conv(F.substring(_digits(F.concat_ws(":", *named)), 1, 13), 16, 10).cast("double") + 0.5) * F.lit(2.0**-52)


def draw_sql(seed: int, what: str, *parts: str) -> str:
    """`draw` in the SQL that queries are held against; parts are SQL expressions."""
    return f"((('0x' || substr(sha1(concat_ws(':', '{seed}', '{what}', {', '.join(parts)})), 1, 13))::BIGINT + 0.5e0) / 4503599627370496e0)"
