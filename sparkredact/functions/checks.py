"""Checksum and shape validators as Column expressions (JVM-side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def luhn_valid(value: Column) -> Column:
    """Luhn check over the digits of ``value`` (separators ignored)."""
    d = _digits(value)
    n = F.length(d)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda acc, i: acc + F.when(
            ((n - i) % 2) == 1,
            F.when(F.substring(d, i, 1).cast("int") * 2 > 9,
                   F.substring(d, i, 1).cast("int") * 2 - 9)
            .otherwise(F.substring(d, i, 1).cast("int") * 2),
        ).otherwise(F.substring(d, i, 1).cast("int")),
    )
    return (n >= 12) & ((total % 10) == 0)


def iban_valid(value: Column) -> Column:
    """ISO 13616 mod-97 check: move the first four characters to the end,
    letters count as two digits (A=10 .. Z=35), remainder must be 1."""
    s = F.upper(F.regexp_replace(value, r"\s", ""))
    r = F.concat(F.substring(s, 5, 1 << 20), F.substring(s, 1, 4))
    rem = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(r), F.lit(1))),
        F.lit(0).cast("bigint"),
        lambda acc, i: F.when(
            F.substring(r, i, 1).rlike("[0-9]"),
            (acc * 10 + F.substring(r, i, 1).cast("bigint")) % 97,
        ).otherwise((acc * 100 + F.ascii(F.substring(r, i, 1)) - 55) % 97),
    )
    return (F.length(s) >= 15) & s.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (rem == 1)


def ipv4_valid(value: Column) -> Column:
    """Every dotted octet is at most 255."""
    return F.forall(F.split(value, r"\."), lambda x: x.cast("int") <= 255)


def dea_valid(value: Column) -> Column:
    """Check digit of a two-letter, seven-digit licence number:
    (d1 + d3 + d5) + 2 * (d2 + d4 + d6) ends in d7."""
    def d(k: int) -> Column:
        return F.substring(value, 2 + k, 1).cast("int")
    return ((d(1) + d(3) + d(5) + 2 * (d(2) + d(4) + d(6))) % 10) == d(7)
