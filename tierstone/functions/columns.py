"""Column helpers: text typing, content hashes, stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the URL namespace of RFC 4122 name-based ids.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(""))


def typed(c: str | Column, to: str) -> Column:
    """Landed text to a type: blank means null, anything unreadable raises."""
    return blank_to_null(c).cast(to)


def clean_email(c: str | Column) -> Column:
    return F.lower(F.trim(col(c)))


def checksum16(c: str | Column) -> Column:
    """First 16 hex digits of the SHA-256 of the UTF-8 text."""
    return F.left(F.sha2(col(c), 256), F.lit(16))


def uuid5_url(c: str | Column) -> Column:
    """Name-based (version 5) id of a text in the URL namespace, built-ins only."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(col(c), "UTF-8")))
    # version digit is 5; the variant digit keeps two bits and gets 10 on top
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double; null, not an error, over zero or nothing."""
    bottom = denominator.cast("double")
    return F.when(bottom != 0, numerator.cast("double") / bottom)


def exact_mean(c: str | Column) -> Column:
    """Mean of a decimal column from its exact sum (avg() cuts decimals to 6 digits)."""
    return ratio(F.sum(col(c)), F.count(col(c)))


def hours_between(start: str | Column, end: str | Column) -> Column:
    return (F.unix_micros(col(end)) - F.unix_micros(col(start))) / F.lit(3.6e9)


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return (F.unix_micros(col(end)) - F.unix_micros(col(start))) / F.lit(1e6)


def whole_days_between(start: str | Column, end: str | Column) -> Column:
    """Full days from start to end, cut toward zero (47 h is 1, -25 h is -1)."""
    return F.extract(F.lit("DAY"), col(end) - col(start)).cast("int")


def second_text(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss")
