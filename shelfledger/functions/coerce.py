"""Request-value coercion: lenient number parsing and the three kinds of default.

All inputs are text columns taken from a request body. Nothing here raises on
dirty text, whatever the ANSI setting. Empty text is turned to NULL before a
cast, because a failing cast costs far more than a NULL one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters the reference's runtime treats as white space.
WHITESPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

_BIGGEST = (1 << 63) - 1
_INT = rf"^[{WHITESPACE}]*([+-]?(?:0[xX][0-9a-fA-F]+|\d+))"
_FLOAT = rf"^[{WHITESPACE}]*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"
# Whole texts that are numbers as they stand.
_PLAIN_INT = "^[0-9]{1,15}$"
_PLAIN_FLOAT = r"^[0-9]{1,15}(?:\.[0-9]{1,15})?$"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out a single time a row however often ``use`` names it.

    A column that is named several times is written out as often, which costs as
    many evaluations and makes methods too large for the JVM to compile.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def leading_int(text: Column) -> Column:
    """Integer at the start of the text (decimal or ``0x``), else NULL.

    A number that no BIGINT holds gives the nearest one, never NULL, so that it
    cannot pass for a missing one.
    """
    # Most numbers are plain; one pattern finds the token of others, and the rest works on a few characters.
    text = text.cast("string")

    def read(token: Column) -> Column:
        sign = F.when(token.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
        nearest = F.when(sign < 0, F.lit(-_BIGGEST - 1)).otherwise(F.lit(_BIGGEST))
        digits = F.ltrim(F.substring_index(token, "x", -1), F.lit("0"))
        from_hex = F.when(F.length(digits) <= 15, F.conv(F.substring_index(token, "x", -1), 16, 10).try_cast("bigint") * sign)
        decimal = F.coalesce(token.try_cast("bigint"), nearest)
        return F.when(token.contains("x"), from_hex.otherwise(nearest)).when(token != "", decimal)

    plain = F.when(text.rlike(_PLAIN_INT), text.try_cast("bigint"))
    # The mark is the only letter whose case matters.
    return F.coalesce(plain, once(F.translate(F.regexp_extract(text, _INT, 1), "X", "x"), read))


def leading_float(text: Column) -> Column:
    """Floating number at the start of the text, else NULL."""
    text = text.cast("string")
    plain = F.when(text.rlike(_PLAIN_FLOAT), text.try_cast("double"))
    token = F.regexp_extract(text, _FLOAT, 1)
    return F.coalesce(plain, once(token, lambda t: F.when(t != "", t.try_cast("double"))))


def int_or(text: Column, default: int | None) -> Column:
    """Leading integer; zero and unreadable text give the default."""
    return F.coalesce(F.nullif(leading_int(text), F.lit(0)), F.lit(default).cast("bigint"))


def float_or(text: Column, default: float | Column | None) -> Column:
    """Leading float; zero and unreadable text give the default."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(leading_float(text), F.lit(0.0)), fallback.cast("double"))


def text_or(text: Column, default: str | Column | None) -> Column:
    """Missing or empty text gives the default."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(empty_to_null(text), fallback)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def is_truthy(value: Column, kind: str = "string") -> Column:
    """Not missing, and not empty (text) or zero (number)."""
    blank = F.lit("") if kind == "string" else F.lit(0)
    return F.coalesce(value != blank, F.lit(False))


def given(rows: DataFrame, name: str) -> Column:
    """Whether a request value counts as given.

    A column ``<name>_type`` names the JSON type of the value (``string``,
    ``number`` or ``boolean``): the number 0 and false count as missing, the texts
    ``0`` and ``false`` do not. Without that column all values are text.
    """
    value = F.col(name)
    if f"{name}_type" not in rows.columns:
        return is_truthy(value)
    kind, number = F.col(f"{name}_type"), plain_number(value, "double")
    typed = (
        F.when(kind == "number", once(number, lambda x: (x != 0) & ~F.isnan(x)))
        .when(kind == "boolean", value == "true")
        .otherwise(value != "")
    )
    return F.coalesce(typed, F.lit(False))


def plain_number(text: Column, kind: str) -> Column:
    """The whole text as a number, else NULL."""
    return once(F.trim(text), lambda t: F.when(t != "", t.try_cast(kind)))


def as_text(value: Column) -> Column:
    return value.cast("string")


def array_json(values: Column) -> Column:
    """JSON text of a string array; a missing array is ``[]``."""
    return F.to_json(F.coalesce(values, F.array().cast("array<string>")))


def starts_within(text: Column, limit: float) -> Column:
    """Whether the number that the text starts with, if any, has a size within ``limit``."""
    text = text.cast("string")
    # A short text without exponent, hexadecimal mark or the word for no limit is within any limit of more digits.
    short = F.length(text) < len(str(int(limit)))
    for mark in "eExXI":
        short = short & ~text.contains(mark)
    size = F.abs(leading_float(text))
    long_hex = text.rlike(rf"^[{WHITESPACE}]*[+-]?0[xX]0*[0-9a-fA-F]{{{_hex_digits(limit)},}}")
    within = F.coalesce(size <= limit, F.lit(True)) & ~F.coalesce(long_hex, F.lit(False))
    return F.when(text.isNull() | short, F.lit(True)).otherwise(within)


def _hex_digits(limit: float) -> int:
    """Digits from which on a hexadecimal number is above ``limit``."""
    return len(f"{int(limit):x}") + 1
