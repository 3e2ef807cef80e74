"""Integer parsing with Python `int()` semantics as Column expressions.

Decimal: optional sign, ASCII digits, single underscores between digit groups.
Hex: optional sign, optional 0x prefix, hex digits with single underscores.

``dec_text`` / ``hex_text`` give ``str(int(...))`` at any width: decimal text
follows from the digits alone; hex of up to 15 digits goes through a 64-bit
value, wider hex through base 10^9 limbs (only rows that need it evaluate
that branch).  ``lenient_int`` is a DECIMAL(38,0) for comparisons and
saturates beyond 37 digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC_RE = r"^[+-]?[0-9]+(_[0-9]+)*$"
HEX_RE = r"^[+-]?(0[xX]_?)?[0-9a-fA-F]+(_[0-9a-fA-F]+)*$"
INT_TYPE = "decimal(38,0)"
LIMB = 1_000_000_000


def _digits(v: Column) -> Column:
    """Decimal digits without sign, underscores and leading zeros."""
    return F.regexp_replace(F.regexp_replace(v, "^[+-]|_", ""), "^0+(?=.)", "")


def _hex_digits(v: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(v, "^[+-]", ""), "^0[xX]", "")
    return F.regexp_replace(F.regexp_replace(body, "_", ""), "^0+(?=.)", "")


def _signed(v: Column, digits: Column) -> Column:
    return F.when(v.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)


def _wide_hex(digits: Column) -> Column:
    """Decimal text of hex digits of any number."""
    padded = F.lpad(digits, F.length(digits) + F.pmod(-F.length(digits), F.lit(6)), "0")
    chunks = F.regexp_extract_all(padded, F.lit("(.{6})"), 1)
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out"))

    def step(limbs: Column, chunk: Column) -> Column:
        def limb(acc: Column, x: Column) -> Column:
            n = x * 16777216 + acc["carry"]
            return F.struct(F.floor(n / LIMB).cast("long").alias("carry"),
                            F.concat(acc["out"], F.array((n % LIMB).cast("long"))).alias("out"))
        first = F.struct(F.conv(chunk, 16, 10).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out"))
        done = F.aggregate(limbs, first, limb)
        return F.when(done["carry"] > 0, F.concat(done["out"], F.array(done["carry"]))).otherwise(done["out"])

    limbs = F.aggregate(chunks, start["out"], step)
    text = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    return F.regexp_replace(text, "^0+(?=.)", "")


def dec_text(v: Column) -> Column:
    """str(int(v)) for an already-stripped string; NULL when Python would raise."""
    return F.when(v.rlike(DEC_RE), _signed(v, _digits(v)))


def hex_text(v: Column) -> Column:
    """str(int(v, 16)) for an already-stripped string; NULL when Python would raise."""
    digits = _hex_digits(v)
    value = F.when(F.length(digits) <= 15, F.conv(digits, 16, 10)).otherwise(_wide_hex(digits))
    return F.when(v.rlike(HEX_RE), _signed(v, value))


def as_number(text: Column) -> Column:
    """Canonical integer text as DECIMAL(38,0), saturated beyond 37 digits."""
    top = F.lit("9" * 37).cast(INT_TYPE)
    return (F.when(F.length(text) <= 37, text.try_cast(INT_TYPE))
             .when(text.startswith("-"), -top).when(text.isNotNull(), top))


def parse_dec(v: Column) -> Column:
    """int(v) as DECIMAL(38,0), saturated; NULL when Python would raise."""
    return as_number(dec_text(v))


def parse_hex(v: Column) -> Column:
    return as_number(hex_text(v))


def lenient_text(v: Column) -> Column:
    """Decimal first, then hex, else NULL (port columns), as canonical text."""
    return F.coalesce(dec_text(v), hex_text(v))


def lenient_int(v: Column) -> Column:
    """The number of ``lenient_text``, for comparisons."""
    return as_number(lenient_text(v))
