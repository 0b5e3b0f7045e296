"""Change positions as fixed-width bytes that compare in the order of the log.

A log numbers its changes with whole numbers, binary values, hex text (``0x0000002A00000D10``) or two
hex halves (``16/B374D848``). Text compares by its letters, and numbers without leading zeros wrongly so;
all become 16 bytes here, so that one comparison serves every log.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 16
HEX, HALVES = r"^[0-9A-Fa-f]{1,32}$", r"^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"
LOWEST = -(1 << 63)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def position(c: Column, kind: T.DataType) -> Column:
    """The position as 16 bytes; null stays null, and what cannot be read is an error, never a null."""
    if is_number(kind):
        # with the sign bit turned over, negative numbers come before the others
        raw = F.unhex(F.lpad(F.hex(c.cast("bigint").bitwiseXOR(F.lit(LOWEST).cast("bigint"))), 16, "0"))
    elif isinstance(kind, T.BinaryType):
        raw = F.when(F.length(c) <= WIDTH, c)
    elif isinstance(kind, T.StringType):
        plain = F.regexp_replace(F.trim(c), r"^(0[xX]|\\[xX])", "")
        halves = F.concat(*(F.lpad(F.split_part(plain, F.lit("/"), F.lit(i)), 8, "0") for i in (1, 2)))
        raw = F.unhex(F.when(plain.rlike(HALVES), halves).when(plain.rlike(HEX), plain))
    else:
        raise TypeError(f"a change position cannot be {kind.simpleString()}")
    failure = F.raise_error(F.concat(F.lit("not a change position: "), c.cast("string"))).cast("binary")
    return F.when(c.isNull(), F.lit(None)).when(raw.isNull(), failure).otherwise(F.lpad(raw, WIDTH, F.lit(b"\0")))


def bound(value: int | str | bytes, kind: T.DataType) -> Column:
    """A given position in the same form, to compare a column of this kind with."""
    if isinstance(value, (bytes, bytearray)):
        return position(F.lit(bytes(value)), T.BinaryType())
    return position(F.lit(int(value)), T.LongType()) if is_number(kind) else position(F.lit(value), T.StringType())
