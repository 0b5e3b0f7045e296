"""Text rules: trimming, null-like tokens, number parsing, file and column names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Null-like texts. The strict list is matched after trimming and lower-casing,
# the basic list exactly as written.
STRICT_NULLS = ["na", "n/a", "null", "none", "nan", "-", "", "undefined", "nil"]
BASIC_NULLS = ["NA", "N/A", "null", "NULL", "None", "none", "-", "", "undefined", "nil", "#N/A", "NaN"]

# Text patterns for the detected type of a column.
NUMBER_PATTERN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$|^\d{2}/\d{2}/\d{4}$"
DATETIME_PATTERN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"
BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0"]


# CSV as it is commonly written, with quotes doubled and line breaks inside quotes.
CSV = {
    "header": True, "encoding": "UTF-8", "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
# An empty text is written in quotes and a null as nothing, and both are read as such.
CSV_WRITE = CSV | {"emptyValue": '""', "nullValue": ""}
CSV_READ = CSV | {"emptyValue": "", "nullValue": "\0"}


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_null_token(c: Column, profile: str, trimmed: bool = False) -> Column:
    """True where the text stands for a missing value under the named profile.

    The byte length is known without reading the text, so long texts are not lower-cased.
    """
    if profile == "strict":
        c = c if trimmed else stripped(c)
        short = F.octet_length(c) <= max(len(t) for t in STRICT_NULLS)
        return short & F.lower(c).isin(STRICT_NULLS)
    if profile == "basic":
        return c.isin(BASIC_NULLS)
    raise ValueError(f"unknown cleaning profile: {profile}")


def looks_numeric(c: Column) -> Column:
    # the comparisons look at the first character only and spare most texts the pattern
    return (c >= "+") & (c < ":") & c.rlike(NUMBER_PATTERN)


def looks_numeric_sql(c: str) -> str:
    """The condition of ``looks_numeric`` as SQL text."""
    pattern = NUMBER_PATTERN.replace("\\", "\\\\")
    return f"({c} >= '+' and {c} < ':' and {c} rlike '{pattern}')"


def parsed_number(c: Column) -> Column:
    """The text as a double, or null where it is not written as a plain number."""
    return F.when(looks_numeric(c), c.try_cast("double"))


def table_name(filename: Column) -> Column:
    """View name for a file name: extension dropped, lower case, separators to underscores."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    plain = F.regexp_replace(F.regexp_replace(F.lower(stem), r"[-. ]", "_"), r"[^a-z0-9_]", "")
    return F.when(plain.rlike(r"^(\d|$)"), F.concat(F.lit("t_"), plain)).otherwise(plain)


def table_name_of(filename: str) -> str:
    """The rule of ``table_name`` for a single name known to the driver."""
    stem = filename.rsplit(".", 1)[0].lower()
    plain = re.sub(r"[^a-z0-9_]", "", re.sub(r"[-. ]", "_", stem))
    return f"t_{plain}" if not plain or plain[0].isdigit() else plain


def standard_identifier(name: Column) -> Column:
    """Plain identifiers in upper case, anything else in double quotes."""
    return F.when(name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.upper(name)).otherwise(
        F.concat(F.lit('"'), name, F.lit('"'))
    )


def standard_identifier_of(name: str) -> str:
    return name.upper() if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) else f'"{name}"'
