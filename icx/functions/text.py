"""Python-compatible text primitives as native column expressions.

Python's `str.split()` / `str.strip()` use Unicode white space, which neither Java's
`\\s` nor Spark's `trim` matches. The class below lists the code points Python treats
as white space; written with `\\x{..}` escapes it is valid both for Java regexes and
for RE2, so SQL oracles use the very same string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points for which Python's str.isspace() is true.
WS_CLASS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
WS_RUN = WS_CLASS + "+"
WS_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
STRIP_RE = "^" + WS_RUN + "|" + WS_RUN + "$"


def words(text: Column) -> Column:
    """`text.split()`: white-space separated tokens, no empty items."""
    return F.filter(F.split(text, WS_RUN), lambda w: w != F.lit(""))


def py_strip(text: Column) -> Column:
    """`text.strip()`; looks at the ends only."""
    return F.trim(text, F.lit(WS_CHARS))


def chars(text: Column) -> Column:
    """Code points of `text` as an array (empty text gives an empty array)."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def no_space(text: Column) -> Column:
    """`''.join(text.split())`."""
    return F.regexp_replace(text, WS_RUN, "")


def first_line(text: Column) -> Column:
    """`text.split("\\n")[0]`."""
    return F.substring_index(text, "\n", 1)


def basename(path: Column) -> Column:
    """`os.path.basename` for '/'-separated names."""
    return F.element_at(F.split(path, "/"), -1)
