"""Text rules of the formats: one white-space class for all operators, and names without extension."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of the formats' own rules (tab to CR, space, no-break and Unicode spaces, U+FEFF), as
# Java and RE2 write it, and as Python does.
SPACE = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_SPACE = "[\\t-\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
_RUN = re.compile(f"{_SPACE}+")
_ENDS = re.compile(f"^{_SPACE}+|{_SPACE}+$")


def collapsed(text: str) -> str:
    return trimmed(_RUN.sub(" ", text))


def trimmed(text: str) -> str:
    return _ENDS.sub("", text)


def trim(text: Column | str) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"\.[^/.]+$", "")


def arrow_function(kind: str):
    """A pandas function as a column function of the type; made when first used, as types need a session. It counts as
    nondeterministic, so that the optimizer doesn't run it a second time for a filter or another column."""

    def of(function):
        return lambda *columns: F.pandas_udf(function, kind).asNondeterministic()(*columns)

    return of
