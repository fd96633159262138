"""Detection and decoding of text encodings.

What SQL can say is SQL (byte-order marks, declarations, labels); strict decoding runs in one Arrow function that
gives encoding, text and confidence together.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumspark.functions.text import arrow_function

#: Bytes or characters of a file in which a declaration is looked for.
LIMIT = 51_200

# Declarations, in the order in which they count, and other names of encodings.
DECLARATIONS = (
    r"(?i)<\?[^<>]+encoding\s*=\s*['\"]([-_a-z0-9]+)['\"][^<>]*>",
    r"(?i)<meta\s+charset=['\"]([-_a-z0-9]+)['\"][^<>]*>(?:\s*</meta>)?",
    r"(?i)<meta\s+[^<>]*?content\s*=\s*['\"][^'\"]*?charset=([-_a-z0-9]+)[^'\"]*?['\"][^<>]*>(?:\s*</meta>)?",
)
ALIASES = {
    "macintosh": "mac-roman",
    "x-sjis": "shift-jis",
    "mac-centraleurope": "cp1250",
    "gb2312": "gbk",
    "chinese": "gbk",
    "csiso58gb231280": "gbk",
    "euc-cn": "gbk",
    "euccn": "gbk",
    "eucgb2312-cn": "gbk",
    "gb2312-1980": "gbk",
    "gb2312-80": "gbk",
    "iso-ir-58": "gbk",
}
# The web's labels of each decoder, and Python's codec for it; bytes that a one-byte codec lacks stand for
# the same code point. `macintosh` has a label, but its alias has none, so it can't be decoded.
_LABELS = {
    "utf-8": "utf-8 utf8 unicode-1-1-utf-8 x-unicode20utf8",
    "cp1252": "windows-1252 cp1252 x-cp1252 iso-8859-1 iso8859-1 latin1 l1 ascii us-ascii ansi_x3.4-1968 iso-ir-100 cp819",
    "cp1250": "windows-1250 cp1250 x-cp1250",
    "cp1251": "windows-1251 cp1251 x-cp1251",
    "iso8859-2": "iso-8859-2 iso8859-2 latin2 l2 iso-ir-101",
    "iso8859-15": "iso-8859-15 iso8859-15 l9",
    "koi8-r": "koi8-r koi8 koi cskoi8r",
    "utf-16-le": "utf-16le utf-16 unicode ucs-2 iso-10646-ucs-2",
    "utf-16-be": "utf-16be unicodefffe",
    "cp932": "shift-jis shift_jis sjis x-sjis windows-31j ms_kanji ms932",
    "gb18030": "gbk gb18030 gb2312 gb_2312 gb_2312-80 chinese x-gbk csgb2312 iso-ir-58 csiso58gb231280",
    "cp949": "euc-kr ks_c_5601-1987 korean windows-949 ksc5601 iso-ir-149",
    "big5hkscs": "big5 big5-hkscs cn-big5 x-x-big5 csbig5",
    "euc_jp": "euc-jp x-euc-jp",
}
CODECS = {label: codec for codec, labels in _LABELS.items() for label in labels.split()}
_ONE_BYTE = {"cp1250", "cp1251", "cp1252", "iso8859-2", "iso8859-15", "koi8-r"}
_HINT, _AGAINST = frozenset(b"\xf5\xfb"), frozenset(b"\xe0\xe2\xe7\xeb\xef\xf1")


def bom(content: Column) -> Column:
    """Struct (encoding, strip) of the byte-order mark; null without one."""
    head = F.hex(F.substring(content, 1, 3))
    mark = lambda name, n: F.struct(F.lit(name).alias("encoding"), F.lit(n).alias("strip"))
    return F.when(head == "EFBBBF", mark("utf-8", 3)).when(head.startswith("FFFE"), mark("utf-16le", 2)).when(head.startswith("FEFF"), mark("utf-16be", 2))


def declared(text: Column) -> Column:
    """The declared encoding: of the first kind of declaration that occurs at all, lower-cased and by its main name."""
    head = F.substring(text, 1, LIMIT)
    label = F.lower(F.coalesce(*(F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in DECLARATIONS)))
    names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, label), label)


def stripped(text: Column) -> Column:
    """The text without the first declaration of each kind within the limit."""
    head, rest = F.substring(text, 1, LIMIT), F.substring(text, LIMIT + 1, 2147483647)
    for p in DECLARATIONS:
        head = F.regexp_replace(head, f"(?s)\\A(.*?){p}", "$1")
    return F.concat(head, rest)


def normalized(label: Column) -> Column:
    """A label by its main name; one that no decoder has is utf-8."""
    name = F.trim(F.translate(F.lower(label), "_", "-"))
    names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    name = F.coalesce(F.try_element_at(names, name), name)
    return F.when(name.isin("ascii"), F.lit("utf-8")).when(name.isin(*CODECS), name).otherwise(F.lit("utf-8"))


def decode(raw: bytes, label: str) -> str | None:
    """Strictly decoded text, without one leading mark; None if malformed or unknown."""
    codec = CODECS.get(label)
    if codec is None:
        return None
    if codec in _ONE_BYTE:
        try:
            return raw.decode(codec)
        except UnicodeDecodeError:
            table = [bytes((i,)).decode(codec, "replace") for i in range(256)]
            return "".join(chr(b) if table[b] == "�" else table[b] for b in raw)
    try:
        return raw.decode(codec).removeprefix("﻿")
    except UnicodeDecodeError:
        return None


MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))


def detect(raw: bytes, said: str | None) -> tuple[str, str, float]:
    """(encoding, text, confidence): the mark, then what is declared, then utf-8 or a one-byte encoding. Each must decode
    all bytes (behind a mark: all that follow it), or the next one counts."""
    for mark, label in MARKS:
        if raw.startswith(mark):
            if (text := decode(raw[len(mark) :], label)) is not None:
                return label, text, 1.0
            break
    if said and (text := decode(raw, said)) is not None:
        return said, text, 0.9
    seen = set(raw)
    if seen & _HINT and not seen & _AGAINST:
        return "windows-1250", decode(raw, "windows-1250"), 0.7
    text = decode(raw, "utf-8")
    return ("windows-1252", decode(raw, "windows-1252"), 0.7) if text is None else ("utf-8", text, 0.7)


def read(raw: bytes, said: str | None) -> str:
    """The text of a file: behind a mark with U+FFFD for what is malformed, else as detected."""
    for mark, label in MARKS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(CODECS[label], "replace").removeprefix("﻿")
    return detect(raw, said)[1]


@arrow_function("encoding string, text string, confidence double")
def _detected(content: pd.Series, said: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if c is None else detect(bytes(c), s) for c, s in zip(content, said, strict=True)]
    return pd.DataFrame(rows, columns=["encoding", "text", "confidence"])


def detected(content: Column) -> Column:
    """Struct (encoding, text, confidence) of bytes; null bytes give nulls."""
    said = declared(_ascii(content))
    return _detected(content, said)


@arrow_function("string")
def _read(content: pd.Series, said: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else read(bytes(c), s) for c, s in zip(content, said, strict=True)], dtype=object)


def text_of(content: Column, said: Column | None = None) -> Column:
    """The text of a file's bytes; ``said`` is what a declaration names, by default the one in the bytes."""
    return _read(content, declared(_ascii(content)) if said is None else said)


@arrow_function("string")
def _help_text(content: pd.Series) -> pd.Series:
    def one(raw: bytes) -> str:
        text = decode(raw, "utf-8")
        return decode(raw, "windows-1252") if text is None else text

    return pd.Series([None if c is None else one(bytes(c)) for c in content], dtype=object)


def help_text(content: Column) -> Column:
    """Text of a page of compiled help: utf-8 where that fits, else windows-1252, which fits all bytes."""
    return _help_text(content)


def _ascii(content: Column) -> Column:
    """The head of the bytes as text in which each byte is the character of its number."""
    return F.decode(F.substring(content, 1, LIMIT), "iso-8859-1")
