import pytest
from pyspark.sql import functions as F

from vellumspark.functions import encoding


@pytest.mark.parametrize("raw, want", [
    (b"\xef\xbb\xbfabc", ("utf-8", "abc", 1.0)), (b"\xff\xfea\0b\0", ("utf-16le", "ab", 1.0)), (b"\xfe\xff\0a", ("utf-16be", "a", 1.0)),
    (b"\xef\xbb\xbfa\xff", ("windows-1252", "ï»¿aÿ", 0.7)), (b"\xff\xfea", ("windows-1252", "ÿþa", 0.7)),  # malformed behind the mark
    (b"\xf5", ("windows-1250", "ő", 0.7)), (b"\xf5\xe9\xe0", ("windows-1252", "õéà", 0.7)), (b"caf\xe9", ("windows-1252", "café", 0.7)), (b"", ("utf-8", "", 0.7)),
])
def test_detect(raw, want):
    assert encoding.detect(raw, None) == want


def test_declarations(spark):
    rows = ['<?xml version="1.0" encoding="Chinese"?>', "<meta charset=utf-8>", '<meta charset="latin1"></meta>x', "<meta http-equiv='a' content='text/html; charset=X-SJIS'>", '<META CHARSET="mac-centraleurope">', "plain", '<meta charset="macintosh">', '<meta charset="a"><?xml encoding="b"?>', " " * 51200 + '<meta charset="utf-8">']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = df.select("i", encoding.declared(F.col("t")).alias("d"), encoding.stripped(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.d for r in got] == ["gbk", None, "latin1", "shift-jis", "cp1250", None, "mac-roman", "b", None]
    assert [r.s for r in got][:8] == ["", "<meta charset=utf-8>", "x", "", "", "plain", "", ""]
    assert got[8].s == rows[8]


def test_declared_bytes(spark):
    rows = [b'<meta charset="chinese">\xc4\xe3', b'<meta charset="macintosh">caf\xe9', b'<meta charset="x-sjis">\x82\xa0', b"\xef\xbb\xbfa\xff", None]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(rows)], "i int, b binary")
    got = df.select("i", encoding.detected(F.col("b")).alias("e"), encoding.text_of(F.col("b")).alias("t"), encoding.help_text(F.col("b")).alias("h")).orderBy("i").collect()
    assert [(r.e.encoding, (r.e.text or "")[-1:]) for r in got] == [("gbk", "你"), ("windows-1252", "é"), ("shift-jis", "あ"), ("windows-1252", "ÿ"), (None, "")]
    assert got[3].t == "a�" and got[4].t is None and got[1].h.endswith("café") and got[3].h == "ï»¿aÿ"


def test_normalized(spark):
    labels = {"UTF_8": "utf-8", " Shift_JIS ": "shift-jis", "ascii": "utf-8", "macintosh": "utf-8", "KS_C_5601-1987": "utf-8", "Latin1": "latin1", "nonsense": "utf-8", "chinese": "gbk"}
    df = spark.createDataFrame([(k,) for k in labels], "k string")
    assert {r.k: r.n for r in df.select("k", encoding.normalized(F.col("k")).alias("n")).collect()} == labels
