"""Word style sheets, compiled help, comics and scanned books: literal cases."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.operators import chm, comic, docx, layout

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_styles(spark):
    sheet = f"""<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="24"/></w:rPr></w:rPrDefault><w:pPrDefault><w:pPr><w:jc w:val="both"/></w:pPr></w:pPrDefault></w:docDefaults>
<w:style w:styleId="a" w:type="paragraph"><w:pPr><w:spacing w:line="1" w:before="2"/><w:ind w:left="3"/></w:pPr><w:rPr><w:b/><w:u w:val="none"/><w:rFonts w:hAnsi="Arial"/></w:rPr></w:style>
<w:style w:styleId="b" w:type="character"><w:basedOn w:val="a"/><w:pPr><w:spacing w:after="9"/><w:numPr><w:numId w:val="4"/></w:numPr></w:pPr><w:rPr><w:b w:val="false"/><w:color/></w:rPr></w:style>
<w:style w:styleId="c" w:type="table"><w:basedOn w:val="d"/><w:rPr><w:i/></w:rPr></w:style><w:style w:styleId="d"><w:basedOn w:val="c"/><w:rPr><w:strike w:val="0"/></w:rPr></w:style>
<w:style w:type="paragraph"/><w:style w:styleId="e" w:type="paragraph"><w:basedOn w:val="gone"/></w:style><w:style w:styleId="e" w:type="numbering"><w:basedOn w:val="e"/></w:style></w:styles>"""
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr(docx.SHEET, sheet)
    rows = [(1, packed.getvalue()), (2, b"PK broken"), (3, b"<no"), (4, None), (5, f"<w:styles {W}/>".encode()), (6, sheet.encode())]
    df = docx.sheets(spark.createDataFrame([(i, None if c is None else bytearray(c), "clash") for i, c in rows], "i int, content binary, styles string"))
    got = {r.i: r for r in df.select("i", "docx.*", docx.resolved(F.col("docx.styles")).alias("r"), docx.style_of(docx.resolved(F.col("docx.styles")), F.lit("zz")).alias("z"), docx.merged_run(F.col("docx.default_run"), F.get("docx.styles", F.lit(0))["run"]).alias("m")).collect()}
    assert got[1].r == got[6].r and got[1].default_run.font_size == "24" and got[1].default_paragraph.jc == "both"
    r = {s.id: s for s in got[1].r}
    assert list(r) == ["a", "b", "c", "d", "e"] and r["b"].type == "character" and r["e"].type == "numbering"
    assert (r["a"].run.bold, r["a"].run.underline, r["a"].run.font_family, r["b"].run.bold, r["b"].run.font_family, r["b"].run.color) == (True, False, "Arial", False, "Arial", "")
    assert (r["b"].paragraph.spacing.line, r["b"].paragraph.spacing.after, r["b"].paragraph.ind.left, r["b"].paragraph.num.num_id) == (None, "9", "3", "4")
    assert [(r[k].run.italic, r[k].run.strike) for k in "cd"] == [(True, False), (True, False)]
    assert got[1].z.type == "paragraph" and got[1].z.run is None and (got[1].m.font_size, got[1].m.bold) == ("24", True)
    assert "BadZipFile" in got[2].error and "ParseError" in got[3].error and got[4].r is None and got[4].error is None and got[5].r == []


@pytest.mark.parametrize("page, want", [
    ('<p>a</p><table><tr><td><a href="x"><img alt="Next page"></a><a href="y">t</a></td></tr></table>', "<p>a</p>"),
    ('<table><tr><td><a href="next.htm">t</a></td></tr><tr><td>2</td></tr></table>', '<table><tbody><tr><td><a href="next.htm">t</a></td></tr><tr><td>2</td></tr></tbody></table>'),
    ('<table><td>in &amp; <b>x</b></table>', "<div>in &amp; <b>x</b></div>"),
    ('<p>x<object><param></object><applet>y</applet><embed>z', "<p>xz</p>"),
    ("", ""), ("<div>" * 5000, None),
])
def test_cleaned(page, want):
    got = chm.cleaned(page)
    assert got.startswith("<html><head></head><body>")
    assert want is None or got == f"<html><head></head><body>{want}</body></html>"


def test_four_links_of_which_one_leads_on():
    link = '<a href="next"><img></a>' + '<a href="z">t</a>' * 3
    assert "<table>" in chm.cleaned(f"<p>a</p><table><tr><td>{link}</td></tr></table>")


def test_pictures(spark):
    files = spark.createDataFrame([(1, "a/b.png", b"AB"), (1, "a/b.png", b"AA"), (2, "x", b"C"), (1, "q.JPEG", b"J"), (None, "a/b.png", b"N")], "k int, path string, content binary")
    refs = [(1, "a/p.htm", "b.png"), (1, "a/p.htm", "../q.JPEG"), (1, "", "/q.JPEG"), (1, "a/p.htm", "data:x"), (1, "a/p.htm", None), (1, "a/p.htm", ""), (2, "", "./x"), (2, "a/p.htm", "b.png"), (None, "a/", "b.png"), (1, "a/p.htm", "b.png"), (1, "", "https://q.JPEG")]
    got = chm.pictures(spark.createDataFrame(refs, "k int, base string, src string"), files, "k").collect()
    assert sorted((str(r.k), str(r.base), str(r.src), str(r.uri)) for r in got) == sorted((str(k), b, str(s), str(u)) for (k, b, s), u in zip(refs, ["data:image/png;base64,QUE=", "data:image/jpeg;base64,Sg==", "data:image/jpeg;base64,Sg==", "data:x", None, "", f"data:{chm.OTHER};base64,Qw==", "b.png", "b.png", "data:image/png;base64,QUE=", "https://q.JPEG"], strict=True))


@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_pixels_of_all_filters(colour):
    r = np.random.default_rng(1)
    rows = r.integers(0, 256, (5, 7, comic.SAMPLES[colour]), dtype=np.uint8)
    assert (comic.pixels(comic.png(rows, colour))[0] == rows).all()
    n, above, lines = comic.SAMPLES[colour], np.zeros(7 * comic.SAMPLES[colour], int), []
    for kind, row in enumerate(rows.reshape(5, -1).astype(int)):
        left, upleft = np.concatenate([np.zeros(n, int), row[:-n]]), np.concatenate([np.zeros(n, int), above[:-n]])
        p = left + above - upleft
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - upleft)), left, np.where(abs(p - above) <= abs(p - upleft), above, upleft))
        guess = [0 * row, left, above, (left + above) // 2, near][kind]
        assert (comic._unfiltered(kind, ((row - guess) % 256).astype(np.uint8), above.astype(np.uint8), n) == row).all()
        above = row


def test_comic_pages(spark):
    wide, tall = comic.png(np.arange(6, dtype=np.uint8).reshape(2, 3, 1), 0), comic.png(np.zeros((2, 2, 1), np.uint8), 0)
    rows = [("k", 0, "a.b.png", tall), ("k", 1, "w.png", wide), ("k", 2, "bad.jpg", b"no"), ("k", 3, "v.png", wide), ("m", 0, "n.png", None), ("m", 1, "cut.png", wide[:50])]
    df = spark.createDataFrame([(*r[:3], None if r[3] is None else bytearray(r[3])) for r in rows], "book string, index int, name string, content binary")
    got = sorted((tuple(r) for r in comic.pages(df, "book", F.col("index") == 3).collect()), key=lambda r: (r[0], r[1]))
    assert [r[:4] for r in got] == [("k", 0, 0, "a.b.png"), ("k", 1, 1, "w_1.png"), ("k", 2, 2, "w_2.png"), ("k", 3, 2, "bad.jpg"), ("k", 4, 4, "v_1.png"), ("k", 5, 5, "v_2.png"), ("m", 0, 0, "n.png"), ("m", 1, 1, "cut.png")]
    assert [comic.pixels(bytes(got[i][4]))[0].tolist() for i in (1, 2, 4, 5)] == [[[[0]], [[3]]], [[[1], [2]], [[4], [5]]], [[[1], [2]], [[4], [5]]], [[[0]], [[3]]]]
    assert got[3][5] and got[7][5] and bytes(got[3][4]) == b"no" and got[0][5] is None
    assert comic.pages(df, "book", split=False).count() == 6


def test_scanned_books(spark):
    df = spark.createDataFrame([(1, 3, [("A", 2), ("", 0), (None, None)]), (2, 45, []), (3, 0, None), (4, 2, None)], "k int, n int, items array<struct<title:string,page_number:int>>")
    got = sorted(tuple(r) for r in layout.toc(df, "n", "items", "k").collect())
    assert got[:3] == [(1, 0, "djvu-toc-0", "A", 1), (1, 1, "djvu-toc-1", "2. fejezet", 0), (1, 2, "djvu-toc-2", "3. fejezet", 0)]
    assert [r[4] for r in got if r[0] == 2] == list(range(0, 45, 2)) and got[3][2:4] == ("djvu-toc-auto-0", "1. oldal") and {r[0] for r in got} == {1, 2, 4}
    assert sorted(tuple(r) for r in layout.page_range(df, "n", "k", first=2, last=3).where("k = 1").collect()) == [(1, 2), (1, 3)]
    pages = layout.page_range(df, "n", "k").where("k = 1").selectExpr("k", "page", "'u' AS url", "nullif('', '') AS text", "5 AS width", "7 AS height", "CASE WHEN page = 2 THEN 'x' END AS error")
    assert [tuple(r) for r in layout.page_rows(pages, "k").orderBy("index").collect()][:2] == [(1, 0, "1. oldal", "u", "", 5, 7), (1, 1, "2. oldal (Hiba)", None, "Hiba a(z) 2. oldal dekódolása során.", None, None)]
