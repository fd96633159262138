from pyspark.sql import functions as F

from vellumspark.operators import fb2

XML = """<?xml version="1.0" encoding="utf-8"?>
<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info>
<author><first-name> Ann </first-name></author><author><last-name>Lee</last-name></author><book-title>A book</book-title>
<coverpage><image l:href="#c"/></coverpage></title-info></description>
<body><p>lost</p><section><title><p>One</p></title><p>a &amp; <emphasis>b</emphasis></p><empty-line/>
<section><title><p>Inner</p></title><poem><stanza><v>x</v></stanza></poem></section><section><p>no title</p></section></section>
<section><image l:href="#none"/><epigraph><p>e</p></epigraph></section></body><body><section><p>second</p></section></body>
<binary id="c" content-type="image/png">AA
AA</binary></FictionBook>"""


def _of(spark, *texts, escaped=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    return fb2.books(df, F.lit("dir.x/some.FB2"), F.col("text"), escaped)


def test_sections(spark):
    found = _of(spark, XML)
    book = found.select("fb2.*").first()
    assert (book.title, book.author, book.cover, book.error) == ("A book", "Ann Lee", "data:image/png;base64,AAAA", None)
    assert [tuple(r)[1:] for r in fb2.sections(found, "k").orderBy("ord").collect()] == [
        (0, "cover", "Borító", '<img src="data:image/png;base64,AAAA" alt="Borító" />'),
        (1, "sec-1", "One", "<p>a & <em>b</em></p><div></div>"),
        (2, "sec-2", "One - Inner", "<div><div><em>x</em></div></div>"),
        (3, "sec-3", "4. Fejezet", "<p>no title</p>"),
        (4, "sec-4", "5. Fejezet", "<blockquote><p>e</p></blockquote>"),
    ]
    assert fb2.sections(_of(spark, XML, escaped=True), "k").where("ord = 1").first().html.startswith("<p>a &amp; <em>")


def test_edges(spark):
    """Null, empty, no sections, malformed, too deep, repeated rows."""
    deep = "<a>" * 5000 + "</a>" * 5000
    flat = "<FictionBook><body><p>only</p></body></FictionBook>"
    found = _of(spark, None, "", flat, "<body><section><title>T</title><p>x & y</section>", deep, flat)
    rows = {}
    for r in fb2.sections(found, "k").collect():
        rows.setdefault(r.k, []).append((r.id, r.title, r.html))
    assert rows == {
        1: [("sec-0", "dir.x/some", fb2.NOTICE)],
        2: [("sec-0", "dir.x/some", "<p>only</p>")],
        3: [("sec-0", "T", "<p>x & y</p>")],
        5: [("sec-0", "dir.x/some", "<p>only</p>")],
    }
    assert found.where("k = 4").first().fb2.error
    assert fb2.sections(_of(spark, XML).where("false"), "k").count() == 0
