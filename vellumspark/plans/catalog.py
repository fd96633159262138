"""Named queries of the extraction engine, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import encoding
from vellumspark.functions.text import SPACE
from vellumspark.operators import chm, comic, docx, ereader, fb2, html, layout, palm
from vellumspark.plans import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").withColumn("name", F.concat(F.lit("page_"), F.col("page_id"), F.lit(".html")))


# The pages have one template: its list of links and its notice come before the only heading, so that it begins at line 6.
_HEADING = """regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)"""
_PLAIN = "replace(replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(160), ' ')"


@query(
    f"""SELECT page_id, 0 AS ord, 'html-h-0' AS id,
  trim(regexp_replace({_PLAIN.format(_HEADING)}, '{SPACE}+', ' ', 'g')) AS label, 1 AS level, 6 AS line_index
FROM pages"""
)
def html_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of every page."""
    return html.toc(html.books(_pages(spark, sf_dir), F.col("name"), F.col("html")), "page_id")


@query("SELECT page_id, 'page_' || page_id AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title of every page: the stem of its name."""
    return html.books(_pages(spark, sf_dir), F.col("name"), F.col("html")).select("page_id", "title")


@query("SELECT page_id, lower(regexp_extract(html, '(?i)<meta charset=\"([^\"]+)\"', 1)) AS encoding FROM pages")
def declared_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", encoding.declared(F.col("html")).alias("encoding"))


@query("SELECT page_id, regexp_replace(html, '(?i)<meta[^>]*charset[^>]*>', '') AS html FROM pages")
def strip_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", encoding.stripped(F.col("html")).alias("html"))


# Bytes of windows-1250 that another character than that of their number stands for; what has none stays.
_OF_1250 = {chr(i): encoding.decode(bytes((i,)), "windows-1250") for i in range(128, 256)}
_OF_1252 = {chr(i): encoding.decode(bytes((i,)), "windows-1252") for i in range(128, 256)}


def _one_byte_sql(table: dict[str, str]) -> str:
    other = {a: b for a, b in table.items() if a != b}
    return f"translate(text, '{''.join(other)}', '{''.join(other.values())}')"


@query(
    """SELECT doc_id, encoding, CASE encoding WHEN 'utf-8' THEN 'EFBBBF' WHEN 'utf-16le' THEN 'FFFE' WHEN 'utf-16be' THEN 'FEFF' END AS mark,
  CASE encoding WHEN 'utf-8' THEN 3 WHEN 'utf-16le' THEN 2 WHEN 'utf-16be' THEN 2 END::INT AS strip
FROM (SELECT doc_id, CASE WHEN text IS NOT NULL THEN CASE doc_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16le' WHEN 2 THEN 'utf-16be' END END AS encoding FROM documents)"""
)
def bom_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mark of every document written in one of four ways, one of which has none."""
    found = _written(_table(spark, sf_dir, "documents")).select("doc_id", encoding.bom(F.col("content")).alias("b"), "content")
    return found.select("doc_id", "b.encoding", F.hex(F.col("content").substr(F.lit(1), F.col("b.strip"))).alias("mark"), "b.strip")


def _written(docs: DataFrame) -> DataFrame:
    """content: three of four documents with a mark, the others as one byte a character."""
    kinds = [("EFBBBF", "utf-8"), ("FFFE", "utf-16le"), ("FEFF", "utf-16be")]
    raw = F.encode("text", "iso-8859-1")
    for k, (mark, name) in reversed(list(enumerate(kinds))):
        raw = F.when(F.col("doc_id") % 4 == k, F.concat(F.unhex(F.lit(mark)), F.encode("text", name))).otherwise(raw)
    return docs.withColumn("content", raw)


@query(
    f"""WITH t AS (SELECT doc_id, text, doc_id % 4 AS k, NOT regexp_matches(text, '[^\\x00-\\x7f]') AS ascii,
  regexp_matches(text, '[õû]') AND NOT regexp_matches(text, '[àâçëïñ]') AS east FROM documents)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN k = 0 THEN 'utf-8' WHEN k = 1 THEN 'utf-16le' WHEN k = 2 THEN 'utf-16be' WHEN east THEN 'windows-1250'
    WHEN ascii THEN 'utf-8' ELSE 'windows-1252' END AS encoding,
  CASE WHEN k < 3 THEN text WHEN east THEN {_one_byte_sql(_OF_1250)} WHEN ascii THEN text ELSE {_one_byte_sql(_OF_1252)} END AS text,
  CASE WHEN text IS NULL THEN NULL WHEN k < 3 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM t"""
)
def detect_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written with a mark (three kinds) or as one byte a character, detected and decoded. Of the last, õ and û make a
    document windows-1250, unless it holds à, â, ç, ë, ï or ñ."""
    return _written(_table(spark, sf_dir, "documents")).select("doc_id", encoding.detected(F.col("content")).alias("e")).select("doc_id", "e.encoding", "e.text", "e.confidence")


_PRE = "'<html><body><pre>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</pre></body></html>' AS html"


def _held(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", fixtures.container(kind, F.col("text")).alias("content"))


@query("SELECT doc_id, text FROM documents")
def tcr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir, "tcr").select("doc_id", palm.tcr_text("content").alias("text"))


@query(f"SELECT doc_id, {_PRE} FROM documents")
def palmdoc_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palm.texts(_held(spark, sf_dir, "palmdoc"), "doc_id")


@query(f"SELECT doc_id, {_PRE} FROM documents")
def ztxt_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palm.texts(_held(spark, sf_dir, "ztxt"), "doc_id")


@query(
    """WITH t AS (SELECT doc_id, greatest(1, (length(text) + 4095) // 4096) AS n, length(text) AS size FROM documents),
r AS (SELECT doc_id, n, size, unnest(range(n + 1)) AS idx FROM t)
SELECT doc_id, idx::INT AS idx, (78 + 8 * (n + 1) + CASE WHEN idx = 0 THEN 0 ELSE 16 + 4096 * (idx - 1) END)::BIGINT AS start,
  (78 + 8 * (n + 1) + CASE WHEN idx = 0 THEN 16 WHEN idx < n THEN 16 + 4096 * idx ELSE 16 + size END)::BIGINT AS next_start FROM r"""
)
def pdb_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palm.records(_held(spark, sf_dir, "raw"), "doc_id").select("doc_id", "idx", "start", "next_start")


@query(
    """WITH p AS (SELECT doc_id, n_chars % 60 AS n FROM documents), s AS (SELECT doc_id, n, greatest(1, n // 20) AS step FROM p WHERE n > 0),
e AS (SELECT doc_id, step, unnest(range(0, n, step)) AS i FROM s)
SELECT doc_id, (i // step)::INT AS ord, 'djvu-toc-auto-' || i AS id, (i + 1) || '. oldal' AS label, i::INT AS page_index FROM e"""
)
def djvu_auto_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.automatic_toc(_table(spark, sf_dir, "documents").withColumn("n", (F.col("n_chars") % 60).cast("int")), "n", "doc_id")


@query(
    """WITH p AS (SELECT doc_id, (n_chars % 97 + 1)::INT AS w, (n_chars % 53 + 1)::INT AS h, doc_id % 2 = 1 AS rtl FROM documents),
q AS (SELECT *, unnest(CASE WHEN w > h THEN [0, 1] ELSE [0] END) AS part FROM p)
SELECT doc_id, part::INT AS part, CASE WHEN w > h THEN 'p' || doc_id || '_' || (part + 1) || '.png' ELSE 'p' || doc_id || '.jpg' END AS page_name,
  (CASE WHEN w > h AND (part = 1) <> rtl THEN w // 2 ELSE 0 END)::INT AS x,
  (CASE WHEN w <= h THEN w WHEN (part = 1) <> rtl THEN w - w // 2 ELSE w // 2 END)::INT AS part_width FROM q"""
)
def comic_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("name", F.concat(F.lit("p"), F.col("doc_id"), F.lit(".jpg")))
    return layout.split_pages(docs, (F.col("n_chars") % 97 + 1).cast("int"), (F.col("n_chars") % 53 + 1).cast("int"), F.col("doc_id") % 2 == 1, "name", "doc_id")


@query(
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Part ' || doc_id END AS label, text FROM documents),
s AS (SELECT doc_id, 0 AS ord, CASE label WHEN '' THEN '1. Fejezet' ELSE label END AS title, '<p>' || text || '</p>' AS html FROM d
UNION ALL SELECT doc_id, 1, CASE label WHEN '' THEN 'Notes' ELSE label || ' - Notes' END, '<h3>' || doc_id || '</h3><p><em>end</em></p>' FROM d)
SELECT doc_id, ord, 'sec-' || ord AS id, title, html FROM s"""
)
def fb2_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every document written as a FictionBook file: its text, and a section inside it."""
    docs = _table(spark, sf_dir, "documents").withColumn("xml", fixtures.fiction_book(F.col("doc_id"), F.col("text")))
    return fb2.sections(fb2.books(docs, F.concat("doc_id", F.lit(".fb2")), F.col("xml")), "doc_id")


@query(
    """WITH RECURSIVE s AS (
  SELECT doc_id, i, 's' || i AS id, doc_id + i AS k, CASE WHEN i > 0 THEN 's' || (i - 1) WHEN doc_id % 7 = 0 THEN 's' || (doc_id % 5) WHEN doc_id % 7 = 1 THEN 'missing' END AS base
  FROM (SELECT doc_id, unnest(range(doc_id % 5 + 1)) AS i FROM documents)),
own AS (SELECT doc_id, id, base, CASE i % 2 WHEN 0 THEN 'paragraph' ELSE 'character' END AS type, CASE k % 3 WHEN 0 THEN false WHEN 1 THEN true END AS bold,
  CASE WHEN k % 4 = 0 THEN CAST(k % 40 AS VARCHAR) END AS font_size, CASE WHEN i % 2 = 1 THEN 'j' || i END AS jc,
  CASE k % 5 WHEN 0 THEN CAST(k % 100 AS VARCHAR) || ',' WHEN 1 THEN ',6' END AS spacing FROM s),
up AS (SELECT doc_id, id AS of, id, base, 0 AS depth, [id] AS seen FROM own
  UNION ALL SELECT up.doc_id, up.of, own.id, own.base, depth + 1, list_append(seen, own.id) FROM up JOIN own ON own.doc_id = up.doc_id AND own.id = up.base WHERE NOT list_contains(seen, own.id)),
near AS (SELECT up.doc_id, of AS id, arg_min(bold, depth) FILTER (WHERE bold IS NOT NULL) AS bold, arg_min(font_size, depth) FILTER (WHERE font_size IS NOT NULL) AS font_size,
  arg_min(jc, depth) FILTER (WHERE jc IS NOT NULL) AS jc, arg_min(spacing, depth) FILTER (WHERE spacing IS NOT NULL) AS spacing
  FROM up JOIN own ON own.doc_id = up.doc_id AND own.id = up.id GROUP BY ALL)
SELECT near.doc_id, near.id, own.type, near.bold, near.font_size, near.jc, nullif(split_part(near.spacing, ',', 1), '') AS line, nullif(split_part(near.spacing, ',', 2), '') AS before
FROM near JOIN own ON own.doc_id = near.doc_id AND own.id = near.id"""
)
def docx_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles of a sheet written for every document, with what they inherit."""
    found = docx.sheets(_table(spark, sf_dir, "documents").select("doc_id", fixtures.style_sheet(F.col("doc_id")).alias("content")))
    rows = found.select("doc_id", F.inline(docx.resolved(F.col("docx.styles"))))
    return rows.select("doc_id", "id", "type", "run.bold", "run.font_size", "paragraph.jc", "paragraph.spacing.line", "paragraph.spacing.before")


_NAV = '<table><tr><td><a href="p{0}.htm"><img src="x.gif" alt="Previous"></a></td></tr></table>'


@query(
    """SELECT doc_id, '<html><head></head><body>' || CASE doc_id % 3 WHEN 1 THEN '<div>' || safe || '</div>' ELSE '<p>' || safe || '</p>' END || '</body></html>' AS html
FROM (SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM documents)"""
)
def chm_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of compiled help, with links to neighbours, inside one cell, or with an object."""
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    before, after = _NAV.split("{0}")
    page = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<body>" + before), F.col("doc_id").cast("string"), F.lit(after + "<p>"), safe, F.lit("</p>")))
    page = page.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("<table><tr><td>"), safe, F.lit("</td></tr></table>")))
    page = page.otherwise(F.concat(F.lit("<html><body><object><param name=a></object><p>"), safe, F.lit("</p><embed src=x></body></html>")))
    return _table(spark, sf_dir, "documents").select("doc_id", chm.cleanup(page).alias("c")).select("doc_id", "c.html")


_REFS = """CASE doc_id % 6 WHEN 0 THEN '../img/' || doc_id || '.PNG' WHEN 1 THEN 'http://x/' || doc_id || '.png' WHEN 2 THEN '/img/./' || doc_id || '.gif'
  WHEN 3 THEN chr(92) || 'img' || chr(92) || doc_id || '.dat' WHEN 4 THEN 'none.png' ELSE '' END"""


@query(
    f"""SELECT doc_id, src, CASE WHEN doc_id % 6 IN (0, 2, 3) THEN 'data:' || CASE doc_id % 6 WHEN 0 THEN 'image/png' WHEN 2 THEN 'image/gif' ELSE 'application/octet-stream' END
  || ';base64,' || to_base64(encode(CAST(n_chars AS VARCHAR))) ELSE src END AS uri FROM (SELECT doc_id, n_chars, {_REFS} AS src FROM documents)"""
)
def chm_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture of every document's page: beside it, outside, at the root, with backslashes, or missing."""
    docs = _table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 6 == 0, ".PNG").when(F.col("doc_id") % 6 == 2, ".gif").otherwise(".dat")
    path = F.concat(F.when(F.col("doc_id") % 6 == 2, "/img/").otherwise("img/"), F.col("doc_id"), kind)
    files = docs.select((F.col("doc_id") % 10).alias("archive"), path.alias("path"), F.col("n_chars").cast("string").cast("binary").alias("content"))
    refs = docs.select("doc_id", (F.col("doc_id") % 10).alias("archive"), F.lit("html/a.htm").alias("base"), F.expr(_REFS).alias("src"))
    return chm.pictures(refs, files, "archive").select("doc_id", "src", "uri")


@query(
    """WITH p AS (SELECT doc_id, doc_id % 30 + 1 AS w, doc_id % 12 + 1 AS h, doc_id % 2 = 1 AS rtl FROM documents),
r AS (SELECT *, unnest(range(h)) AS y FROM p), t AS (SELECT *, md5(doc_id || '-' || y)[1:w] AS line FROM r),
q AS (SELECT *, unnest(CASE WHEN w > h THEN [0, 1] ELSE [0] END) AS part FROM t)
SELECT doc_id, part::INT AS ord, 'p' || doc_id || '.x' || CASE WHEN w > h THEN '_' || (part + 1) ELSE '' END || '.png' AS name,
  string_agg(CASE WHEN w <= h THEN line WHEN (part = 1) <> rtl THEN line[w // 2 + 1:] ELSE line[:w // 2] END, '/' ORDER BY y) AS pixels
FROM q GROUP BY doc_id, part, w, h"""
)
def comic_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture of every document, cut into halves where it is wider than high, and read again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("index"), F.concat(F.lit("p"), F.col("doc_id"), F.lit(".x.png")).alias("name"), fixtures.grey_png(F.col("doc_id")).alias("content"))
    found = comic.pages(docs, "doc_id", F.col("doc_id") % 2 == 1)
    return found.select("doc_id", "ord", "name", fixtures.letters_of(F.col("content")).alias("pixels"))


_LINKS = "regexp_extract_all(regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1), '(?s)<a href=\"([^\"]*)\"[^>]*>(.*?)</a>'"


@query(
    f"""WITH n AS (SELECT page_id, {_LINKS}, 1) AS href, {_LINKS}, 2) AS label FROM pages)
SELECT page_id, 0 AS ord, 'list' AS kind, trim(array_to_string(list_transform(list_zip(href, label), lambda x: '- [' || trim(x[2]) || '](' || x[1] || ')'), ' ')) AS text FROM n"""
)
def html_nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of links that every page begins with, as Markdown."""
    return html.blocks_of(html.books(_pages(spark, sf_dir), F.col("name"), F.col("html")), "page_id").where("kind = 'list'").select("page_id", "ord", "kind", "text")


@query(
    """SELECT page_id, (2 + len(regexp_extract_all(html, '<h1')) + len(list_filter(string_split(split_part(split_part(html, '<article', 2), '</article>', 1), '<p>')[2:], lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g')) <> ''))
  + len(regexp_extract_all(html, '<footer')))::BIGINT AS n_blocks FROM pages"""
)
def html_blocks_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every page: the links, the notice, the heading, paragraphs and the foot."""
    return html.blocks_of(html.books(_pages(spark, sf_dir), F.col("name"), F.col("html")), "page_id").groupBy("page_id").agg(F.count("*").alias("n_blocks"))


@query(
    """SELECT doc_id, 'T' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'Ann' || doc_id || ' Lee' ELSE 'Ismeretlen szerző' END AS author, doc_id % 3 = 0 AS has_cover,
  1 + (doc_id % 3 = 0)::INT AS n_sections FROM documents"""
)
def fb2_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, author and cover of every document written as a FictionBook file."""
    num = F.col("doc_id").cast("string")
    author = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<author><first-name>Ann"), num, F.lit("</first-name><last-name> Lee </last-name></author>"))).otherwise("")
    cover = F.when(F.col("doc_id") % 3 == 0, '<coverpage><image href="#c"/></coverpage>').otherwise("")
    xml = F.concat(F.lit("<FictionBook><description><title-info>"), author, F.lit("<book-title> T"), num, F.lit("</book-title>"), cover, F.lit('</title-info></description><body><section><p>x</p></section></body><binary id="c" content-type="image/png">QUJD</binary></FictionBook>'))
    books = fb2.books(_table(spark, sf_dir, "documents").select("doc_id", xml.alias("xml")), F.concat("doc_id", F.lit(".fb2")), F.col("xml"))
    n = F.size("fb2.sections") + F.col("fb2.cover").isNotNull().cast("int")
    return books.select("doc_id", "fb2.title", "fb2.author", F.col("fb2.cover").isNotNull().alias("has_cover"), n.alias("n_sections"))


@query(
    """SELECT doc_id, 'Title ' || doc_id AS title, 'Author ' || doc_id AS author, '<html><body><h1>One</h1>' || doc_id || '<br/>\n<b>end</b></body></html>' AS html, NULL::VARCHAR AS error FROM documents"""
)
def ereader_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, author and markup of every document's number written as an eReader database."""
    return ereader.books(_table(spark, sf_dir, "documents").select("doc_id", fixtures.ereader(F.col("doc_id")).alias("content")), "doc_id")
