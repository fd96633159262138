"""Pages without pixels: automatic contents of scanned books, and the geometry of split comic pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def automatic_toc(df: DataFrame, n_pages: str, *keys: str) -> DataFrame:
    """An entry for every max(1, n/20)th page of a book without contents: keys, ord, id, label, page_index. No pages
    (0 or null) give none."""
    step = F.greatest(F.lit(1), F.floor(F.col(n_pages) / 20)).cast("int")
    pages = df.where(F.col(n_pages) > 0).select(*keys, F.posexplode(F.sequence(F.lit(0), F.col(n_pages).cast("int") - 1, step)).alias("ord", "page_index"))
    return pages.select(*keys, "ord", F.concat(F.lit("djvu-toc-auto-"), F.col("page_index")).alias("id"), F.concat(F.col("page_index") + 1, F.lit(". oldal")).alias("label"), "page_index")


def split_pages(df: DataFrame, width: Column, height: Column, right_to_left: Column, name: str, *keys: str) -> DataFrame:
    """Halves of landscape pages (wider than high) in reading order: keys, part, page_name, x, part_width. Other
    pages stay whole."""
    left = F.floor(width / 2).cast("int")
    stem = F.regexp_replace(name, r"\.[^/.]+$", "")
    half = lambda x, w: F.struct(x.cast("int").alias("x"), w.cast("int").alias("part_width"))
    a, b = half(F.lit(0), left), half(left, width - left)
    parts = F.when(width > height, F.when(right_to_left, F.array(b, a)).otherwise(F.array(a, b))).otherwise(F.array(half(F.lit(0), width)))
    rows = df.withColumn("_split", width > height).select("*", F.posexplode(parts).alias("part", "_p"))
    return rows.select(*keys, "part", F.when(F.col("_split"), F.concat(stem, F.lit("_"), F.col("part") + 1, F.lit(".png"))).otherwise(F.col(name)).alias("page_name"), F.col("_p.x").alias("x"), F.col("_p.part_width").alias("part_width"))


# Texts of pages and entries.
CHAPTER, PAGE, FAILED = ". fejezet", ". oldal", " (Hiba)"
FAILED_TEXT = "Hiba a(z) {}. oldal dekódolása során."


def explicit_toc(df: DataFrame, items: str, *keys: str) -> DataFrame:
    """The entries of a book's own contents, an array of (title, page_number): keys, ord, id, label, page_index. Without a title the
    entry has a number, without a page (null or 0) it leads to the first. Null or no items give none."""
    rows = df.select(*keys, F.posexplode(items).alias("ord", "i"))
    label = F.coalesce(F.nullif(F.col("i.title"), F.lit("")), F.concat((F.col("ord") + 1).cast("string"), F.lit(CHAPTER)))
    page = F.when(F.coalesce(F.col("i.page_number"), F.lit(0)) != 0, F.col("i.page_number") - 1).otherwise(0).cast("int")
    return rows.select(*keys, "ord", F.concat(F.lit("djvu-toc-"), F.col("ord").cast("string")).alias("id"), label.alias("label"), page.alias("page_index"))


def toc(df: DataFrame, n_pages: str, items: str, *keys: str) -> DataFrame:
    """A book's own contents, or the automatic ones where it has none."""
    own = F.coalesce(F.size(items), F.lit(0)) > 0
    return explicit_toc(df.where(own), items, *keys).unionByName(automatic_toc(df.where(~own), n_pages, *keys))


def page_range(df: DataFrame, n_pages: str, *keys: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(keys, page): the pages asked for, counted from 1; by default all. Pages beyond the book are kept, as errors of the reader."""
    a = F.lit(1 if first is None else first)
    b = F.col(n_pages).cast("int") if last is None else F.lit(last)
    return df.select(*keys, F.explode(F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))).alias("page"))


def page_rows(decoded: DataFrame, *keys: str) -> DataFrame:
    """(keys, index, title, url, text, width, height) of pages (keys, page, url, text, width, height, error) as a decoder gave
    them; a page with an error has its notice only."""
    failed = F.col("error").isNotNull()
    number, ok = F.col("page").cast("string"), lambda c: F.when(~failed, F.col(c))
    before, after = FAILED_TEXT.split("{}")
    return decoded.select(
        *keys, (F.col("page") - 1).alias("index"), F.concat(number, F.lit(PAGE), F.when(failed, FAILED).otherwise("")).alias("title"), ok("url").alias("url"),
        F.when(failed, F.concat(F.lit(before), number, F.lit(after))).otherwise(F.coalesce("text", F.lit(""))).alias("text"), ok("width").alias("width"), ok("height").alias("height"),
    )
