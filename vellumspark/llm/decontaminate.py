"""Benchmark decontamination (operator 1), in DataFrame operations only.

Texts become words (runs of letters and digits, in lower case) and shingles of five words. A window has as many
shingles as a benchmark item, and matches it if their weighted Jaccard similarity (sum of least over sum of greatest
counts) reaches the threshold.

1. *Windows*: a match shares so many shingles with its item as both sizes require (``_need``). Shingles of all texts
   are joined with those of the benchmark; a window that begins at a shared shingle and holds enough of them is a
   candidate. Any other window holds no more shared shingles than the one that begins at its first shared one (or
   than the last of the text), so no better window is left out.
2. *SimHash*: a window's 64 bits are the majorities of the bits of its shingles' hashes, repeated ones counting
   again. The fingerprints of items are entered under six blocks with up to two bits flipped, so all fingerprints
   within a radius of 17 bits meet in some block; then the whole distance is compared.
3. *Verification*: the exact weighted similarity of window and item.

At a similarity of 0.8 the fingerprints differ by 10 bits on average; about 1 match in 300 there would lie beyond 17.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.store import saved

SHINGLE = 5
#: (offset, width) of the blocks of a fingerprint; with FLIPPED bits in one of them, six blocks cover RADIUS.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
FLIPPED = 2
RADIUS = len(BLOCKS) * (FLIPPED + 1) - 1
#: A table of at most so many rows (of two or three numbers) is broadcast.
BROADCAST_ROWS = 1_000_000


def _small(df: DataFrame) -> DataFrame:
    """The written table with the hint to broadcast it, if it is small by its count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value made once: the optimizer may else copy an expression into a lambda, which then
    makes it anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of all runs of n words. Fewer words are one shingle if n is SHINGLE, and else none."""

    def of(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n))))
        less = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))
        return F.when(F.size(h) >= n, runs).otherwise(less if n == SHINGLE else F.array().cast("array<long>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def item_shingles(text: Column) -> Column:
    """As shingles(); an item of fewer words than SHINGLE is one shingle of all, hashed as such runs of texts are."""
    h = F.transform(words(text), lambda w: F.xxhash64(w))
    short = F.coalesce(*(F.when(F.size(h) == n, F.array(F.xxhash64(*(F.get(h, F.lit(k)) for k in range(n))))) for n in range(1, SHINGLE)))
    return F.coalesce(short, shingles(text))


def fingerprint(hashes: Column) -> Column:
    """SimHash: bit b is set if more than half of the hashes have it."""

    def of(s: Column) -> Column:
        def bit(b: Column) -> Column:
            ones = F.aggregate(s, F.lit(0), lambda n, h: n + F.call_function("getbit", h, b).cast("int"))
            return F.when(ones * 2 > F.size(s), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))

    return let(hashes, of)


def _block(fp: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _flips(width: int) -> list[int]:
    return sorted(m for m in range(1 << width) if m.bit_count() <= FLIPPED)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of hashes, each counted as often as it occurs."""
    count = lambda c, h: F.size(F.filter(c, lambda x: x == h))
    least = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, h: n + F.least(count(a, h), count(b, h)))
    return let(least, lambda n: n / (F.size(a) + F.size(b) - n))


def _need(n_item: Column, n_window: Column, threshold: float) -> Column:
    return F.ceil((n_item + n_window) * (threshold / (1 + threshold)) - 1e-9).cast("int")


def contaminations(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item with a matching window: ``id_col``, ``item_col``, key, start (word), n_words
    (of the window), similarity of the best window, the first of equals.

    A null text or item counts as empty, and nothing matches an item without words; an item of fewer words than a
    shingle matches where its words stand. Documents with null or equal ids are told apart by key, a hash of id and
    text; rows equal in both give one result. Either table may be empty; other columns aren't read, so they may have any name.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.size(words(F.col(item_text))).alias("n_words"), item_shingles(F.col(item_text)).alias("shingles"))
    items = items.where("n_words > 0").select("item", "shingles", F.size("shingles").alias("n_item"), F.least("n_words", F.lit(SHINGLE)).alias("width"), fingerprint(F.col("shingles")).alias("fp"))
    items = saved(items.distinct(), "items")
    widths = [r.width for r in items.select("width").distinct().collect()]  # five numbers at most
    marks = _small(saved(items.select("item", "n_item", "width", F.explode(F.array_distinct("shingles")).alias("hash")), "marks"))

    hits = None
    for width in widths:
        placed = let(shingles(F.col("text"), width), lambda s: F.transform(s, lambda h, i: F.struct(F.size(s).alias("n_doc"), i.alias("pos"), h.alias("hash"))))
        found = rows.select("id", "key", F.explode(placed).alias("s")).select("id", "key", "s.*")
        found = found.join(marks.where(F.col("width") == width), "hash").select("id", "key", "n_doc", "item", "n_item", "width", "pos")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = rows.select("id", "key", F.lit(0).alias("n_doc")).join(items.select("item", "n_item", "width", F.lit(0).alias("pos")), F.lit(False))
    window = F.least("n_item", "n_doc")
    spots = hits.groupBy("id", "key", "n_doc", "item", "n_item", "width").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    spots = spots.withColumn("need", _need(F.col("n_item"), window, threshold)).where("size(p) >= need")
    last = F.greatest(F.col("n_doc") - F.col("n_item"), F.lit(0))

    def begins(p: Column) -> Column:
        enough = F.filter(F.sequence(F.lit(0), F.size(p) - F.col("need")), lambda i: F.get(p, i + F.col("need") - 1) < F.get(p, i) + F.col("n_item"))
        return F.array_distinct(F.transform(enough, lambda i: F.least(F.get(p, i), last)))

    starts = let(F.col("p"), begins)
    spots = spots.select("id", "key", "n_item", "width", F.explode(starts).alias("start")).distinct()
    spots = saved(spots, "spots")

    few, keys = _small(spots.drop("id")), _small(saved(spots.select("key").distinct(), "keys"))
    windows = None
    for width in widths:
        text = rows.join(keys, "key", "left_semi")
        text = text.select("id", "key", shingles(F.col("text"), width).alias("shingles"))
        cut = text.join(few.where(F.col("width") == width), "key").select("id", "key", "n_item", "width", "start", F.slice("shingles", F.col("start") + 1, F.col("n_item")).alias("window"))
        windows = cut if windows is None else windows.unionByName(cut)
    if windows is None:
        return spots.select(F.col("id").alias(id_col), F.lit(None).cast(benchmark.schema[item_col].dataType).alias(item_col), "key", "start", F.col("n_item").alias("n_words"), F.lit(0.0).alias("similarity")).where("false")
    windows = saved(windows.distinct().withColumn("fp_window", fingerprint(F.col("window"))), "windows")

    entered = []
    for k, (offset, width) in enumerate(BLOCKS):
        flip = F.explode(F.array(*(F.lit(m).cast("long") for m in _flips(width)))).alias("flip")
        part = items.select("item", "n_item", "width", "fp", F.lit(k).alias("block"), flip)
        entered.append(part.withColumn("value", _block(F.col("fp"), offset, width).bitwiseXOR(F.col("flip"))).drop("flip"))
    index = entered[0]
    for part in entered[1:]:
        index = index.unionByName(part)
    blocks = F.explode(F.array(*(F.struct(F.lit(k).alias("block"), _block(F.col("fp_window"), o, w).alias("value")) for k, (o, w) in enumerate(BLOCKS))))
    probes = windows.select("id", "key", "n_item", "width", "start", "fp_window", blocks.alias("b")).select("*", "b.block", "b.value").drop("b")
    near = probes.join(index, ["n_item", "width", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_window"))) <= RADIUS)
    near = near.select("id", "key", "n_item", "width", "start", "item").distinct()
    same = near.id.eqNullSafe(windows.id) & (near.key == windows.key) & (near.n_item == windows.n_item) & (near.width == windows.width) & (near.start == windows.start)
    pairs = near.join(windows.select("id", "key", "n_item", "width", "start", "window"), same).select(near.id, near.key, near.n_item, near.width, near.start, near["item"], "window")
    pairs = pairs.join(items.select("item", "n_item", "width", "shingles"), ["item", "n_item", "width"]).withColumn("similarity", similarity(F.col("window"), F.col("shingles"))).where(F.col("similarity") >= threshold - 1e-12)
    best = pairs.groupBy("id", "key", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), (F.col("n_item") + F.col("width") - 1).alias("n_words"))).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "key", (-F.col("m.before")).alias("start"), F.col("m.n_words").alias("n_words"), F.col("m.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without a contamination, with the columns they had; null and empty texts stay."""
    found = saved(contaminations(docs, benchmark, threshold, id_col, text_col).select(F.col(id_col).alias("_found"), F.col("key").alias("_key")).distinct(), "contaminated")
    key = F.xxhash64(docs[id_col], F.coalesce(docs[text_col], F.lit("")))
    found = _small(found)
    return docs.join(found, (key == found["_key"]) & docs[id_col].eqNullSafe(found["_found"]), "left_anti")
