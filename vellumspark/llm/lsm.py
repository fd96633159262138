"""Exact dedup by a log-structured merge index (operator 4).

* *Memtables*: each task collects the digests of the texts it reads; a text whose digest is there already is
  compared with the kept text byte by byte. A full memtable is flushed as a run sorted by digest: one entry for
  each text, with its smallest identifier and the identifiers of its rows. Texts are not written.
* *Compaction* merges the runs by digest and keeps the smallest identifier and the count. Map-side combination
  leaves one row for each digest and task, so a group of a third of all rows is spread over the runs.
* *Filters and verification*: digests that stand in several runs are hits. Their Bloom filter lets a second scan
  drop other texts where they are read; the texts of hits, one for each memtable, are compared with the text
  of the row that stays. The filter grows with the hits up to a fixed size; beyond it, it takes fewer bits for each
  digest and lets more texts through to the join behind it, which is exact whatever the filter lets through.

If texts with one digest differ, the rows of that digest are grouped by their whole texts instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.store import saved

#: A memtable is flushed when it holds so many bytes of text or rows.
MEMTABLE_BYTES, MEMTABLE_ROWS = 32 << 20, 1 << 16
#: A filter of hits has so many bits for each digest, so many bits at most, and so many probes at most.
BITS_EACH, FILTER_BITS, PROBES = 16, 1 << 28, 5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _positions(digest: bytes, bits: int, probes: int) -> list[int]:
    first = int.from_bytes(digest[:8].ljust(8, b"\0"), "little")
    step = int.from_bytes(digest[-8:].rjust(8, b"\0"), "big") | 1
    return [(first + k * step) % bits for k in range(probes)]


def _memtables(digest_bytes: int, with_text: bool, admitted):
    """The map side: batches of (id, text) to the entries of sorted runs."""

    def run(batches):
        probes, filter_bits = admitted.value if admitted is not None else (0, None)
        table: dict[bytes, list[list]] = {}
        size = rows = 0

        def flush():
            entries = [(digest, *entry) for digest in sorted(table) for entry in table[digest]]
            table.clear()
            step = max(1, (8 << 20) // max(1, size // max(1, len(entries)))) if with_text else 4096
            for k in range(0, len(entries), step):
                part = entries[k : k + step]
                columns = [pa.array([e[0] for e in part], pa.binary()), pa.array([e[1] for e in part], pa.int64()), pa.array([len(e[3]) for e in part], pa.int64())]
                columns.append(pa.array([e[2] for e in part], pa.binary()) if with_text else pa.array([e[3] for e in part], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["digest", "least", "n", "text" if with_text else "members"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or b"").lower()  # of bytes: A-Z only
                digest = hashlib.sha256(raw).digest()[:digest_bytes]
                if filter_bits is not None and not all(filter_bits[p >> 3] >> (p & 7) & 1 for p in _positions(digest, len(filter_bits) * 8, probes)):
                    continue
                same = table.setdefault(digest, [])
                entry = next((e for e in same if e[1] == raw), None)
                if entry is None:
                    same.append([key, raw, [key]])
                    size += len(raw)
                else:
                    entry[2].append(key)
                    if key is not None and (entry[0] is None or key < entry[0]):
                        entry[0] = key
                rows += 1
                if size >= MEMTABLE_BYTES or rows >= MEMTABLE_ROWS:
                    yield from flush()
                    size = rows = 0
        yield from flush()

    return run


def _bloom(hits: DataFrame, n: int):
    """The filter of n digests as a broadcast (probes, bits). Its bits are put together by page of 4096 bytes, so
    what reaches the driver is bounded by the filter and not by the digests."""
    bits = min(FILTER_BITS, 1 << max(15, int(np.ceil(np.log2(max(1, n) * BITS_EACH)))))
    probes = max(1, min(PROBES, round(bits / n * np.log(2))))

    def pages(batches):
        made = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            for digest in batch.column(0).to_pylist():
                for p in _positions(digest, bits, probes):
                    made[p >> 3] |= 1 << (p & 7)
        made = made.reshape(-1, 4096)
        for k in range(0, len(made), 256):
            used = [i for i in range(k, min(k + 256, len(made))) if made[i].any()]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([made[i].tobytes() for i in used], pa.binary())], ["page", "bits"])

    whole = np.zeros((bits >> 15, 4096), np.uint8)
    for row in hits.select("digest").coalesce(64).mapInArrow(pages, "page int, bits binary").toLocalIterator():
        whole[row.page] |= np.frombuffer(row.bits, np.uint8)
    return hits.sparkSession.sparkContext.broadcast((probes, whole.tobytes()))


def grouped_digest(digests: DataFrame, n: int):
    """A function of a column of texts: the text's digest in hex if a filter of the n ``digests`` (column digest) lets it
    through, else null. None of them is null; what is broadcast has a bound, and more is let through beyond it."""
    admitted = _bloom(digests, n)

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        probes, bits = admitted.value
        found = [hashlib.sha256(text.lower()) for text in texts]  # of bytes: A-Z only
        return pd.Series([h.hexdigest() if all(bits[p >> 3] >> (p & 7) & 1 for p in _positions(h.digest(), len(bits) * 8, probes)) else None for h in found], dtype=object)

    # Called nondeterministic, as the optimizer may else run it a second time for a filter.
    return lambda text: of.asNondeterministic()(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest_bytes: int = 32) -> DataFrame:
    """One row for each row of df: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal if the same after lower-casing A-Z; a null text counts as empty, so null and empty texts make
    one group. Of equal texts the row with the smallest id stays (``keep="max"``: the largest). Ids are integers;
    rows that repeat an id and text count each, and share ``kept``. A null id never stays while its group has
    another; a group with null ids only keeps all of them (keep_id null). An empty table gives no rows. Only the
    two columns are read, so others may have any name. ``digest_bytes`` shortens the digests of the index, for
    tests of the verification.
    """
    spark = df.sparkSession
    key = F.col(id_col).cast("long")
    rows = df.select((F.bitwise_not(key) if keep == "max" else key).alias("key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def back(c: Column) -> Column:
        return F.bitwise_not(c) if keep == "max" else c

    runs = saved(rows.mapInArrow(_memtables(digest_bytes, False, None), "digest binary, least long, n long, members array<long>"), "runs")
    merged = runs.groupBy("digest").agg(F.min("least").alias("keep"), F.sum("n").alias("group_size"), F.count("*").alias("entries"))
    merged = saved(merged, "compacted")
    hits = merged.where("entries > 1").select("digest", "keep")
    n_hits = hits.count()
    bad = None
    if n_hits:
        bloom = _bloom(hits, n_hits)
        texts = rows.mapInArrow(_memtables(digest_bytes, True, bloom), "digest binary, least long, n long, text binary").join(hits, "digest")
        # One text for each memtable and digest; two entries hold the keeper's id only if ids repeat.
        texts = saved(texts, "hits")
        stay = texts.where("least <=> keep").groupBy("digest").agg(F.min("text").alias("stays"))
        unlike = saved(texts.join(stay, "digest").where("text <> stays").select("digest").distinct(), "unlike")
        bad = unlike if not unlike.isEmpty() else None
    if bad is not None:
        runs, merged = runs.join(bad, "digest", "left_anti"), merged.join(bad, "digest", "left_anti")
    out = runs.select("digest", "members").join(merged.select("digest", "keep", "group_size"), "digest").select("*", F.explode("members").alias("key"))
    columns = [back(F.col("key")).alias(id_col), back(F.col("keep")).alias("keep_id"), "group_size", F.col("key").eqNullSafe(F.col("keep")).alias("kept")]
    out = out.select(*columns, F.lower(F.hex("digest")).alias("text_sha256"))
    if bad is None:
        return out
    return out.unionByName(_by_text(rows, bad, digest_bytes, id_col, back))


def _by_text(rows: DataFrame, digests: DataFrame, digest_bytes: int, id_col: str, back) -> DataFrame:
    """The rows whose digests several texts share, grouped by whole texts."""
    low = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    named = rows.select("key", low.alias("text")).withColumn("sha", F.sha2("text", 256))
    named = named.withColumn("digest", F.unhex(F.substring("sha", 1, 2 * digest_bytes))).join(digests, "digest", "left_semi")
    groups = named.groupBy("text").agg(F.min("key").alias("keep"), F.count("*").alias("group_size"))
    out = named.join(groups, "text")
    return out.select(back(F.col("key")).alias(id_col), back(F.col("keep")).alias("keep_id"), "group_size", F.col("key").eqNullSafe(F.col("keep")).alias("kept"), F.substring("sha", 1, 2 * digest_bytes).alias("text_sha256"))
