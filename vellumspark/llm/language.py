"""Language identification by nearest centroids (operator 10).

A text is a vector of letter trigrams (runs of other characters count as one space), hashed to DIMENSIONS, with
damped counts times inverse document frequency, of length 1. Each language has several centroids from spherical
k-means; the nearest by cosine gives the language. A text farther from it than nearly all training texts of that
language were is rejected.

Document frequencies cover every training document. The clusters are fitted on a bounded sample for each language.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trigram cells; clusters of a language; documents of a language from which they are fitted, those of the least
#: hash of the id; the share of these that the rejection distance leaves outside.
DIMENSIONS, CLUSTERS, SAMPLE, OUTSIDE = 1 << 13, 4, 600, 0.001

#: Letters and their marks make trigrams; only letters make a text have a language.
_LETTER = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])
_TABLE = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)])


def counts(text: str | None) -> np.ndarray | None:
    """How often each cell occurs; None if there is no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _TABLE[points]
    if not _LETTER[points].any():
        return None
    at = np.where(letter, points, 32)
    keep = np.ones(len(at), bool)
    keep[1:] = letter[1:] | letter[:-1]  # of several spaces the first
    at = np.concatenate([[32], at[keep], [32]]).astype(np.uint32)
    h = at[:-2] * np.uint32(0x9E3779B1) ^ at[1:-1] * np.uint32(0x85EBCA77) ^ at[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.bincount(h >> np.uint32(32 - 13), minlength=DIMENSIONS)


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length 1, which texts have letters)."""
    made = np.zeros((len(texts), DIMENSIONS), np.float32)
    has = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        c = counts(text)
        if c is not None:
            has[i] = True
            used = np.flatnonzero(c)
            v = (1 + np.log(c[used])) * idf[used]
            made[i, used] = v / (np.linalg.norm(v) or 1)
    return made, has


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of length 1 of unit vectors; the starts are each the farthest from those before."""
    starts = [0]
    near = x @ x[0]
    for _ in range(min(k, len(x)) - 1):
        starts.append(int(near.argmin()))
        near = np.maximum(near, x @ x[starts[-1]])
    c = x[starts]
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        c = np.array([x[of == j].sum(0) if (of == j).any() else c[j] for j in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-12
    return c.astype(np.float32)


def train(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """Document frequencies of all rows for which ``usable`` holds and the language isn't null, and the centroids;
    None without such rows. What reaches the driver is DIMENSIONS counts and CLUSTERS vectors for each language."""
    rows = df.where(usable & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def frequencies(batches):
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                c = counts((text.as_py() or b"").decode("utf-8", "replace"))
                if c is not None:
                    total += c > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([*range(DIMENSIONS), -1], pa.int32()), pa.array([*total, n], pa.int64())], ["cell", "n"])

    found = {r.cell: r.n for r in rows.select("text").mapInArrow(frequencies, "cell int, n long").where("n > 0").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    n = found.pop(-1, 0)
    if not n:
        return None
    df_of = np.zeros(DIMENSIONS)
    df_of[list(found)] = list(found.values())
    idf = np.log((1 + n) / (1 + df_of)) + 0.05

    def clusters(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["h", "id"])
        x, has = vectors([bytes(t or b"").decode("utf-8", "replace") for t in sample["text"]], idf)
        x = x[has]
        if not len(x):
            return pd.DataFrame([], columns=["lang", "centroids", "least"])
        c = k_means(x, CLUSTERS)
        return pd.DataFrame({"lang": [sample["lang"].iloc[0]], "centroids": [c.tobytes()], "least": [0.9 * float(np.quantile((x @ c.T).max(1), OUTSIDE))]})

    hashed = rows.select("lang", "id", F.xxhash64("id").alias("h"))
    cut = hashed.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.lit(4.0 * SAMPLE) / F.col("n")).alias("share"))
    cut = {r.lang: r.share for r in cut.collect()}  # one number for each language
    share = F.create_map(*(F.lit(v) for pair in cut.items() for v in pair))[F.col("lang")]
    some = rows.withColumn("h", F.xxhash64("id")).where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    fitted = some.groupBy("lang").applyInPandas(lambda p: clusters(p.sort_values(["h", "id"]).head(SAMPLE)), "lang string, centroids binary, least double").collect()
    if not fitted:
        return None
    fitted.sort(key=lambda r: (-(1 / cut[r.lang]), r.lang))  # of equal distances the commoner language
    parts = [np.frombuffer(r.centroids, np.float32).reshape(-1, DIMENSIONS) for r in fitted]
    return {"idf": idf, "centroids": np.concatenate(parts), "of": np.repeat(np.arange(len(parts)), [len(p) for p in parts]), "langs": [r.lang for r in fitted], "least": np.array([r.least for r in fitted])}


def identify(df: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", reject: bool = True) -> DataFrame:
    """``id_col``, lang_pred, score (cosine to the nearest centroid), rejected.

    A null text, one without a letter, or any text without a model is `und` with score 0. With ``reject``, so is a
    rejected text (its score stays); else the column says so only. Rows aren't joined or grouped, so repeated rows and
    null ids stay; only the two columns are read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                langs, scores, out = ["und"] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                if m is not None:
                    x, has = vectors([(t.as_py() or b"").decode("utf-8", "replace") for t in part.column(1)], m["idf"])
                    near = x @ m["centroids"].T
                    best = near.argmax(1)
                    scores = np.clip(near[np.arange(len(x)), best], 0, 1).astype(float) * has
                    out = has & (scores < m["least"][m["of"][best]])
                    langs = [m["langs"][m["of"][b]] if h and not (r and reject) else "und" for b, h, r in zip(best, has, out, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
