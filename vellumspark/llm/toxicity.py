"""Toxicity by compression distance (operator 7).

Two zstandard dictionaries, one trained on toxic and one on ordinary text, compress each window of a text; a window
that the toxic one shortens more is closer to toxic text. How many windows of a document pass each of several
differences becomes its score, by weights that are calibrated on folds which the dictionaries haven't seen.

*Windows.* A window is one word (run of letters, lower-cased) with the space before and after it. Words of more than 24
letters are windows of 24 that overlap by half; runs in scripts without spaces, where one may be a clause, are windows of
four letters that overlap by half. So no letter of a text is left out. zstandard stores a block raw if little is saved,
which hides a match in a short window: each is compressed with 40 zeros behind it, whose saving is the same for both.

*Dictionaries.* A toxic text is mostly made of ordinary words, so what two dictionaries of plain text say of one word is
noisy. They are therefore trained twice. First each is plain text of its class. Then, of the windows of each fold, the
SHARE which the dictionaries of the other folds tell best for their own class are kept, and zstandard's trainer
makes a dictionary of those; both follow the same ordinary text, so that their difference is what the trained
parts say. This is done ROUNDS times. No word list is chosen: the trainer sees windows, and lengths decide.

Labels are read for a bounded sample (SAMPLE documents of each class, WINDOWS of their windows a fold).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.models import logistic, probability

#: Labelled documents of each class that are used at most (those of the least hash of their id), and windows of each
#: class that one fold gives to training.
SAMPLE, WINDOWS = 2000, 60_000
FOLDS, ROUNDS, SHARE = 6, 2, 0.02
#: Ridge penalty of the weights, as the counts tell much the same and labels may be few.
PENALTY = 3.0
#: Bytes of the plain dictionaries, and of the ordinary text and the trained part of the final ones.
PLAIN, BASE, TRAINED = 1 << 18, 1 << 15, 1 << 13
LONG, UNSPACED, PAD = 24, 4, bytes(40)
#: Differences in bytes whose windows are counted, to either side.
TOXIC_STEPS, ORDINARY_STEPS = (1, 2, 3, 4, 6), (1, 2, 3, 4)
KEPT_WINDOWS = 1 << 18

_WORD = re.compile(r"[^\W\d_]+").findall
#: Letters of scripts without spaces: Thai, Lao, Burmese, Khmer, kana and Chinese characters.
_NO_SPACES = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]").search


def windows(text: str | None) -> list[str]:
    """The windows of the whole text, in order; none without letters."""
    out = []
    for word in _WORD((text or "").lower()):
        width = UNSPACED if _NO_SPACES(word) else LONG
        if len(word) <= width:
            out.append(word)
        else:
            out += (word[i : i + width] for i in range(0, len(word) - width // 2, width // 2))
    return out


def _bytes(window: str) -> bytes:
    return b" " + window.encode("utf-8", "replace") + b" "


def _compressor(dictionary: bytes):
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(
        1, source_size=512, dict_size=len(dictionary), strategy=zstandard.STRATEGY_LAZY2, min_match=5, search_log=6, hash_log=17, chain_log=17, window_log=19,
        write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    return zstandard.ZstdCompressor(dict_data=content, compression_params=how).compress


class Distances(dict):
    """Of a window: its compressed length with the ordinary less that with the toxic dictionary. Those of KEPT_WINDOWS
    windows are kept."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        super().__init__()
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(toxic)

    def __missing__(self, window: str) -> int:
        padded = _bytes(window) + PAD
        if len(self) >= KEPT_WINDOWS:
            self.clear()
        d = self[window] = len(self.ordinary(padded)) - len(self.toxic(padded))
        return d

    def of(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))

    def features(self, text: str | None) -> list[float]:
        """What the differences of a text's windows are like, each different window once; all nought without windows."""
        d = self.of(list(set(windows(text))))
        n = max(1, len(d))
        beyond = [np.log1p((d >= k).sum()) for k in TOXIC_STEPS] + [np.log1p((d <= -k).sum()) for k in ORDINARY_STEPS]
        return [*beyond, max(0, d.max(initial=0)) ** 0.5, float(np.clip(d, -8, 8).sum()) / n, np.log(n), float(np.clip(d - 1, 0, None).sum()) / n**0.5]


def plain(found: list[str], size: int, random: np.random.Generator) -> bytes:
    """Windows drawn at random, as one text of at most ``size`` bytes."""
    drawn = found if len(found) <= size // 4 else [found[i] for i in random.choice(len(found), size // 4, replace=False)]
    return b"".join(map(_bytes, drawn))[-size:]


def trained(found: list[str]) -> bytes:
    """A dictionary by zstandard's trainer; all of the windows if they are too few for it."""
    samples = [w.ljust(8) for w in map(_bytes, found)]  # the trainer leaves out shorter ones
    try:
        return zstandard.train_dictionary(min(TRAINED, sum(map(len, samples))), samples, k=24, d=6, steps=4).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-TRAINED:]


class _Training:
    """Dictionaries from folds of windows: folds[k] holds the ordinary and the toxic windows of fold k."""

    def __init__(self, folds: list[tuple[list[str], list[str]]]):
        self.folds, self.known = folds, {}

    def dictionaries(self, of: tuple[int, ...], rounds: int) -> tuple[bytes, bytes]:
        """(ordinary, toxic) from the folds ``of``, whose windows each are selected by dictionaries of the rest of them."""
        if (of, rounds) not in self.known:
            random = np.random.default_rng([rounds, *of])
            all_of = [[w for k in of for w in self.folds[k][c]] for c in (0, 1)]
            if rounds == 0 or len(of) == 1:
                made = plain(all_of[0], PLAIN, random), plain(all_of[1], PLAIN, random)
            else:
                kept = [], []
                for k in of:
                    distances = Distances(*self.dictionaries(tuple(x for x in of if x != k), rounds - 1))
                    for c, sign in ((0, 1), (1, -1)):
                        found = self.folds[k][c]
                        order = np.argsort(sign * distances.of(found), kind="stable")[: int(len(found) * SHARE) + 1]
                        kept[c].extend(found[i] for i in order)
                base = plain(all_of[0], BASE, random)
                made = base + trained(kept[0]), base + trained(kept[1])
            self.known[of, rounds] = made
        return self.known[of, rounds]


def fit(sample: pd.DataFrame) -> dict | None:
    """The model from rows (text, toxic) in a fixed order; None if there are fewer than FOLDS of either class."""
    toxic = sample["toxic"].to_numpy() == 1
    if min(toxic.sum(), (~toxic).sum()) < FOLDS:
        return None
    fold = np.zeros(len(sample), int)  # each class is dealt over all folds
    for c in (toxic, ~toxic):
        fold[c] = np.arange(c.sum()) % FOLDS
    texts, random, folds = list(sample["text"]), np.random.default_rng(0), []
    for k in range(FOLDS):
        own = [[w for t, f, y in zip(texts, fold, toxic, strict=True) if f == k and y == c for w in windows(t)] for c in (False, True)]
        folds.append(tuple(x if len(x) <= WINDOWS else [x[i] for i in random.choice(len(x), WINDOWS, replace=False)] for x in own))
    training, everything = _Training(folds), tuple(range(FOLDS))
    x = np.zeros((len(texts), len(Distances(b"", b"").features(""))))
    for k in everything:  # each fold is measured with the dictionaries of the others
        distances = Distances(*training.dictionaries(tuple(f for f in everything if f != k), ROUNDS))
        x[fold == k] = [distances.features(t) for t, f in zip(texts, fold, strict=True) if f == k]
    ordinary, of_toxic = training.dictionaries(everything, ROUNDS)
    mean, scale, w = logistic(x, toxic.astype(float), PENALTY)
    return {"ordinary": ordinary, "toxic": of_toxic, "mean": mean.tolist(), "scale": scale.tolist(), "weights": w.tolist()}


def train(df: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict | None:
    """Fits on up to SAMPLE labelled documents of each class for which ``usable`` (over the id) holds, in one task. Of rows that
    repeat an id one text counts, the least; of its labels the greatest; null ids, texts and other labels don't count."""
    marked = labels.where(usable & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    first = [marked.where((F.col("toxic") == c) & F.col("id").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for c in (0, 1)]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(first[0].unionByName(first[1])), "id")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).where("text is not null")
    schema = "ordinary binary, toxic binary, mean array<double>, scale array<double>, weights array<double>"

    def one(sample):
        model = fit(sample.sort_values(["h", "id"]).reset_index(drop=True))
        return pd.DataFrame([model] if model else [], columns=["ordinary", "toxic", "mean", "scale", "weights"])

    found = rows.withColumns({"h": F.xxhash64("id"), "all": F.lit(0)}).groupBy("all").applyInPandas(one, schema).collect()
    return found[0].asDict() if found else None


def score(df: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and score (0 to 1) of each row. A text without letters, null or empty, has no window and gets the score
    of such; without a model (too few labels of either class) every score is 0. Rows aren't joined or grouped, so repeated
    rows and null ids stay and equal texts get equal scores; only the two columns are read, whatever others are called."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        distances = Distances(bytes(model["ordinary"]), bytes(model["toxic"])) if model else None
        for batch in batches:
            if distances is None:
                p = np.zeros(batch.num_rows)
            else:
                x = np.array([distances.features((t.as_py() or b"").decode("utf-8", "replace")) for t in batch.column(1)]).reshape(batch.num_rows, -1)
                p = probability(x, tuple(np.array(model[k]) for k in ("mean", "scale", "weights"))) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["id", "score"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
