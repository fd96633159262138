"""Quality classifier by hierarchical empirical Bayes (operator 5).

A logistic regression on properties of the whole text gives a document's probability of being good. The evidence of
a site (its label where a document has one, else that probability) is summed for each host and for each path of a
host. A host's posterior is drawn to the global prior, a path's to its host's, by a strength that the spread between
hosts and between paths decides; a sparse site so keeps close to what is above it. The document's posterior odds
are its own odds times those of its path over the prior's.

The regression is fitted on a bounded sample of labelled rows; sites and prior cover all rows.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.kept import kept
from vellumspark.llm.models import logistic, probability
from vellumspark.llm.store import saved

#: Labelled rows that the regression is fitted on at most: those of the least hash of their id.
SAMPLE = 20_000

#: For each code point of the first plane: 0 space, 1 upper case, 2 other letter, 3 digit, 4 anything else.
_KIND = np.full(0x10000, 4, np.uint8)
for _c in range(0x10000):
    _s = chr(_c)
    _KIND[_c] = 0 if _s.isspace() else (1 if _s.isupper() else 2) if _s.isalpha() else 3 if _s.isdigit() else 4
N_FEATURES = 8


def features(text: str | None) -> tuple[float, ...]:
    """Of a text with words: distinct words, words equal to the one before, upper case, digits and other signs (as shares), length of
    words, of the text, and the largest share of one word. Without words: NaN."""
    words = (text or "").split()
    if not words:
        return (float("nan"),) * N_FEATURES
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    _, upper, lower, digits, other = np.bincount(_KIND[np.minimum(points, 0xFFFF)], minlength=5)
    seen = upper + lower + digits + other
    n, distinct = len(words), len(set(words))
    again = sum(map(eq, words, words[1:])) / n
    return (distinct / n, again, upper / max(1, upper + lower), digits / seen, other / seen, seen / n, np.log1p(n), np.log(n / distinct))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, mean: str, prior: str, n: str) -> float:
    """How many documents the prior of a site counts: that of a beta distribution whose variance between sites is the
    measured one, less what the sites' sizes explain."""
    spread = sites.where(f"{n} > 1").agg(
        F.sum(F.col(n) * F.pow(F.col(mean) - F.col(prior), 2)).alias("between"),
        F.sum(F.col(prior) * (1 - F.col(prior))).alias("within"),
        F.sum(F.col(n)).cast("double").alias("n"),
        F.avg(F.col(prior) * (1 - F.col(prior))).alias("p"),
    ).first()
    if not spread.n:
        return 10.0
    variance = max((spread.between - spread.within) / spread.n, 1e-7)
    return float(min(max(spread.p / variance - 1, 1.0), 1e6))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple | None:
    """The regression; None unless there are labels of both kinds."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    some = marked.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), "_id").select("_y", _features_of("_text").alias("x")).collect()
    rows = [r for r in rows if not np.isnan(r.x[0])]
    y = np.array([r._y for r in rows], float)
    if len(y) == 0 or y.min() == y.max():
        return None
    return logistic(np.array([r.x for r in rows]), y)


def _features_of(column: str) -> Column:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        kept("quality", dict)  # frees what another operator has kept in this worker
        return pd.Series([list(map(float, features(t))) for t in texts])

    return of.asNondeterministic()(F.col(column))


def assess(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """docs with _p_document, _host_posterior, _path_posterior, _posterior and _rejected (posterior below a half).

    ``host`` and ``path`` are columns of docs; null counts as a site of its own. A text without words, null or empty,
    has the probability 0 and is rejected. Without labels of both kinds every other text has a half and stays. Rows
    that repeat an id stay, and share a label. Other columns of docs stay, whatever their names; one of a name that is added is refused.
    """
    model = fit(docs, labels, id_col, text_col, label_col)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        kept("quality", dict)
        x = np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES)
        p = np.full(len(x), 0.5) if model is None else probability(np.nan_to_num(x), model)
        return pd.Series(np.where(np.isnan(x[:, 0]), 0.0, p))

    extra = {"_p_document", "_host_posterior", "_path_posterior", "_posterior", "_rejected"} & set(docs.columns)
    if extra:
        raise ValueError(f"docs have columns of the names that are added: {sorted(extra)}")
    host_name, path_name = (next(n for n in (f"_{x}" + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns) for x in ("host", "path"))
    named = docs.withColumns({host_name: F.coalesce(host.cast("string"), F.lit("")), path_name: F.coalesce(path.cast("string"), F.lit(""))})
    # Called nondeterministic, as the optimizer may else run it a second time for a filter, in a second worker.
    scored = named.withColumn("_p_document", of.asNondeterministic()(F.col(text_col)))
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("_y"))
    evidence = saved(scored.select(F.col(id_col).alias("_id"), F.col(host_name).alias("_host"), F.col(path_name).alias("_path"), "_p_document"), "evidence").join(marked, "_id", "left")
    paths = saved(evidence.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum(F.coalesce("_y", "_p_document")).alias("good")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    prior = min(max((total.good / total.n) if total.n else 0.5, 1e-6), 1 - 1e-6)
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n_host"), F.sum("good").alias("good_host")).withColumns({"mean": F.col("good_host") / F.col("n_host"), "prior": F.lit(prior)})
    strength = _strength(hosts, "mean", "prior", "n_host")
    hosts = hosts.select("_host", ((F.col("good_host") + strength * prior) / (F.col("n_host") + strength)).alias("_host_posterior"))
    both = paths.join(hosts, "_host").withColumn("mean", F.col("good") / F.col("n"))
    strength = _strength(both, "mean", "_host_posterior", "n")
    sites = saved(both.select("_host", "_path", "_host_posterior", ((F.col("good") + strength * F.col("_host_posterior")) / (F.col("n") + strength)).alias("_path_posterior")), "sites")
    odds = _logit(F.col("_p_document")) + _logit(F.col("_path_posterior")) - _logit(F.lit(prior))
    sites = sites.withColumnsRenamed({"_host": host_name, "_path": path_name})
    out = scored.join(sites, [host_name, path_name]).withColumn("_posterior", F.when(F.col("_p_document") == 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-odds))))
    return out.withColumn("_rejected", F.col("_posterior") < 0.5).drop(host_name, path_name)


def site(column: str) -> tuple[Column, Column]:
    """(host, path) of a source or URL: what precedes the first slash after a scheme, and the rest without its last part."""
    bare = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1)), F.regexp_extract(bare, r"^[^/?#]*(/[^?#]*)/[^/?#]*", 1)
