import numpy as np
from pyspark.sql import functions as F

from vellumspark.llm import models, quality, registry


def test_on_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = registry.op5_quality(spark, d)
    assert rows.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    both = rows.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, bad = [r.rejected for r in both if r.quality], [r.rejected for r in both if not r.quality]
    assert sum(good) <= 0.02 * len(good) and sum(bad) >= 0.8 * len(bad)


def test_sparse_sites_keep_close_to_what_is_above(spark):
    rows = [(i, f"some ordinary words number {i} of a text", "big/a/x" if i % 2 else "big/b/x") for i in range(400)] + [(1000, "some ordinary words", "new/a/x"), (1001, None, None), (1002, "", "big/a/x"), (1001, "again of one id", "big/a/x"), (None, "null id", "big/a/x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0 or i % 5 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = quality.assess(docs, labels, *quality.site("source"))
    assert out.columns[:3] == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    prior = by[1000]._host_posterior
    assert by[0]._path_posterior > prior > by[1]._path_posterior
    assert abs(by[1000]._path_posterior - prior) < 0.05
    assert by[1002]._rejected and by[1002]._posterior == 0


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a text", "s"), (2, None, "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r._rejected for r in quality.assess(docs, labels, *quality.site("source")).collect()}
    assert got == {1: False, 2: True}
    assert quality.assess(docs.limit(0), labels, *quality.site("source")).count() == 0


def test_sites(spark):
    df = spark.createDataFrame([("https://A.example.org/x/y/z.html?q#t",), ("src0",), (None,), ("h/p",)], "u string")
    host, path = quality.site("u")
    assert [tuple(r) for r in df.select(host, path).collect()] == [("a.example.org", "/x/y"), ("src0", ""), ("", ""), ("h", "")]


def test_forest_and_regression():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    forest = models.Forest.fit(x[:400], y[:400])
    assert (((forest.predict(x[400:]) > 0.5) == y[400:]).mean()) > 0.85
    p = models.probability(x, models.logistic(x, (x[:, 2] > 0.3).astype(float)))
    assert ((p > 0.5) == (x[:, 2] > 0.3)).mean() > 0.95
