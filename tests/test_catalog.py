import duckdb
import pytest

import __spark_entry__ as entry
from vellumspark.plans import catalog

TABLES = "documents pages labels benchmark".split()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_duckdb(spark, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = db.sql(catalog.SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = db.sql(f"select {', '.join(names)} from ({catalog.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(rows, key=str)


def test_entry(spark):
    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_encodings_of_all_documents(spark, tmp_path):
    """Against brute force: every document has its row, also those that the SQL leaves out."""
    texts = ["un goût sûr", "il a dû, ça va", "Õhtu", "plain", "café", None, "", "Û à la carte", "âpre", "\xfb"]
    rows = [(4 * i + k, t) for i, t in enumerate(texts) for k in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def want(i, t):
        if t is None:
            return None, None, None
        if i % 4 < 3:
            return ["utf-8", "utf-16le", "utf-16be"][i % 4], t, 1.0
        if set(t) & set("õû") and not set(t) & set("àâçëïñ"):
            return "windows-1250", t.encode("latin-1").decode("cp1250"), 0.7
        return ("utf-8" if t.isascii() else "windows-1252"), t, 0.7

    def row(r):
        return (r.encoding, r.text, r.confidence)

    got = {r.doc_id: row(r) for r in catalog.detect_encoding(spark, str(tmp_path)).collect()}
    assert got == {i: want(i, t) for i, t in rows}


def test_detect_encoding_sql_on_all_cases(spark, tmp_path):
    """The SQL has the rows of windows-1250 too; one-byte texts with C1 characters follow the code page."""
    texts = ["un goût sûr", "il a dû, ça va", "Õhtu", "plain", "café", None, "", "Û à la carte", "âpre", "\xfb", "õ \x80\x8a\xb9\xa5 z", "é \x80\x99"]
    spark.createDataFrame([(4 * i + k, t) for i, t in enumerate(texts) for k in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("detect_encoding", "bom_detect"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        names = sorted(got.columns)
        rows = db.sql(f"select {', '.join(names)} from ({catalog.SQL[name]})").fetchall()
        assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(rows, key=str)
