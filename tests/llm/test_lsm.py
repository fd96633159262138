import hashlib
from collections import defaultdict

import pytest

from vellumspark.llm import lsm

LOW = str.maketrans(lsm.UPPER, lsm.LOWER)


def brute(rows, keep, digest_bytes=32):
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(LOW)].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        stays = (min if keep == "min" else max)(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()[: 2 * digest_bytes]
        out += [(i, stays, len(ids), i == stays, sha) for i in ids]
    return sorted(out, key=repr)


ROWS = [(1, "Abc"), (2, "aBC"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 200000), (8, "X" * 200000), (9, "only"), (9, "only"), (None, "only"), (None, "null id"), (None, "NULL id"), (10, "abc")]


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_against_brute_force(spark, keep, digest_bytes, monkeypatch):
    rows = ROWS + [(100 + i, f"text {i % 211}") for i in range(900)]
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, digest string, keep int").repartition(7)
    got = lsm.deduplicate(df, keep=keep, digest_bytes=digest_bytes)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, keep, digest_bytes)


def test_empty_and_hot(spark):
    assert lsm.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    hot = spark.range(20000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', concat('t', id)) as text").repartition(9)
    got = lsm.deduplicate(hot, keep="max")
    assert got.where("kept").count() == 20000 - 6667 + 1
    assert got.where("group_size = 6667 and keep_id = 19998").count() == 6667


def test_more_hits_than_the_filter_has_bits_for(spark, monkeypatch):
    monkeypatch.setattr(lsm, "FILTER_BITS", 1 << 15)
    rows = [(i, f"text {i % 9000}" if i < 18000 else f"only {i}") for i in range(20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, lsm.deduplicate(df).collect()), key=repr) == brute(rows, "min")


def test_filter_keeps_every_hit(spark, monkeypatch):
    monkeypatch.setattr(lsm, "FILTER_BITS", 1 << 16)
    for n in (1, 3000, 60000):
        digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        probes, bits = lsm._bloom(spark.createDataFrame([(d,) for d in digests], "digest binary").repartition(3), n).value
        assert 1 <= probes <= lsm.PROBES and len(bits) * 8 <= 1 << 16
        assert all(bits[p >> 3] >> (p & 7) & 1 for d in digests for p in lsm._positions(d, len(bits) * 8, probes))
