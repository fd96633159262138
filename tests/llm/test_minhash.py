import random

import numpy as np
import pytest

from vellumspark.llm import minhash, shingles


def brute(rows, words, percent):
    """doc_id -> (n_shingles, component) over all pairs of sets of word tuples."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    of = {i: i for i in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = root(x), root(y)
                of[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def rows_with_copies(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [r.choice(vocabulary) for _ in range(120)]
    rows = []
    for k in range(260):  # one large group whose members are linked with some of the others only
        w = [r.choice(vocabulary) if r.random() < r.choice([0.01, 0.05, 0.08, 0.15]) else x for x in base]
        rows.append(" ".join(w))
    for _ in range(60):
        w = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 9, 40]))]
        rows += [" ".join(w), " ".join(w).upper(), " ".join(w[:-1]), " ".join([*w, "more"])]
    rows += [None, "", " \t\n", "One", "one", "É é", "é é", "a b", "b a", "long " * 5000, "long " * 4000, "x" * 100000]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "words", "few"), [(1, 2, 64), (2, 2, 2), (3, 5, 64)])
def test_components_against_all_pairs(spark, monkeypatch, seed, words, few):
    monkeypatch.setattr(minhash, "FEW", few)
    rows = rows_with_copies(seed)
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in rows], "doc_id long, text string, component long, bucket string").repartition(5)
    truth = brute(rows, words, 80)
    got = minhash.near_duplicates(df, words=words, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == truth
    assert len(got) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_empty_null_and_repeated_ids(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, "a b c"), (7, "A B c")], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df, words=2).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert got == sorted([(None, 2, None, True)] * 2 + [(4, 2, 4, True)] * 2 + [(7, 2, 4, False)], key=repr)


def test_densified_sketches_estimate_similarity():
    r = np.random.default_rng(0)
    for n in (5, 40, 1000):
        both = r.integers(0, 2**63, (200, n + n // 5)).astype(np.uint64)
        same = [np.mean(minhash.sketch(np.sort(x[: len(x) - n // 10])) == minhash.sketch(np.sort(x[n // 10 :]))) for x in both]
        true = (n + n // 5 - 2 * (n // 10)) / (n + n // 5)
        assert abs(np.mean(same) - true) < 0.06


def test_components_of_a_chain_and_a_star(spark):
    links = spark.range(60).selectExpr("id as a", "id + 1 as b").unionByName(spark.range(60).selectExpr("1000L as a", "1001 + id as b"))
    got = {r.id: r.component for r in minhash.components(links).collect()}
    assert {0: 0, 1000: 1000} | got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(61)}


def test_shingles():
    assert len(shingles.shingle_set("a b a b a".encode(), 2)) == 2
    assert len(shingles.shingle_set(b"one", 5)) == 1 and len(shingles.shingle_set(None, 5)) == 0
    a, b = (np.unique(np.array(x, np.uint64)) for x in ([1, 2, 3, 9], [2, 9, 10]))
    assert shingles.shared_count(a, b) == 2
