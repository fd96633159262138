import random
import re
from itertools import combinations

import corpus_pipeline as pipeline
import public_tokenizers

from vellumspark.llm import bpe
from vellumspark.llm.store import saved, table


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_against_brute_force(spark, sf_dir):
    """Each stage on what the one before it kept; the scores of the quality classifier have tests of their own."""
    docs, kept = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"test-{k}")
        kept.append(docs.collect())
    text = [{r.doc_id: r.text for r in rows} for rows in kept[:4]]
    rows = {r.doc_id: tuple(r) for r in table(spark, sf_dir, "documents").collect()}
    assert all(tuple(r) == rows[r.doc_id] for some in kept[:4] for r in some)

    first = {}
    for i in sorted(text[0]):
        first.setdefault(lowered(text[0][i]), i)
    assert set(text[1]) == set(first.values())

    sets, around = {i: shingles(t) for i, t in text[1].items()}, {i: i for i in text[1]}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in links:
        for a, b in links:
            around[a] = around[b] = min(around[a], around[b])
    assert set(text[2]) == {i for i, least in around.items() if i == least}

    items = [lowered(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert set(text[3]) <= set(text[2])
    assert not [i for i, t in text[3].items() if any(len(x.split()) >= 5 and x in lowered(t) for x in items)]

    token = {i: t for t, i in bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")).items()}
    assert {r.doc_id: b"".join(token[i] for i in r.ids).decode() for r in kept[4]} == {i: t or "" for i, t in text[3].items()}
    assert all(r.n_tokens == len(r.ids) for r in kept[4])


def test_dedup_of_repeated_and_null_ids(spark, sf_dir):
    def kept(stage, rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        return sorted((tuple(r) for r in stage(spark, docs, sf_dir).collect()), key=str)

    rows = [(0, "p"), (6, "p"), (6, "q"), (1, "A b"), (1, "c d"), (2, "a b"), (None, "a B"), (None, "only"), (None, "only"), (3, "same"), (3, "same"), (4, "c d"), (5, None), (5, ""), (7, "alone")]
    want = [(0, "p"), (6, "q"), (1, "A b"), (1, "c d"), (None, "only"), (3, "same"), (7, "alone")]
    got = kept(pipeline.exact_dedup, rows)
    assert [r for r in got if r[1]] == sorted(want, key=str) and [r[0] for r in got if not r[1]] == [5]

    base = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(2, base + " z"), (2, other), (1, base), (None, base + " w"), (None, "nothing like it at all here"), (3, "x"), (3, "x"), (9, other + " z"), (4, None)]
    want = [(1, base), (2, other), (None, "nothing like it at all here"), (3, "x"), (4, None)]
    assert kept(pipeline.near_dedup, rows) == sorted(want, key=str)


def test_exact_dedup_leaves_lone_texts_where_they_are(spark, sf_dir):
    """Also where what the index found is too large to be broadcast, whole texts of no group aren't shuffled."""
    some = random.Random(7)
    alone = [(i, some.randbytes(20_000).hex()) for i in range(400)]
    twice = [(1000 + i, some.randbytes(30).hex()) for i in range(5)]
    docs = saved(spark.createDataFrame(alone + twice + [(2000 + i, text.upper()) for i, text in twice], "doc_id long, text string"), "lone")

    def shuffled():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    limit, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(tuple(r) for r in pipeline.exact_dedup(spark, docs, sf_dir).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == sorted(alone + twice)
    assert shuffled() - before < 1 << 20
