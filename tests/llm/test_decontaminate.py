import random
import re
from collections import Counter

from vellumspark.llm import decontaminate as d


def grams(words, k=5):
    k = min(k, len(words))
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if words else []


def brute(docs, items, threshold=0.8):
    """(doc, item) -> best similarity over all windows of the item's size."""
    found = {}
    for i, text in docs:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        for j, item in items:
            v = re.findall(r"[^\W_]+", (item or "").lower())
            if not v:
                continue
            b = Counter(grams(v))
            n, size = len(grams(v)), len(v)
            for s in range(max(1, len(w) - size + 1)):
                a = Counter(grams(w[s : s + size], min(5, size)))
                if sum(a.values()) == 0:
                    continue
                both = sum((a & b).values())
                sim = both / (sum(a.values()) + n - both)
                if sim >= threshold - 1e-12 and sim > found.get((i, j), (0, 0))[0] + 1e-12:
                    found[i, j] = (sim, s)
    return {k: (round(v[0], 9), v[1]) for k, v in found.items()}


def test_against_all_windows(spark):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(j, " ".join(r.choice(vocabulary) for _ in range(r.choice([6, 15, 30, 50])))) for j in range(12)]
    items += [(20, "alpha beta"), (21, None), (22, ""), (23, "x y z x y z x y z x y z x y z"), (24, "...")]
    docs = []
    for i in range(90):
        w = [r.choice(vocabulary) for _ in range(r.choice([0, 3, 20, 120]))]
        item = r.choice(items[:12] + items[15:16])[1].split()
        if i % 3:
            if i % 2 and len(item) > 20:
                item[r.choice([0, 1, len(item) - 1, len(item) // 2])] = "changed"
            at = r.randrange(len(w) + 1)
            w[at:at] = item
        docs.append((i, ", ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    docs += [(200, "say ALPHA, beta now"), (201, None), (202, ""), (203, "w1 " * 30000 + items[2][1]), (None, items[3][1]), (204, items[3][1]), (204, items[3][1])]
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in docs], "doc_id long, text string, item_id int, key string").repartition(4)
    bench = spark.createDataFrame([(j, t, 1) for j, t in items], "item_id long, text string, doc_id int")
    got = {(x.doc_id, x.item_id): (round(x.similarity, 9), x.start) for x in d.contaminations(df, bench).collect()}
    truth = brute([x for x in docs if x[0] != 203], items) | {(203, 2): (1.0, 30000)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in truth.items()}
    clean = d.decontaminate(df, bench)
    assert clean.columns == df.columns
    bad = {k[0] for k in truth}
    assert sorted(map(str, [x.doc_id for x in clean.collect()])) == sorted(str(i) for i, _ in docs if i not in bad)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert d.contaminations(docs.limit(0), bench).count() == 0
    assert d.contaminations(docs, bench.where("false")).count() == 0
    assert d.decontaminate(docs, bench.where("false")).count() == 1
    assert d.decontaminate(docs, bench).count() == 0


def test_fingerprint_is_the_majority_of_bits(spark):
    from pyspark.sql import functions as F

    hashes = [5, -7, 1 << 62, 123456789, -1]
    got = spark.range(1).select(d.fingerprint(F.array(*(F.lit(h).cast("long") for h in hashes))).alias("f")).first().f
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert got % (1 << 64) == want
