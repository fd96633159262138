import math
import random
import unicodedata

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import models

from vellumspark.llm import language, registry, toxicity, wordpiece
from vellumspark.llm.models import probability

PIECES = wordpiece.read_pieces(P.path("piece_bpe_32k.model"))
COUNTS = wordpiece.Automaton(PIECES)
TRUE = models.WordPiece(vocab={"<unk>": 0} | {p: i + 1 for i, p in enumerate(PIECES)}, unk_token="<unk>", max_input_chars_per_word=10**9, continuing_subword_prefix="")


def greedy(word):
    found = TRUE.tokenize("▁" + word)
    return -1 if [t.value for t in found] == ["<unk>"] else len(found)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdehinorstéñ,.0-☃"), min_size=1, max_size=30))
def test_counts_of_words(word):
    assert COUNTS.count("▁" + word) == greedy(word)


def test_counts_of_a_small_trie():
    a = wordpiece.Automaton(["a", "abcdx", "b", "c", "cdy", "dz"])
    assert [a.count(w) for w in ("abcdz", "abcdy", "abcd", "ab", "q", "abcdx")] == [4, 3, -1, 2, -1, 1]


def test_counts_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in registry.op9_token_counts(spark, sf_dir).collect()}
    for r in docs.collect():
        n = [greedy(w) for w in r.text.split()]
        assert got[r.doc_id] == (len(n), sum(abs(x) for x in n), n.count(-1))
    edge = spark.createDataFrame([(1, None, 1), (None, "", 2), (3, "hello " * 50000, 3), (3, "\U0010fffd", 4)], "doc_id long, text string, n_words int")
    assert [tuple(r)[1:] for r in wordpiece.token_counts(edge, PIECES).collect()] == [(0, 0, 0), (0, 0, 0), (50000, 50000 * greedy("hello"), 0), (1, 1, 1)]
    assert wordpiece.token_counts(edge.where("false"), PIECES).count() == 0


def test_held_out_language(spark):
    rows = registry.op10_language(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = rows.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.9


def test_language_by_brute_force(spark, sf_dir):
    """The nearest centroid of every document again: trigrams counted in a dictionary, cosines summed one by one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in language.identify(docs, model, reject=False).collect()}
    for r in docs.collect():
        letters = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (r.text or "").lower())
        cells = {}
        edge = " " + (" " if letters[:1] == " " else "") + " ".join(letters.split()) + (" " if letters[-1:] == " " else "") + " "
        for i in range(len(edge) - 2):
            a, b, c = (ord(x) for x in edge[i : i + 3])
            h = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
            h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
            cells[h >> 19] = cells.get(h >> 19, 0) + 1
        v = {k: (1 + math.log(n)) * model["idf"][k] for k, n in cells.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        near = [sum(x * float(c[k]) for k, x in v.items()) / size for c in model["centroids"]]
        if not any(unicodedata.category(c)[0] == "L" for c in r.text):
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        assert abs(got[r.doc_id].score - max(0, max(near))) < 1e-4
        best = {model["langs"][model["of"][k]] for k, x in enumerate(near) if x > max(near) - 1e-5}
        assert got[r.doc_id].lang_pred in best


def test_marks_alone_have_no_language():
    assert language.counts("\u0301\u0302") is None and language.counts("e\u0301") is not None


def test_language_edges(spark):
    texts = ["the cat and the dog", "der Hund und die Katze", None, "", "123 ... !!", "x" * 200000, "the", "日本語"]
    df = spark.createDataFrame([(i, t, "en" if i % 2 == 0 else "de", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score double")
    model = language.train(df.where("doc_id < 2"), F.lit(True))
    got = {r.doc_id: r for r in language.identify(df, model, reject=False).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["en", "de", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[7].lang_pred in ("en", "de")
    assert {r.doc_id: r.lang_pred for r in language.identify(df, model).collect()}[7] == "und"
    assert language.train(df.limit(0), F.lit(True)) is None
    assert {r.lang_pred for r in language.identify(df, None).collect()} == {"und"}
    assert language.identify(df.limit(0), model).count() == 0


def test_toxicity(spark):
    words = [f"{a}{b}{c}en" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows = []
    for i in range(400):
        text = [words[(i * 7 + k * k * 3) % len(words)] for k in range(30 + i % 50)]
        if i % 4 == 0:
            text[i % 20] = text[25] = ["nastyword", "Vilething"][i // 4 % 2]
        rows.append((i, " ".join(text), "clash"))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(9999, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert [i for i in range(400) if (got[i] >= 0.7) != (i % 4 == 0)] == []
    edge = spark.createDataFrame([(1, None), (2, ""), (None, "... 12"), (4, "word " * 100000), (5, "nastyword")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score(edge, model).collect()}
    assert all(0 <= s < 0.5 for i, s in score.items() if i != 5)
    assert toxicity.train(df, labels.where("toxic = 0"), F.lit(True)) is None
    assert [r.score for r in toxicity.score(edge.limit(2), None).collect()] == [0, 0]
    assert toxicity.score(edge.limit(0), model).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_toxicity(spark, sf):
    rows = registry.op7_toxicity(spark, f"/root/testdata/{sf}").join(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in rows if r.toxic]
    clean = [r.predicted for r in rows if not r.toxic]
    assert sum(toxic) >= 0.5 * len(toxic) and sum(clean) <= 0.03 * len(clean)


@pytest.mark.parametrize("letters, bad", [("的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会", "毒骂辱贱滚蛋"), ("abcdefghiklmnoprstu", "vwxyzzyxwvxvzwyyvxz")])
def test_toxic_passage_at_the_end_of_an_unspaced_text(letters, bad):
    r = random.Random(4)
    rows = [("".join(r.choice(letters) for _ in range(300 + i % 90)) + (bad if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    model = toxicity.fit(pd.DataFrame(rows[:240], columns=["text", "toxic"]))
    distances = toxicity.Distances(model["ordinary"], model["toxic"])
    p = probability(np.array([distances.features(t) for t, _ in rows[240:]]), tuple(np.array(model[k]) for k in ("mean", "scale", "weights")))
    assert np.mean([(x >= 0.7) == (t == 1) for x, (_, t) in zip(p, rows[240:], strict=True)]) > 0.97


def test_score_by_brute_force(spark):
    """Every score again from the model: each window of the whole text compressed on its own, nothing kept."""
    r = random.Random(3)
    syllables = "ba ne tor li sen ka mo ri vun pel".split()

    def babble(n):
        return ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]

    rows = []
    for i in range(320):
        text = babble(20 + i % 60)
        if i % 4 == 0:
            text[i % 20] = text[10] = r.choice(["nasty", "nastily", "vilest", "vileness"])
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    rows += [(1000, None, 0), (1001, "", 0), (1002, "x" * 3000 + " " + " ".join(babble(30000)) + " nasty vilest", 1), (1003, "12 ?", 0), (None, "nasty vilest", 1), (1003, "12 ?", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"), F.col("doc_id") < 240)
    ordinary, toxic = (toxicity._compressor(bytes(model[k])) for k in ("ordinary", "toxic"))

    def score(text):
        pieces = []
        for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            pieces += [w] if len(w) <= 24 else [w[k : k + 24] for k in range(0, len(w) - 12, 12)]
        pieces = set(pieces)
        d = [len(ordinary(b" " + w.encode() + b" " + bytes(40))) - len(toxic(b" " + w.encode() + b" " + bytes(40))) for w in pieces]
        n = max(1, len(d))
        x = [np.log1p(sum(v >= k for v in d)) for k in (1, 2, 3, 4, 6)] + [np.log1p(sum(v <= -k for v in d)) for k in (1, 2, 3, 4)]
        x += [max([0, *d]) ** 0.5, sum(min(max(v, -8), 8) for v in d) / n, np.log(n), sum(max(0, v - 1) for v in d) / n**0.5]
        z = sum((v - m) / s * w for v, m, s, w in zip(x, model["mean"], model["scale"], model["weights"], strict=False)) + model["weights"][-1]
        return 1 / (1 + np.exp(-z))

    got = sorted((str(r.doc_id), r.score) for r in toxicity.score(df, model).collect())
    want = sorted((str(i), score(t)) for i, t, _ in rows)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-9)
    assert np.mean([(x >= 0.5) == (i % 4 == 0) for i, x in ((int(i), x) for i, x in got if i.isdigit()) if 240 <= i < 320]) >= 0.9


def test_no_letter_is_left_out():
    text = "short " + "ab" * 40 + " " + "的一是在不了有和人这中大"
    assert toxicity.windows(text)[0] == "short"
    long = toxicity.windows("".join(chr(97 + k % 26) for k in range(100)))
    assert long[0] + "".join(w[12:] for w in long[1:]) == "".join(chr(97 + k % 26) for k in range(100))
    assert set("".join(toxicity.windows(text))) == set(text) - {" "}
    assert toxicity.windows(None) == toxicity.windows("12 ?!") == []


def test_one_match_shows_in_a_short_window():
    r = random.Random(1)
    shown = 0
    for _ in range(300):
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(2000)]
        distances = toxicity.Distances(toxicity.plain(words[:1000], 1 << 14, np.random.default_rng(1)), toxicity.plain(words[1000:], 1 << 14, np.random.default_rng(1)))
        shown += distances[r.choice(words[1000:])] > 0
    assert shown >= 290
