import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumspark.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
TRUE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MACHINE = bpe.Transducer(RANKS)


@pytest.mark.parametrize("piece", [" antidisestablishmentarianism", " ñasquerrariesciónlly", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", " " * 300, "-=" * 200, "ééééüüüßß" * 40, "你好世界" * 20, "x" * 5000])
def test_pieces_as_the_library_encodes_them(piece):
    assert list(MACHINE.encode(piece.encode())) == TRUE._encode_single_piece(piece)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdehinorst éñßü0123!-_ =\n"), min_size=1, max_size=60))
def test_any_piece(piece):
    assert list(MACHINE.encode(piece.encode())) == TRUE._encode_single_piece(piece)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40))
def test_utf8_machine_replaces_as_python_does(raw):
    decoder = bpe.Decoder({i: bytes((i,)) for i in range(256)})
    assert decoder.decode(raw) == raw.decode("utf-8", "replace")


def test_streaming_decode_is_the_same_in_any_pieces():
    ids = TRUE.encode_ordinary("naïve 你好 🙂 text")
    decoder = bpe.Decoder(MACHINE.token)
    text = "".join(decoder.feed([i]) for i in ids) + decoder.flush()
    assert text == "naïve 你好 🙂 text"


def check(rows, texts):
    for row, text in zip(rows, texts, strict=True):
        ids = TRUE.encode_ordinary(text or "")
        assert (row.n_tokens, row.ids) == (len(ids), ids)
        assert row.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_edges(spark):
    texts = [None, "", "a", "a", "<|endoftext|> isn't special", "word " * 30000, "z" * 100000, " \n\t ", "I'll go 123 ñandú 🙂"]
    df = spark.createDataFrame([(i, t, i, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids string")
    check(bpe.encode(df, RANKS, P.PATTERN).orderBy("doc_id").collect(), texts)
    assert bpe.encode(df.where("false"), RANKS, P.PATTERN).count() == 0
    assert bpe.encode(spark.createDataFrame([(None, "x")], "doc_id long, text string"), RANKS, P.PATTERN).first().n_tokens == 1


def test_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in bpe.encode(docs, RANKS, P.PATTERN).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    check([got[r.doc_id] for r in rows], [r.text for r in rows])


def test_moves_are_bounded_inside_a_pre_token():
    r = random.Random(2)
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20000)).encode()
    small, full = bpe.Transducer(RANKS, 500), bpe.Transducer(RANKS, 1 << 30)
    assert small.encode(word) == full.encode(word) and small.n_moves <= 500 < full.n_moves and len(small.states) <= 502


def test_words_of_different_beginnings_share_states():
    r = random.Random(3)
    words = [" " + "".join(r.choice(["th", "he", "an", "in", "er", "on", "re", "nd", "ing", "ti"]) for _ in range(r.randint(2, 7))) for _ in range(5000)]
    machine, small = bpe.Transducer(RANKS, 1 << 30), bpe.Transducer(RANKS, 300)
    for word in words:
        assert list(machine.encode(word.encode())) == list(small.encode(word.encode())) == TRUE._encode_single_piece(word.encode())
    assert len(machine.states) < 5000 and len(small.states) <= 302


def test_a_merge_must_come_after_its_parts():
    ranks = {bytes((i,)): i + 2 for i in range(256)} | {b"ab": 1, b"abc": 0}
    with pytest.raises(ValueError):
        bpe.Transducer(ranks)
