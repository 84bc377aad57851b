import codecs
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from threadloom.llm.bpe import Codec, Utf8Machine, encode_documents, merge, read_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(PATH)
CODEC = Codec(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_like_the_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert b"".join(CODEC.decode(CODEC.encode(text))) == text.encode()


@pytest.mark.parametrize("alphabet", ["ab", "aeinrst ", "étionaux", "1234567890", "=-#*!", " \n\t", "日本語テスト"])
def test_long_pieces_like_the_library(alphabet):
    rng = random.Random(alphabet)
    for n in (1, 2, 7, 30, 200, 3000):
        for _ in range(10):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert ids(text) == LIBRARY.encode_ordinary(text)


def test_transducer_is_the_merges():
    rng = random.Random(3)
    for _ in range(300):
        piece = bytes(rng.choice(b"thereinga") for _ in range(rng.randint(1, 40)))
        if piece not in RANKS:
            assert tuple(CODEC.fst.encode(piece)) == merge(piece, RANKS)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(0, 40)))
def test_machine_like_the_standard_decoder(data, cuts):
    machine, standard, got, want = Utf8Machine(), codecs.getincrementaldecoder("utf-8")("replace"), "", ""
    at = 0
    for cut in [*sorted(min(c, len(data)) for c in cuts), len(data)]:
        got += machine.feed(data[at:cut])
        want += standard.decode(data[at:cut])
        at = cut
    assert got + machine.feed(b"", final=True) == want + standard.decode(b"", final=True)


def test_documents(spark):
    texts = [None, "", "a" * 50_000, "  x\n\n y ", "Ünïcödé ☃ 🙂🙂", "the the", "the the"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = {r.doc_id: r for r in encode_documents(docs, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        want = LIBRARY.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(want)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert rows[i].valid_utf8
    assert encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_states_are_few():
    """Words made of common parts: states are sets of trie nodes, whatever tokens came before them."""
    rng, codec = random.Random(8), Codec(RANKS, public_tokenizers.PATTERN)
    parts = ["th", "er", "tion", "ing", "on", "re", "sch", "ung", "heit", "an", "st", "ä", "pf", "wh", "ble", "in", "le", "es"]
    words = [" " + "".join(rng.choice(parts) for _ in range(rng.randint(2, 6))) for _ in range(20_000)]
    got = [np.frombuffer(codec.encode(w), "<u4").tolist() for w in words]
    assert got == [LIBRARY.encode_ordinary(w) for w in words]
    assert len(codec.fst.paths) < 3000
