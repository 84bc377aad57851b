import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from threadloom.llm.packing import Encoder, combinations, padding, pieces, plan, repeats, sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, run string").repartition(parts)


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "Straße", "don't", "x1", "été,", "☃☃", "\n", "", "a\tb", "123456", "(see)", "I'll"])
    return [" ".join(word() for _ in range(rng.choice([0, 1, 3, 40, 300, 900]))) for _ in range(n)]


def check(rows, got, library, window=1024):
    """Every id in one piece, every sequence gapless and no longer than the window."""
    ids = {d: [*library(t), 0] for d, t in rows}
    assert len(ids) == len(rows)
    whole, sequence = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        whole[r.doc_id].append((r.start, r.length))
        sequence[r.sequence_id].append((r.offset, r.length))
    for d, parts in whole.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[d])
    assert set(whole) == set(ids)
    lengths = []
    for parts in sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        lengths.append(at)
    assert padding(lengths, window) == 0
    assert sorted(sequence) == list(range(len(sequence)))
    return lengths


@pytest.mark.parametrize("window", [1024, 64])
def test_contract(spark, library, window):
    rows = list(enumerate(texts(window, 300))) + [(1000, None), (1001, ""), (None, "of no id"), (1002, "long  text \n " * 60_000), (1003, "<|endoftext|> is text"), (1004, "x" * 5000), (1005, "雪" * 3000)]
    rows += [(2000 + i, "the same rest") for i in range(150)]
    got = pieces(frame(spark, rows), PATH, window).collect()
    check(rows, got, library, window)


def test_repeated_rows_and_none(spark, library):
    assert pieces(frame(spark, []), PATH).collect() == []
    got = pieces(frame(spark, [(3, "a b c")] * 500), PATH).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in got)[3, 4] >= 500 and sum(r.length for r in got) == 2000
    assert padding(Counter({s: n for s, n in _lengths(got).items()}).values()) == 0


def _lengths(got):
    out = Counter()
    for r in got:
        out[r.sequence_id] += r.length
    return out


def test_sequences_hold_all_ids(spark, library):
    rows = list(enumerate(texts(5, 60)))
    made = sequences(frame(spark, rows), PATH, 64).collect()
    assert sum(len(r.ids) // 4 for r in made) == sum(len(library(t)) + 1 for _, t in rows)
    assert Counter(x for r in made for x in np.frombuffer(r.ids, "<u4").tolist()) == Counter(x for _, t in rows for x in [*library(t), 0])
    assert all(len(r.ids) == 4 * r.tokens for r in made)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "B1", "'s", "é", "☃", " ", "　", "\x1c", "\x85", ".", " the", "<|endoftext|>", "'ll "]), max_size=40).map("".join))
def test_words_encode_as_the_whole_text(text):
    t = Tokenizer.from_file(PATH) if not hasattr(test_words_encode_as_the_whole_text, "t") else test_words_encode_as_the_whole_text.t
    t.encode_special_tokens = True
    test_words_encode_as_the_whole_text.t = t
    e = getattr(test_words_encode_as_the_whole_text, "e", None) or Encoder(PATH)
    test_words_encode_as_the_whole_text.e = e
    assert np.frombuffer(e.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_long_texts_and_every_letter():
    t, e = Tokenizer.from_file(PATH), Encoder(PATH)
    t.encode_special_tokens = True
    assert e.merger is not None
    for text in ("word  and\nmore, " * 150_000, "x" * 1_200_000, "".join(map(chr, range(0x250))) + " " + " ".join(map(chr, range(0x250)))):
        assert np.frombuffer(e.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 127), st.one_of(st.integers(0, 9), st.integers(0, 10**9)), max_size=40))
def test_every_rest_is_placed_once(counts):
    made = plan(counts, 128)
    total = sum(k * n for k, n in counts.items())
    assert made.sequences == total // 128 + bin(total % 128).count("1")
    assert sum(map(len, made.steps.values())) < 5000
    if sum(counts.values()) < 5000:
        places = Counter((s, o + i) for k, n in counts.items() if k for at in range(n) for take, s, o in made.pieces(k, at) for i in range(take))
        assert len(places) == total and set(places.values()) <= {1}
        lengths = Counter(s for s, _ in places)
        assert all(max(o for s_, o in places if s_ == s) + 1 == n for s, n in list(lengths.items())[:20])
        assert padding(lengths.values(), 128) == 0 and max(lengths.values(), default=0) <= 128


def test_solver_uses_up_what_combines():
    """Rests drawn as whole windows of two and three: the solver leaves little for the residual, and cuts are few."""
    rng = np.random.default_rng(2)
    counts = Counter()
    for _ in range(300):
        a, b = sorted(rng.integers(1, 1023, 2).tolist())
        n = int(rng.integers(50, 500))
        for k in (a, b - a, 1024 - b):
            counts[k] += n if k else 0
    lengths = np.array(sorted(counts))
    histogram = np.zeros(1025)
    histogram[lengths] = [counts[k] for k in lengths.tolist()]
    sets = combinations(lengths, 1024)
    assert all(s.sum() == 1024 for s in sets)
    x = repeats(sets, histogram)
    met = np.zeros(1025)
    for k in range(3):
        np.add.at(met, sets[:, k], x)
    met[0] = 0
    assert x.min() >= 0 and np.abs(met - histogram).sum() < 0.03 * histogram.sum()
    made = plan(counts)
    assert sum(made.left.values()) < 0.06 * sum(counts.values())  # all that can be cut
