import random

import numpy as np

from threadloom.llm.langid import BLOCK, CrossParser, held_out_rows, identify, passages, suffix_automaton, training_rows


def test_automaton_accepts_the_substrings_only():
    rng = random.Random(1)
    for _ in range(40):
        text = [rng.randint(0, 2) for _ in range(rng.randint(1, 25))]
        table = suffix_automaton(text, 3)
        inside = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
        for _ in range(200):
            probe = tuple(rng.randint(0, 2) for _ in range(rng.randint(0, 7)))
            s = 0
            for c in probe:
                s = table[s, c] if s >= 0 else -1
            assert (s >= 0) == (probe in inside)


def brute_phrases(sample, text):
    """Greedy longest matches over the whole text."""
    ends, current = 0, ""
    for c in text:
        if current + c in sample:
            current += c
        else:
            ends += 1
            current = c if c in sample else ""
    return ends + 1


def test_phrases_like_brute_force():
    rng = random.Random(2)
    samples = {x: ["".join(rng.choice(a) for _ in range(400))] for x, a in (("aa", "abcde "), ("bb", "cdefg "))}
    parser = CrossParser(samples)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (0, 1, 5, 255, 256, 257, 900, 4000)]
    texts += ["a" * 3000, "ab" * 1500, samples["aa"][0] * 9, "abc" * 700 + samples["bb"][0], "h" * 600]  # phrases longer than a block, and parses that never meet
    arrays = [parser.symbols(t) for t in texts]
    shown = lambda a: "".join(chr(65 + x) for x in a)
    for got, a in zip(parser.phrases(arrays), arrays, strict=True):
        for k, x in enumerate(parser.languages):
            assert got[k] == brute_phrases(shown(parser.symbols(samples[x][0])), shown(a))
    assert BLOCK < 400


def test_long_copies_of_training_text_take_linear_time():
    import time

    rng = random.Random(8)
    samples = {x: ["".join(rng.choice(a) for _ in range(20_000))] for x, a in (("aa", "abcde "), ("bb", "cdefg "), ("cc", "acegi "))}
    parser = CrossParser(samples)
    long = parser.symbols(samples["aa"][0] * 100)
    began = time.time()
    (got,) = parser.phrases([long])
    assert time.time() - began < 10
    assert got[0] <= 101 and got[1] == brute_phrases("".join(map(chr, parser.symbols(samples["bb"][0]))), "".join(map(chr, long)))


def test_passages_are_spread_over_a_text():
    text = np.arange(1, 201).astype(np.uint8)
    got = passages(text, 64, 4)
    assert len(got) <= 64 and got[0] == 1 and got[-2] == 200 and (passages(text, 200) == text).all()


def test_many_letters():
    """Two languages that share no letter, each with far more than a byte of classes can name."""
    rng = random.Random(3)
    han, kana = [chr(c) for c in range(0x4E00, 0x4E00 + 1500)], [chr(c) for c in range(0x3041, 0x3097)]
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    parser = CrossParser({"ja": [make(han[700:] + kana * 30, 3000)], "zh": [make(han[:700], 3000)]})
    found = parser.predict([make(han[:700], 200), make(han[800:] + kana * 30, 200), make(kana, 50), "..", None])
    assert [x for x, _ in found] == ["zh", "ja", "ja", "und", "und"]
    assert parser.classes < 256


def test_training_texts_are_whole(spark):
    """Texts longer than CLIP are taken only where shorter ones don't fill the sample, and then whole."""
    rows = [(i, "ab " * (5 if i % 2 else 4000), "xx") for i in range(40)] + [(i, "zz " * 3000, "yy") for i in range(100, 104)]
    got = training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), held_out_rows(), docs_each=12)
    assert [len(t) for t in got["xx"]] == [15] * 12 and set(got["yy"]) == {"zz " * 3000}


def words(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_edge_rows(spark):
    rng = random.Random(4)
    kinds = {"xx": ["ka", "to", "mi", "re"], "yy": ["sch", "ein", "ung", "ä"], "zz": ["ion", "que", "é", "le"]}
    rows = [(i, words(rng, kinds[x], rng.randint(5, 60)), x, "s", i) for i in range(300) for x in [rng.choice(list(kinds))]]
    truth = {r[0]: r[2] for r in rows}
    odd = [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 34 !!", "yy"), (1003, "ka to " * 40_000, None), (None, "sch ein", "yy"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([r[:3] for r in rows] + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as lang_pred", "'x' as score")
    got = identify(docs).collect()
    assert len(got) == 306
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and by[1000].score == 0
    assert by[1003].lang_pred == "xx" and not by[None].held_out and by[None].lang_pred == "yy"
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    row = identify(docs).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)
    assert identify(docs.limit(0)).count() == 0
