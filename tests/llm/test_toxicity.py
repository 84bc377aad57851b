import itertools
import random

import numpy as np
import pytest

from threadloom.llm.toxicity import Field, Scorer, WORD, learn, score


def made(rng, toxic):
    words = ["".join(rng.choice(["ka", "to", "mi", "re", "no"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 200))]
    if toxic:
        for _ in range(rng.randint(2, 8)):
            words.insert(rng.randrange(len(words)), rng.choice(["grobax", "zwurg", "plifka"]) + rng.choice(["", "to", "mi"]))
    return " ".join(words)


def corpus(seed, n=300):
    rng = random.Random(seed)
    kinds = [i % 4 == 0 for i in range(n)]
    return [made(rng, x) for x in kinds], [int(x) for x in kinds]


def test_marginals_like_enumeration():
    rng = np.random.default_rng(1)
    field = Field(["ab", "cd$"])
    field.weights, field.moves, field.start = rng.normal(size=3), rng.normal(size=(2, 2)), 0.3
    field.ready()
    for text in ("x", "ab", "ab cd", "x y abc z cd", "cd x x x x ab ab", "x x abz"):
        words = WORD.findall(text)
        emit = [sum(field.weights[i] for i in field.marks(w)) + field.weights[-1] for w in words]
        total, each = 0.0, np.zeros(len(words))
        for path in itertools.product((0, 1), repeat=len(words)):
            s = field.start * path[0] + sum(e * y for e, y in zip(emit, path, strict=True)) + sum(field.moves[a, b] for a, b in itertools.pairwise(path))
            total += np.exp(s)
            each += np.exp(s) * np.array(path)
        n, at, p = field.marginals(text)
        assert n == len(words) and np.allclose(p, (each / total)[at])
        assert at.tolist() == [i for i, w in enumerate(words) if field.marks(w)]


def test_long_gaps_like_forward_backward():
    rng = np.random.default_rng(2)
    field = Field(["ab", "cd$"])
    field.weights, field.moves, field.start = rng.normal(size=3), rng.normal(size=(2, 2)), -0.4
    field.moves[0, 0], field.moves[1, 1] = 7.0, 7.5  # states that last: a gap of hundreds of words matters
    field.ready()
    words = ["x"] * 150 + ["ab"] + ["x"] * 3000 + ["cd", "ab"] + ["y"] * 65 + ["abc"] + ["x"] * 700
    emit = np.array([[1.0, np.exp(sum(field.weights[i] for i in field.marks(w)) + field.weights[-1])] for w in words])
    step = np.exp(field.moves)
    forward, backward = np.empty((len(words), 2)), np.ones((len(words), 2))
    forward[0] = emit[0] * [1, np.exp(field.start)]
    for i in range(1, len(words)):
        forward[i] = (forward[i - 1] / forward[i - 1].sum()) @ step * emit[i]
    for i in range(len(words) - 2, -1, -1):
        backward[i] = step @ (emit[i + 1] * backward[i + 1])
        backward[i] /= backward[i].sum()
    p = forward * backward
    _, at, got = field.marginals(" ".join(words))
    assert np.allclose(got, (p[:, 1] / p.sum(1))[at])


def test_offsets_where_lower_case_is_longer():
    texts, kinds = corpus(2)
    scorer = Scorer(list(zip(texts, kinds, strict=True)), (kinds.count(0), kinds.count(1)))
    for text in ("İx grobax mi grobax", "İİİ zwurg İ", "Grobax"):
        assert [text[a:b].lower() for a, b, _ in scorer.spans(text)] == [w.lower() for w in text.split() if w.lower() in ("grobax", "zwurg")]


def test_held_out_accuracy_and_spans():
    texts, kinds = corpus(2)
    scorer = Scorer(list(zip(texts, kinds, strict=True)), (kinds.count(0), kinds.count(1)))
    others, truth = corpus(3)
    assert np.mean([(scorer.score(t) >= 0.5) == x for t, x in zip(others, truth, strict=True)]) > 0.98
    text = "Ka to GROBAX mi, zwurg plifka re"
    assert {text[a:b].lower() for a, b, _ in scorer.spans(text)} == {"grobax", "zwurg", "plifka"}
    assert scorer.score("") == scorer.score(None) < 0.5
    assert 0 <= scorer.score("İ grobax " * 30_000) <= 1


def test_tables(spark):
    texts, kinds = corpus(4, 200)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (None, texts[0], "x"), rows[3]], "doc_id long, text string, score string")
    labels = spark.createDataFrame([*((i, 1, k) for i, k in enumerate(kinds)), (901, None, None), (None, 0, 1), (4444, 1, 1), (3, 1, kinds[3])], "doc_id long, quality int, toxic int")
    got = score(docs, labels).collect()
    assert len(got) == 204 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert held and np.mean([r.predicted == kinds[r.doc_id] for r in held]) > 0.95
    assert {r.predicted for r in got if r.doc_id in (900, 901)} == {0}
    assert score(docs.limit(0), labels).count() == 0
    marked = {r.doc_id: r.spans for r in got}
    assert all(rows[i][1][x.start : x.end].startswith(("grobax", "zwurg", "plifka")) for i in range(200) for x in marked[i])
    assert np.mean([bool(marked[i]) == bool(kinds[i]) for i in range(200)]) > 0.97


@pytest.mark.parametrize("only", [0, 1, None])
def test_a_label_missing(spark, only):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([] if only is None else [(1, only)], "doc_id long, toxic int")
    assert learn(docs, labels).score("x") == (0.5 if only is None else float(only))
