import hashlib
import random
import re
from collections import Counter

import pytest

from threadloom.llm import dedup_substring
from threadloom.llm.dedup_substring import remove_repeats


def brute(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=120, vocabulary=40):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyzé") + str(rng.randint(0, vocabulary))
    passages = [[word() for _ in range(rng.randint(20, 90))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        if rng.random() < 0.1:
            words = [rng.choice("xyz")] * rng.randint(30, 120)
        if rng.random() < 0.1:
            words = [word() for _ in range(3)] * rng.randint(10, 40)
        rows.append((i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (None, rows[3][1]), (5, rows[5][1]), (n + 3, rows[7][1] + " "), (n + 4, "w " * 34), (n + 5, "é" * 3000), (n + 6, "v\x85w " * 40)]
    return rows


@pytest.mark.parametrize(("seed", "window", "gram", "huge"), [(1, 35, 8, 100_000), (2, 35, 8, 2), (3, 12, 5, 3), (4, 10, 10, 100_000)])
def test_like_brute_force(spark, seed, window, gram, huge, monkeypatch):
    monkeypatch.setattr(dedup_substring, "HELD", 4096)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id long, text string, id int, g string").repartition(5)
    got = sorted((tuple(r) for r in remove_repeats(docs, window, gram, huge).collect()), key=str)
    assert got == brute(rows, window)


def test_hot_passage(spark):
    rng = random.Random(9)
    hot = " ".join(f"h{i}" for i in range(70))
    rows = [(i, f"{rng.random()} " * 5 + hot + f" {rng.random()}" * 40) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in remove_repeats(docs).collect()), key=str) == brute(rows, 35)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(docs).collect() == []
