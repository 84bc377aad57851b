import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from threadloom.llm.dedup_exact import duplicates, keep_first
from threadloom.llm.sketch import MisraGries


def brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for key, members in groups.items():
        members.sort(key=lambda m: m[:3])
        digest = hashlib.sha256(key.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), i == 0, digest) for i, m in enumerate(members)]
    return sorted(out, key=str)


def corpus(n=300):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) + rng.choice(["", " ", "\n\x0b"])) for i in range(n)]
    rows += [(n + i, "hot  text" if i % 2 else "hottext") for i in range(150)]
    return rows + [(900, None), (901, ""), (902, " \t\n\x0b\x0c\r"), (None, "a b"), (None, None), (7, rows[7][1]), (7, rows[7][1]), (903, "é x"), (904, "z" * 200_000)]


@pytest.mark.parametrize("heavy", [1023, 3, 40])
def test_like_brute_force(spark, heavy):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 5, "u") for r in rows], "doc_id long, text string, n int, uid string").repartition(6)
    assert sorted((tuple(r) for r in duplicates(docs, heavy).collect()), key=str) == brute(rows)
    kept = keep_first(docs, heavy)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in brute(rows) if r[3]), key=str)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert duplicates(docs).collect() == [] and keep_first(docs).collect() == []


def test_sketch_bound():
    rng = np.random.default_rng(0)
    values = np.concatenate([np.full(4000, 7), np.full(900, 8), rng.integers(100, 10**9, 20_000)])
    rng.shuffle(values)
    for k in (5, 50, 500):
        seen = MisraGries(k)
        for part in np.array_split(values, 13):
            seen.add(part)
        seen.settle()
        count = dict(zip(seen.keys.tolist(), seen.counts.tolist(), strict=True))
        assert len(count) <= k and seen.n == len(values)
        for key, true in ((7, 4000), (8, 900)):
            assert true - len(values) / (k + 1) <= count.get(key, 0) <= true
