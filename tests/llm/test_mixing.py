import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, strategies as st

from threadloom.llm.mixing import Targets, WEIGHTS, budgets, choose, mix, split


@given(st.integers(0, 500), st.lists(st.tuples(st.integers(0, 120), st.sampled_from([0.0, 0.5, 1.0, 2.0, 7.5])), min_size=1, max_size=7))
def test_split(amount, children):
    rooms, weights = [c[0] for c in children], [c[1] for c in children]
    given_ = split(amount, rooms, weights)
    assert sum(given_) == min(amount, sum(rooms)) and all(0 <= g <= r for g, r in zip(given_, rooms, strict=True))
    unmet = [i for i, (g, r) in enumerate(zip(given_, rooms, strict=True)) if g < r and weights[i] > 0]
    for i in unmet:  # who has room left got as much by weight as anyone, but for rounding
        for j in range(len(rooms)):
            if weights[j] > 0:
                assert given_[j] <= given_[i] * weights[j] / weights[i] + weights[j] / weights[i] + 1
    assert not unmet or all(not g for g, w in zip(given_, weights, strict=True) if w == 0)


def test_siblings_before_ancestors():
    leaves = {("a", "en", "x"): 10, ("a", "en", "y"): 100, ("a", "de", "z"): 100, ("b", "en", "w"): 1000}
    got = budgets(leaves, Targets({("a",): 1, ("b",): 1}, budget=200))
    assert got == {("a", "en", "x"): 10, ("a", "en", "y"): 40, ("a", "de", "z"): 50, ("b", "en", "w"): 100}
    got = budgets(leaves, Targets({("a",): 3, ("b",): 1}, budget=400))
    assert got == {("a", "en", "x"): 10, ("a", "en", "y"): 100, ("a", "de", "z"): 100, ("b", "en", "w"): 190}


def brute(rows, targets):
    leaves, held = defaultdict(int), defaultdict(list)
    for doc, text, lang, source in rows:
        digits = re.search(r"(\d+)$", source or "")
        leaf = (f"domain{int(digits[1]) % 4 if digits else 0}", lang or "", source or "")
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        leaves[leaf] += n
        held[leaf].append((doc, n, hashlib.md5((text or "").encode()).hexdigest()))
    out = Counter()
    for leaf, budget in budgets(dict(leaves), targets).items():
        total, epoch = 0, 0
        while total < budget:
            order = sorted(held[leaf], key=lambda r: int(hashlib.md5(f"{targets.seed}|{epoch}|{'' if r[0] is None else r[0]}|{r[2]}".encode()).hexdigest()[:15], 16))  # noqa: B023
            whole = total + leaves[leaf] <= budget
            for doc, n, _ in order:
                if not whole and total >= budget:
                    break
                out[leaf, epoch, doc, n] += 1
                total += n
            epoch += 1
    return out


def corpus(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = f"src{rng.choice([0] * 8 + list(range(20)))}"
        rows.append((i, " ".join(["w"] * rng.randint(0, 60)) + f" {i}", rng.choice(["en", "en", "de", "fr", "es"]), source))
    return rows + [(n, None, "en", "src1"), (n + 1, "", None, "src1"), (n + 2, "x y z", None, None), (n + 3, "a b", "en", "other"), (None, "q q", "de", "src2"), (n + 4, "w " * 9000, "fr", "src3")]


@pytest.mark.parametrize("targets", [Targets(WEIGHTS), Targets(WEIGHTS, share=1.7, epochs=3, seed=4), Targets({}, share=0.3), Targets(WEIGHTS, share=9.0, epochs=2), Targets(WEIGHTS, budget=0)])
def test_like_brute_force(spark, targets):
    rows = corpus(1)
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, epoch int").repartition(5)
    got = Counter(((r.domain, r.language, r.source), r.epoch, r.doc_id, r.n_tokens) for r in choose(docs, targets).collect())
    # a budget of whole epochs ends with tokens: texts without any may or may not follow
    assert Counter({k: v for k, v in got.items() if k[3]}) == Counter({k: v for k, v in brute(rows, targets).items() if k[3]})
    mixed = Counter(r.doc_id for r in mix(docs, targets).collect())
    want = Counter()
    for (_, _, doc, _), times in got.items():
        want[doc] += times
    assert mixed == want


def test_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "src1")] * 4, "doc_id long, text string, lang string, source string")
    assert len(mix(docs, Targets({}, share=0.5)).collect()) == 2
    assert mix(docs, Targets({}, share=0.5)).columns == docs.columns
    assert choose(docs.limit(0), Targets(WEIGHTS)).count() == 0
