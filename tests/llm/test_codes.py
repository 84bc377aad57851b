import hashlib
import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from threadloom.llm import codes


def brute(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error, digest) in plain Python integers."""
    kept = [(i, label, [math.floor(Fraction(x) * 256) for x in v], v) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    w = len(first[0][2]) // parts
    books = [[r[2][p * w : p * w + w] for r in first] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign(q):
        out = []
        for p in range(parts):
            d = [away(q[p * w : p * w + w], e) for e in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        met = defaultdict(list)
        for r in kept:
            for p, (c, _) in enumerate(assign(r[2])):
                met[p, c].append(r[2][p * w : p * w + w])
        for (p, c), xs in met.items():
            books[p][c] = [sum(x) // len(xs) for x in zip(*xs, strict=True)]
    final = [(r[0], r[1], assign(r[2])) for r in kept]
    of = defaultdict(int)
    for _, label, a in final:
        of[label] += sum(e for _, e in a)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fits = lambda x: x if x < 2**63 else None
    return sorted(((i, "".join(f"{c:02x}" for c, _ in a), fits(sum(e for _, e in a)), fits(of[label]), digest) for i, label, a in final), key=str)


def run(spark, rows, kind="float", parts=16, entries=64):
    table = spark.createDataFrame([(v, i, label, 1, 2) for i, label, v in rows], f"embedding array<{kind}>, vec_id long, label int, code int, `of` int").repartition(5)
    return sorted((tuple(r) for r in codes.compress(table, parts, entries).collect()), key=str)


@pytest.mark.parametrize(("n", "dim"), [(700, 32), (40, 16), (1, 48)])
def test_equals_brute_force(spark, n, dim):
    rng = np.random.default_rng(n)
    draw = lambda: rng.normal(0, 0.6, dim).astype(np.float32).tolist()
    rows = [(i * 3 % 1009, None if i % 7 == 0 else int(i % 5), draw()) for i in range(n)]
    rows += [(5000, 1, None), (5001, 1, [None] + [0.0] * (dim - 1)), (-4, 2, [math.nan] + [0.0] * (dim - 1)), (-3, 2, [math.inf] * dim), (-2, None, [-math.inf] * dim)]
    rows += [(7, 3, rows[0][2])] * 3 + [(None, 1, draw()), (None, None, [0.5] * dim)] + [(8, 9, [0.25] * dim)] * 40
    assert run(spark, rows) == brute(rows)


def test_floors_go_down_and_ties_go_to_the_lower_index(spark):
    rows = [(i, 0, [x] * 4) for i, x in enumerate([-0.001, 0.001, 0.0, 1.0, -1.0, 0.5])]
    assert run(spark, rows, parts=4, entries=3) == brute(rows, 4, 3)
    assert codes.whole(np.array([-0.001, 0.0039, 0.00390625])).tolist() == [-1, 0, 1]


@pytest.mark.parametrize("large", [3e4, 1e9, 2.0**55, 1e300])
def test_large_components_are_exact(spark, large):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, (rng.normal(0, large, 4) * 1.0).tolist()) for i in range(30)]
    assert run(spark, rows, "double", 2, 5) == brute(rows, 2, 5)


def test_no_rows_and_wrong_lengths(spark):
    assert run(spark, []) == [] and run(spark, [(1, 1, None)]) == []
    with pytest.raises(ValueError, match="equal parts"):
        run(spark, [(1, 1, [0.5] * 10)])
    with pytest.raises(Exception, match="among those of 16"):
        run(spark, [(1, 1, [0.5] * 16), (2, 1, [0.5] * 32)])


def test_decoded_vectors_are_the_entries(spark):
    rng = np.random.default_rng(8)
    rows = [(i, 0, rng.normal(0, 1, 16).tolist()) for i in range(300)]
    table = codes._vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    book, kinds = codes.train(table)
    got = codes.encode(table, book, kinds).toPandas().sort_values("vec_id")
    back = codes.decode(got["code"], book)
    q = np.floor(np.array([r[2] for r in rows]) * 256)
    assert ((back * 256 - q) ** 2).sum(1).astype(int).tolist() == got["error"].tolist()
    assert codes.decode(pd.Series([], dtype=str), book).shape == (0, 16)
