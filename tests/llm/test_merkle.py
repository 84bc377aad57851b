import random
import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import pytest

from threadloom.llm import merkle

H = lambda *xs: sha256("".join(xs).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([H(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def proof(tree, at):
    """(node before, node after) by level."""
    out = []
    for nodes in tree[:-1]:
        pair = nodes[at // 2 * 2 : at // 2 * 2 + 2]
        out.append((pair[0], "") if at % 2 else ("", "".join(pair[1:])))
        at //= 2
    return out


def brute(rows):
    say = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, add=0: H(*map(say, (r[0], r[1], r[2], None if r[3] is None else r[3] + add, r[4])))
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for rs in by.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {x: levels([leaf(r) for r in by[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            path = proof(trees[x], i) + proof(top, k)
            now = leaf(r, 1 if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0)
            for a, b in path:
                now = H(a, now, b)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], H(*(y for p in path for y in p)), now, now == top[-1][0]))
    return sorted(out, key=str)


def frame(spark, rows, parts=5):
    extra = [(*r, 7, 8) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, source string, lang string, n_chars long, text string, tree int, pos int").repartition(parts)


def run(spark, rows, height):
    return sorted((tuple(r) for r in merkle.Manifest.of(frame(spark, rows), height).audit(height).collect()), key=str)


@pytest.mark.parametrize("height", [2, 3, 10])
def test_equals_brute_force(spark, height):
    rng = random.Random(1)
    sizes = {"a": 133, "b": 1, "c": 2, "d": 64, "e": 65, "é": 5, "Z": 3, None: 8, "": 1, "zz": 9}
    ids = list(range(2000))
    rng.shuffle(ids)
    rows = [(ids.pop(), rng.choice(["s", None, "t☃"]), x, rng.choice([None, 5, 99, 10**12]), rng.choice(["", None, "text", "é ☃" * 50])) for x, n in sizes.items() for _ in range(n)]
    rows += [(3, "s", "a", 9, "same")] * 3 + [(3, "s", "a", 9, "other"), (None, "s", "a", None, None), (None, None, None, None, None), (7, "s", "b", 99, "long " * 200_000)]
    got = run(spark, rows, height)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_one_row_and_none(spark):
    assert run(spark, [], 3) == []
    one = [(5, "s", "en", 1, "x")]
    assert run(spark, one, 3) == brute(one)
    assert run(spark, one, 3)[0][1] == run(spark, one, 3)[0][3]


def test_many_trees(spark):
    rows = [(i, "s", f"l{i % 90}" if i % 3 else None, i, str(i)) for i in range(400)]
    assert run(spark, rows, 2) == brute(rows)


def test_store_has_every_level(spark):
    m = merkle.Manifest.of(frame(spark, [(i, "s", "en", 1, "x") for i in range(37)]), 2)
    assert {r.level: r["count"] for r in m.store.groupBy("level").count().collect()} == {0: 37, 1: 19, 2: 10, 3: 5, 4: 3, 5: 2, 6: 1}
    paths = m.proofs(2).collect()
    assert all(merkle.fold(r.leaf, [(p.before, p.after) for p in r.path]) == r.root for r in paths)
    assert {len(r.path) for r in paths} == {6}


def test_sql_agrees(spark, tmp_path):
    rows = [(i, f"s{i % 3}" if i % 5 else None, ("en", "de", None)[i % 3], i if i % 4 else None, f"t{i}é" if i % 6 else None) for i in range(60)]
    frame(spark, rows).write.parquet(str(tmp_path / "d"))
    sql = merkle.OP11_SQL.replace("FROM documents", f"FROM '{tmp_path}/d/*.parquet'")
    cursor = duckdb.sql(sql)
    assert cursor.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(cursor.fetchall(), key=str) == run(spark, rows, 10)
