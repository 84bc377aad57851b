import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from threadloom.llm.sharding import place, shard


@pytest.mark.parametrize(("shards", "units"), [(24, 8192), (4, 16)])
def test_law_slots_and_groups(spark, shards, units):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(1500)] + [(2000 + i, "the same text " * 20) for i in range(900)] + [(None, None), (5000, None), (5001, ""), (3, "dup"), (3, "dup"), (5002, "é ☃ " * 4000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").repartition(5)
    got = shard(docs, shards, units).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    by = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r)
    sizes = [sum(r.size for r in by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= max(r.size for r in got)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    small = defaultdict(set)
    for r in got:
        if (r.size, r.text_crc32) != (288, zlib.crc32(b"the same text " * 20)):
            small[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in small.values())
    assert {(r.doc_id, r.shard, r.slot) for r in got if r.doc_id != 3} == {(r.doc_id, r.shard, r.slot) for r in shard(docs.repartition(3), shards, units).collect() if r.doc_id != 3}


def test_place_balances_all_three():
    rng = np.random.default_rng(1)
    v = np.stack([rng.lognormal(3, 1, 4000), rng.lognormal(2, 1, 4000), np.ones(4000)], 1)
    to = place(v, 24)
    sums = np.stack([np.bincount(to, v[:, k], 24) for k in range(3)], 1)
    assert (sums.max(0) / sums.mean(0) < [1.01, 1.1, 1.1]).all()


def test_no_rows(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("ids", [True, False])
def test_a_group_of_nine_tenths(spark, ids):
    """Equal texts far beyond a shard, with ids or without any, spread so that the law holds."""
    rng = random.Random(5)
    rows = [(i if ids else None, "the same text " * 20) for i in range(9000)] + [(10_000 + i, "y" * rng.randint(0, 550)) for i in range(1000)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 24).collect()
    sizes = np.bincount([r.shard for r in got], [r.size for r in got], 24)
    assert sizes.max() / sizes.mean() < 1.02 and sizes.min() / sizes.mean() > 0.98
    assert len({(r.shard, r.slot) for r in got}) == len(rows)
