import math

import duckdb
import numpy as np
import pytest

import __spark_entry__  # noqa: F401

from threadloom.operators import clusters, trajectory

SCHEMA = "run string, user_id long, round int, seq long, action string, x array<double>"


def population(seed=1, users=24, rounds=12, dim=4):
    """Three kinds of users that move together in later rounds; some actions without a vector."""
    rng = np.random.default_rng(seed)
    rows, seq = [], 0
    for r in range(1, rounds + 1):
        for u in range(users):
            for _ in range(int(rng.integers(0, 3))):
                seq += 1
                x = 4 * np.eye(dim)[u % 3] * (1 - r / 15) + rng.normal(0, 0.3, dim)
                rows.append(("a", u, r, seq, "abcde"[int(rng.integers(0, 5 - r // 4))], None if rng.random() < 0.2 else x.tolist()))
    return rows


def states_at(rows, point, window=5):
    mine = {}
    for run, u, r, seq, _, x in sorted(rows, key=lambda t: (t[2], t[3])):
        if r <= point and x is not None:
            mine.setdefault(u, []).append(x)
    return {u: np.mean(xs[-window:], axis=0) for u, xs in mine.items()}


def test_rolling_states_across_blocks(spark):
    rows = [("a", 1 if i % 10 else 2, i // 7, i, "x", [float(i), 1.0]) for i in range(300)] + [("b", 1, 0, 1, "x", [7.0, 7.0]), ("b", 1, 0, 2, "x", None)]
    got = trajectory.rolling_states(spark.createDataFrame(rows, SCHEMA).repartition(5), block=8).collect()
    assert len(got) == 301
    for r in got:
        before = [t[5] for t in rows if t[0] == r.run and t[1] == r.user_id and t[5] is not None and (t[2], t[3]) <= (r.round, r.seq)]
        assert np.allclose(r.state, np.mean(before[-5:], axis=0)), r


def test_snapshots_and_entropy(spark):
    rows = population()
    rows = [r for r in rows if not (r[1] == 5 and r[2] > 3)]  # one who falls silent keeps their state
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in trajectory.snapshots(frame).collect():
        got.setdefault(r.point, {})[r.user_id] = r.x
    assert set(got) == {1, 5, 10}
    for p, states in got.items():
        want = states_at(rows, p)
        assert set(states) == set(want) and all(np.allclose(states[u], want[u]) for u in want)
    for r in trajectory.entropies(frame).collect():
        counts = np.unique([t[4] for t in rows if t[2] <= r.point], return_counts=True)[1] / sum(t[2] <= r.point for t in rows)
        assert r.entropy == pytest.approx(-(counts * np.log2(counts)).sum())


@pytest.mark.parametrize("block", [2048, 7])
def test_measures(spark, block, monkeypatch):
    monkeypatch.setattr(trajectory, "BLOCK", block)
    rows = population()
    got = {r.point: r for r in trajectory.trajectory(spark.createDataFrame(rows, SCHEMA).repartition(3), k=3).collect()}
    assert set(got) == {1, 5, 10}
    for p, r in got.items():
        x = np.stack([s for _, s in sorted(states_at(rows, p).items())])
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        c = (u @ u.T)[np.triu_indices(len(x), 1)]
        assert r.n_agents == len(x) and r.mean_cosine == pytest.approx(c.mean()) and r.cosine_halfwidth == pytest.approx(1.96 * c.std(ddof=1) / math.sqrt(len(c)))
        if p <= 5:  # clusters apart: the kinds of users themselves
            label = np.array([k % 3 for k in sorted(states_at(rows, p))])
            m = np.stack([x[label == k].mean(0) for k in range(3)])
            s = np.array([np.linalg.norm(x[label == k] - m[k], axis=1).mean() for k in range(3)])
            db = np.mean([max((s[i] + s[j]) / np.linalg.norm(m[i] - m[j]) for j in range(3) if j != i) for i in range(3)])
            assert r.davies_bouldin == pytest.approx(db) and r.silhouette == pytest.approx(clusters.mean_silhouette(x, label))
    assert got[1].silhouette > got[10].silhouette


def test_small_and_empty(spark):
    one = trajectory.trajectory(spark.createDataFrame([("a", 1, 1, 1, "x", [1.0, 2.0]), ("b", 1, 5, 1, "x", None), ("c", 1, 2, 1, "x", [1.0, 0.0])], SCHEMA)).collect()
    assert sorted((r.run, r.point, r.n_agents, r.silhouette, r.mean_cosine, r.entropy) for r in one) == [("a", 1, 1, 0, 0, 0), ("b", 5, 0, 0, 0, 0)]
    same = trajectory.trajectory(spark.createDataFrame([("a", u, 1, u, "x", [1.0, 2.0]) for u in range(4)], SCHEMA)).first()
    assert (same.n_agents, same.silhouette, same.davies_bouldin) == (4, 0, 0) and same.mean_cosine == pytest.approx(1)
    assert trajectory.trajectory(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hypotheses(spark):
    series = {"p1": [0.5, 0.4, 0.3], "f1": [0.5, 0.5, 0.49], "w1": [0.5, 0.45, 0.36]}
    rows = [(run, 5 * i, s, 2 * s, 1 - s) for run, v in series.items() for i, s in enumerate(v)]
    made = trajectory.drifts(spark.createDataFrame(rows, "run string, point int, silhouette double, entropy double, mean_cosine double"))
    got = {r.run: r for r in made.collect()}
    for run, v in series.items():
        assert got[run].silhouette_slope == pytest.approx(np.polyfit(range(3), v, 1)[0]) and got[run].cosine_rise == pytest.approx(v[0] - v[-1]) and got[run].entropy_drop == pytest.approx(2 * (v[0] - v[-1]))
    by = made.selectExpr("*", "element_at(map('p', 'plain', 'f', 'full', 'w', 'without'), substr(run, 1, 1)) as method")
    verdicts = {r.hypothesis: r.supported for r in trajectory.hypotheses(by, "plain", "full", "without").collect()}
    assert verdicts == {"H1": True, "H2": True, "H3": True, "H4": True, "H5": True, "H6": True}
    lacking = {r.hypothesis: r.supported for r in trajectory.hypotheses(by.where("method <> 'full'"), "plain", "full", "without").collect()}
    assert lacking == {"H1": True, "H2": None, "H3": True, "H4": None, "H5": True, "H6": None}


@pytest.mark.parametrize("name", ["w03_rolling_states", "r12_checkpoints"])
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    rows = lambda d: sorted(map(tuple, d[sorted(d)].astype({c: float for c in d if d[c].dtype.kind == "f"}).values.tolist()), key=str)
    assert len(got) == len(want) > 0 and rows(got) == rows(want)


def test_queries(spark):
    q = __spark_entry__.queries()
    assert {r.hypothesis for r in q["s20_collapse_hypotheses"](spark, "/root/testdata/sf0.001").collect()} == {f"H{i}" for i in range(1, 7)}
    assert q["z14_collapse_frame"](spark, "/root/testdata/sf0.001").count() == 5


def test_blocks_reach_python_by_bytes(spark):
    """A row holds a block of states: thousands of them in one batch grow with the table."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(1 << 30))
    states = spark.createDataFrame([("a", 1, i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)], "run string, point int, user_id long, x array<double>")
    assert trajectory.snapshot_measures(states).first().n_agents == 40
    assert int(spark.conf.get(key)) <= 4 << 20
    spark.conf.set(key, before)
