import itertools
import math

import numpy as np
import pytest

from threadloom.operators import clusters, communities


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id long, leaf int, x array<double>").repartition(4)


def blobs(seed=0, each=60, dim=5, leaves=4, far=6.0):
    rng = np.random.default_rng(seed)
    return [(k * each + i, k, (rng.normal(0, 1, dim) + far * np.eye(dim)[k % dim] * (1 + k // dim)).tolist()) for k in range(leaves) for i in range(each)]


def q_of(edges, label):
    """Modularity by the sum over pairs."""
    m = sum(w for _, _, w in edges)
    k = {}
    for u, v, w in edges:
        k[u] = k.get(u, 0) + w
        k[v] = k.get(v, 0) + w
    inside = sum(w for u, v, w in edges if label[u] == label[v])
    return inside / m - sum(k[a] * k[b] for a in k for b in k if label[a] == label[b]) / (4 * m * m)


def propagate(edges, rounds=6):
    """Label propagation, all nodes at once but a third: the method before."""
    near, label = {}, {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    label = {u: u for u in near}
    for i in range(rounds):
        new = {}
        for u, vs in near.items():
            votes = {}
            for v, w in vs:
                votes[label[v]] = votes.get(label[v], 0) + w
            new[u] = min(votes, key=lambda c: (-votes[c], c)) if hash((u, i)) % 3 else label[u]
        label = new
    return label


def ring_of_cliques(n=8, size=5):
    edges = [(c * size + i, c * size + j, 1) for c in range(n) for i in range(size) for j in range(i)]
    return edges + [(c * size, (c + 1) % n * size + 1, 1) for c in range(n)]


def planted(seed=3, n=120, groups=6):
    rng = np.random.default_rng(seed)
    return [(i, j, int(rng.integers(1, 4))) for i in range(n) for j in range(i) if rng.random() < (0.4 if i % groups == j % groups else 0.02)]


@pytest.mark.parametrize("edges", [ring_of_cliques(), planted()], ids=["ring", "planted"])
def test_louvain(spark, edges):
    frame_ = spark.createDataFrame(edges, "u long, v long, w long").repartition(4)
    got = {r.node: r.community for r in communities.louvain(frame_).collect()}
    assert set(got) == {x for e in edges for x in e[:2]}
    assert all(c == min(n for n, d in got.items() if d == c) for c in got.values())
    assert q_of(edges, got) >= q_of(edges, propagate(edges)) - 1e-9
    truth = {n: n // 5 for n in got} if len(got) == 40 else {n: n % 6 for n in got}
    assert q_of(edges, got) >= q_of(edges, truth) - 0.02
    labels = spark.createDataFrame(list(got.items()), "node long, label long")
    assert communities.modularity(frame_, labels) == pytest.approx(q_of(edges, got))


def test_louvain_of_little(spark):
    none = spark.createDataFrame([], "u long, v long, w long")
    assert communities.louvain(none).collect() == []
    one = spark.createDataFrame([(1, 2, 3), (7, 7, 1)], "u long, v long, w long")
    assert {(r.node, r.community) for r in communities.louvain(one).collect()} == {(1, 1), (2, 1), (7, 7)}


@pytest.mark.parametrize("ends", [None, 22], ids=["one block", "blocks and large nodes"])
def test_louvain_needs_few_rounds(spark, monkeypatch, ends):
    """Random edges, on which communities that move at once get in each other's way; a node with many ends is on its own."""
    rng, measured, n, p = np.random.default_rng(4), [], *((24, 0.12) if ends else (100, 0.15))
    edges = [(i, j, 1) for i in range(n) for j in range(i) if rng.random() < p or j == 0]
    if ends:
        monkeypatch.setattr(communities, "ENDS", ends)
    modularity = communities.modularity
    monkeypatch.setattr(communities, "modularity", lambda *a: measured.append(modularity(*a)) or measured[-1])
    got = {r.node: r.community for r in communities.louvain(spark.createDataFrame(edges, "u long, v long, w long").repartition(4)).collect()}
    q = q_of(edges, got)
    assert q == pytest.approx(max(measured)) and q >= 0.15
    assert len(measured) <= 40, len(measured)


def test_louvain_of_several_blocks_needs_few_rounds(spark, monkeypatch):
    """Blocks of the nodes that gain, filled with those that nearly do: few rounds, and about the modularity of one block with all."""
    rng, measured, n = np.random.default_rng(5), [], 300
    edges = [(i, j, 1) for i in range(n) for j in range(i) if rng.random() < 0.1]
    monkeypatch.setattr(communities, "ENDS", 2500)
    modularity = communities.modularity
    monkeypatch.setattr(communities, "modularity", lambda *a: measured.append(modularity(*a)) or measured[-1])
    got = {r.node: r.community for r in communities.louvain(spark.createDataFrame(edges, "u long, v long, w long").repartition(4)).collect()}
    q = q_of(edges, got)
    assert q == pytest.approx(max(measured)) and q >= 0.13
    assert len(measured) <= 20, len(measured)


def test_silhouette_from_the_definition(spark):
    rows = blobs(1, 20) + [(1000, 9, [50.0] * 5)]
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    each = []
    for i in range(len(rows)):
        own = (y == y[i]) & (np.arange(len(y)) != i)
        a = d[i][own].mean() if own.any() else 0.0
        b = min(d[i][y == k].mean() for k in set(y) - {y[i]})
        each.append((b - a) / max(a, b) if own.any() else 0.0)
    each = np.array(each)
    got = {r.leaf: (r.silhouette, r.n) for r in clusters.silhouette(frame(spark, rows)).collect()}
    assert got[None] == (pytest.approx(each.mean(), abs=1e-6), len(rows))
    assert all(got[k][0] == pytest.approx(each[y == k].mean(), abs=1e-6) for k in set(y.tolist()))
    assert got[9][0] == 0.0
    assert clusters.mean_silhouette(x[:80], y[:80]) == pytest.approx(np.mean([r for r in _silhouettes(x[:80], y[:80])]))
    assert clusters.silhouette(frame(spark, rows), 30).where("leaf is null").first().n == 30
    assert clusters.silhouette(frame(spark, [])).collect() == []


def test_silhouette_takes_all_points(spark, monkeypatch):
    """More than 10,000 points, and blocks that cut leaves: equal to the mean of all; copies are at distance 0."""
    assert clusters.silhouette(frame(spark, [(i, i % 3, [float(i % 7), float(i % 3)]) for i in range(10_020)])).where("leaf is null").first().n == 10_020
    monkeypatch.setattr(clusters, "POINTS", 16)
    rows = blobs(3, 25, far=2.0) + [(500 + i, 5, [1e3] * 5) for i in range(3)]
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    got = {r.leaf: (r.silhouette, r.n) for r in clusters.silhouette(frame(spark, rows)).collect()}
    each = np.array(list(_silhouettes(x, y)))
    assert got[None] == (pytest.approx(each.mean(), abs=1e-6), len(rows)) and got[5] == (1.0, 3)
    assert all(got[k] == (pytest.approx(each[y == k].mean(), abs=1e-6), (y == k).sum()) for k in range(4))


def _silhouettes(x, y):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(len(x)):
        own = (y == y[i]) & (np.arange(len(y)) != i)
        a, b = d[i][own].mean(), min(d[i][y == k].mean() for k in set(y) - {y[i]})
        yield (b - a) / max(a, b)


def test_hungarian_is_best():
    rng = np.random.default_rng(5)
    for n, m in [(1, 1), (3, 3), (4, 6), (6, 6)]:
        for _ in range(20):
            gain = rng.integers(0, 12, (n, m)).astype(float)
            cols = clusters.hungarian(gain)
            assert len(set(cols)) == n
            assert gain[range(n), cols].sum() == max(gain[range(n), p].sum() for p in itertools.permutations(range(m), n))


def test_adjusted_rand():
    assert clusters.adjusted_rand(np.array([0, 0, 1, 1]), np.array([5, 5, 3, 3])) == 1.0
    assert clusters.adjusted_rand(np.array([0, 0, 1, 2]), np.array([0, 0, 1, 1])) == pytest.approx(4 / 7)


def test_normal_scores_have_the_middle_at_zero():
    x = np.arange(101.0)[:, None]
    fit, other = clusters.normal_scores(x, np.array([[50.0], [-5.0], [500.0]]))
    assert fit[50, 0] == pytest.approx(0, abs=1e-9) and other[0, 0] == pytest.approx(0, abs=1e-9)
    assert other[1, 0] < -5 and other[2, 0] > 5 and (np.diff(fit[:, 0]) > 0).all()


def test_locked_vector_bootstrap_reports_source_and_final_ari(spark):
    rng, corner = np.random.default_rng(2), np.array([[1, 1, 1, 1, 1], [1, -1, -1, 1, -1], [-1, 1, -1, -1, 1], [-1, -1, 1, -1, -1]])
    rows = frame(spark, [(i, i % 4, (6 * corner[i % 4] + rng.normal(0, 1, 5)).tolist()) for i in range(240)] + [(9999, -1, [0.0] * 5)])
    scores = clusters.locked_bootstrap(rows, {1: 0, 3: 2}, draws=6)
    got = clusters.stability(scores).first()
    assert got.draws == 6 and got.is_stable and got.source_mean > 0.95 and got.final_mean > 0.95 and got.low <= got.final_mean <= got.high
    noise = [(i, i % 4, np.random.default_rng(i).normal(0, 1, 5).tolist()) for i in range(200)]
    assert not clusters.stability(clusters.locked_bootstrap(frame(spark, noise), draws=4)).first().is_stable
    with pytest.raises(ValueError, match="100 users"):
        clusters.locked_bootstrap(frame(spark, blobs(2, 10)))


def test_split_half_by_hand(spark):
    """Users with their own direction are found; the one whose halves differ is not, and too few texts don't count."""
    rows = [(u, s, [float(u == d) + 0.01 * s for d in range(6)]) for u in range(5) for s in range(8)]
    rows += [(9, s, [float((3 if s < 4 else 5) == d) for d in range(6)]) for s in range(9)] + [(11, s, [1.0] * 6) for s in range(7)]
    texts = spark.createDataFrame(rows, "user_id long, seq long, x array<double>").repartition(3)
    got = clusters.split_half(texts).first()
    assert got.n == 6 and got.rank1 == pytest.approx(5 / 6, abs=1e-6)
    assert 5 / 6 < got.mrr < 1
    assert clusters.split_half(texts.limit(0)).collect() == []


def test_split_half_sends_few_blocks_at_once(spark, monkeypatch):
    """Blocks of users reach Python by bytes, and many small blocks give the ranks of one."""
    rng = np.random.default_rng(1)
    texts = spark.createDataFrame([(u, s, (rng.normal(0, 1, 6) + np.eye(6)[u % 6]).tolist()) for u in range(60) for s in range(8)], "user_id long, seq long, x array<double>").repartition(3)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(1 << 30))
    whole = clusters.split_half(texts, "mean+max").collect()
    assert int(spark.conf.get(key)) <= 4 << 20
    spark.conf.set(key, before)
    monkeypatch.setattr(clusters, "TILE", 7)
    assert clusters.split_half(texts, "mean+max").collect() == whole and whole[0].n == 60


def test_a_leaf_of_two_voices(spark):
    rng = np.random.default_rng(7)
    rows = [(i, 0, (rng.normal(0, 1, 4) + (8 if i < 12 else 0)).tolist()) for i in range(60)] + [(100 + i, 1, rng.normal(0, 1, 4).tolist()) for i in range(19)]
    (got,) = clusters.leaf_splits(frame(spark, rows)).collect()
    assert (got.leaf, got.n_large, got.n_small) == (0, 48, 12) and got.silhouette > 0.5 and got.minority == list(range(10))


def test_dense_index(spark):
    rows = [(i % 3, (i * 37) % 101, float(i)) for i in range(101)]
    got = clusters.dense_index(spark.createDataFrame(rows, "g int, k long, v double").repartition(7), ["g"], ["k"]).collect()
    for g in range(3):
        mine = sorted(((r.pos, r.k) for r in got if r.g == g))
        assert [p for p, _ in mine] == list(range(len(mine))) and [k for _, k in mine] == sorted(k for _, k in mine)


def test_nulls_of_groups_near_zero_for_noise(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 5, rng.normal(0, 1, 16).tolist()) for i in range(400)]
    groups = {r.trial: r.cosine for r in clusters.random_groups(frame(spark, rows)).collect()}
    assert set(groups) == {0, 1, 2, None} and groups[None] == pytest.approx(np.mean([groups[t] for t in range(3)]), abs=1e-6)
    pairs = clusters.random_pairs(frame(spark, rows)).first()
    assert 2900 < pairs.n <= 3000 and math.isclose(pairs.cosine, 0, abs_tol=0.05)
