import random
import re

import pytest

from threadloom.llm.jaccard import HEAVY, _Join, keep_one, near_duplicates, shingle_set


def brute(rows):
    sets = []
    for _, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    ids = lambda x: min((d for d in x if d is not None), default=None)
    return sorted(((d, len(sets[i]), ids(least[find(i)])) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=220, common=0):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghXYZé") + str(rng.randint(0, 60))
    bases = [[word() for _ in range(rng.randint(6, 140))] for _ in range(14)]
    line = [word() for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.75 else [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 6)):
            if w:
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [word() for _ in range(rng.randint(0, 2))]
        if rng.random() < common:
            w = line + w
        rows.append((i, rng.choice([" ", "\n", "\t"]).join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, "  "), (n + 3, "a b"), (n + 4, "A\tB"), (n + 5, "a a a a a"), (n + 6, "a a a a a a"), (None, rows[2][1]), (4, rows[4][1]), (n + 7, "q " * 9000)]
    return rows


@pytest.mark.parametrize(("seed", "common", "heavy"), [(1, 0, 65_535), (2, 0.8, 200), (3, 0.5, 40)])
def test_like_brute_force(spark, seed, common, heavy):
    rows = corpus(seed, common=common)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, label string").repartition(5)
    got = sorted((tuple(r) for r in near_duplicates(docs, heavy).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows)


def test_one_of_each_stays(spark):
    rows = corpus(5, n=80)
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, uid string")
    kept = keep_one(docs).collect()
    assert kept[0].__fields__ == docs.columns
    groups = {x[2] if x[1] else ("alone", x[0]) for x in brute(rows)}
    assert len(kept) == len(groups)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tiles_make_a_pair_once(spark):
    """Near sets that share many prefix shingles meet in one tile, and every pair that links meets."""
    rng = random.Random(12)
    rows = []
    for base in range(4):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(500)]
        for _ in range(9):
            own = list(words)
            for _ in range(4):
                own[rng.randrange(500)] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    join = _Join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), HEAVY)
    alone = spark.createDataFrame([], "node long, label long")
    name = {r.uid: r.id for r in join.nodes.select("uid", "id").collect()}
    met = [tuple(sorted((name[r.u], name[r.v]))) for r in join.met(alone).collect()]
    sets = [set(shingle_set(t.encode()).tolist()) for _, t in rows]
    linked = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert len(linked) > 20 and linked <= set(met)
    assert len(met) <= 1.05 * len(set(met))


def test_a_group_of_near_copies_takes_few_tests(spark, monkeypatch):
    """Copies of one text that a dozen common lines join with strangers: tests and pairs grow with the sets, not with their square."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    base, lines = [word() for _ in range(110)], [[word() for _ in range(9)] for _ in range(12)]
    rows = []
    for i in range(360):
        own = list(base) if i >= 120 else [word() for _ in range(60)]
        for _ in range(rng.randint(1, 4) if i >= 120 else 0):
            own[rng.randrange(len(own))] = word()
        rows.append((i, " ".join(sum(rng.sample(lines, 5) if i < 120 else lines[:4], []) + own)))
    tested, met = [], []
    verify, meet = _Join.verify, _Join.met
    monkeypatch.setattr(_Join, "verify", lambda self, pairs: tested.append(pairs.count()) or verify(self, pairs))
    monkeypatch.setattr(_Join, "met", lambda self, labels: met.append(meet(self, labels).count()) or meet(self, labels))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((tuple(r) for r in near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows)
    assert sum(tested) <= 8 * len(rows) and sum(met) <= 8 * len(rows), (tested, met)


def test_few_rounds_where_candidates_are_few(spark, monkeypatch):
    """With a few candidates to a set they are tested at once, and components are found once for the hubs and once for the rest."""
    from threadloom.llm import jaccard

    rows = corpus(5, n=260, common=0.8)
    found, tested = [], []
    find, verify = jaccard.components, _Join.verify
    monkeypatch.setattr(jaccard, "components", lambda edges: found.append(1) or find(edges))
    monkeypatch.setattr(_Join, "verify", lambda self, pairs: tested.append(1) or verify(self, pairs))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((tuple(r) for r in near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows)
    assert len(tested) == 2 and len(found) == 2


def test_components_of_repeated_and_turned_edges(spark):
    """Paths, stars and cycles, with repeats, both turns and loops."""
    from threadloom.llm import components as module

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 17) for i in range(17)]
    edges += [(b, a) for a, b in edges[::3]] + edges[::5] + [(7, 7), (900, 900)] + [(rng.randint(300, 360), rng.randint(300, 360)) for _ in range(45)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(edges, "u long, v long").repartition(3)
    got = {r.node: r.label for r in module.components(frame).collect()}
    assert got == {x: y for x, y in label.items() if any(x in e and e[0] != e[1] for e in edges)}
    plan = module._large(frame.where("u > v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1, plan  # edges are not made distinct twice a round
