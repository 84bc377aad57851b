"""Every SQL operator against its twin, and hand-checked values."""

import hashlib
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from threadloom.operators import registry
from threadloom.operators.dialect import expand
from threadloom.operators.fidelity import clustering
from threadloom.operators.kernels import assignment, chain_depth, dtw, find_json, greedy_keep, ks_pvalue, typical, wilcoxon_exact
from threadloom.operators.sqlop import BODIES, apply

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.number)):
            return f"{float(v):.6f}".replace("-0.000000", "0.000000")
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(value(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_like_the_twin(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert "threadloom.llm" not in str(registry.queries())


def messages(spark, rows):
    """(id, user, parent, action, round) in one thread."""
    full = [(i, 1, i, n, u, f"2024-01-01 00:0{n}:00", p, a, 0.1 * n, 0.0, n, 1, "talk", r, "sim" if u % 2 else "real", u % 5) for n, (i, u, p, a, r) in enumerate(rows)]
    return spark.createDataFrame(full, "msg_id long, thread_id long, seq long, idx long, user_id long, ts string, parent_id long, action string, toxicity double, severe_toxicity double, indentation long, topic long, page_type string, round int, side string, community long").selectExpr("* except (ts)", "cast(ts as timestamp) as ts")


def test_ei_index_of_a_triangle(spark):
    # users 0, 5 and 1: labels 0, 0, 1; edges 0-5 inside, 0-1 and 5-1 across
    rows = [(1, 0, None, "discuss", 0), (2, 5, 1, "discuss", 0), (3, 1, 1, "discuss", 0), (4, 1, 2, "discuss", 0)]
    assert apply("g05_ei_index", messages=messages(spark, rows)).first().ei_index == pytest.approx(1 / 3, abs=1e-6)


def test_reply_targets_beside_runs_ties_and_nulls(spark):
    """No join of a thread with itself, and the same as one: runs of a user, places that several share, rows without a user."""
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, int(rng.integers(0, 40)), None if i % 17 == 0 else int(rng.integers(0, 3))) for i in range(200)]
    rows += [(1000 + i, 7, i, 5 if i < 30 else 6) for i in range(40)]
    frame = spark.createDataFrame(rows, "msg_id long, thread_id long, seq long, user_id long").repartition(3)
    found = apply("w12_reply_target", messages=frame)
    want = {}
    for i, t, s, u in rows:
        before = [b for _, c, b, v in rows if c == t and b < s and None not in (u, v) and v != u]
        want |= {i: max(before)} if before else {}
    assert {r.msg_id: r.target for r in found.collect()} == want
    assert "b.seq < a.seq" not in BODIES["w12_reply_target"]


def test_clustering_of_a_hub(spark):
    """Each triangle is met once, at its corner of the least degree: a hub's pairs of neighbours are never formed."""
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1, 199, 2)]
    full = clustering(spark.createDataFrame(edges, "u long, v long").repartition(3), spark.range(201))
    got = {r.id: (r.k, r.cc) for r in full.collect()}
    assert got[0] == (199, pytest.approx(2 * 99 / (199 * 198))) and got[1] == (2, 1.0) and got[199] == (1, 0.0) and got[200] == (0, 0.0)


def test_modularity_of_two_pairs(spark):
    rows = [(1, 0, None, "discuss", 0), (2, 5, 1, "discuss", 0), (3, 1, None, "discuss", 0), (4, 6, 3, "discuss", 0)]
    assert apply("g04_modularity", messages=messages(spark, rows)).first().modularity == pytest.approx(0.5)


def test_labels_are_the_communities_given(spark):
    """Communities are read from their column; who has none shares -1, and counts in no E-I pair."""
    rows = [(1, 10, None, "discuss", 0), (2, 11, 1, "discuss", 0), (3, 12, 1, "discuss", 0), (4, 13, 2, "discuss", 0)]  # edges 10-11, 10-12, 11-13
    m = messages(spark, rows).drop("community")
    labels = {10: 7, 11: 7, 12: 8, 13: None}
    m = m.join(spark.createDataFrame(list(labels.items()), "user_id long, community long"), "user_id")
    assert apply("g05_ei_index", messages=m).first().ei_index == pytest.approx(0.0)
    # degrees 2 2 1 1, m = 3: 1/3 - (4/6)**2 - (1/6)**2 - (1/6)**2
    assert apply("g04_modularity", messages=m).first().modularity == pytest.approx(1 / 3 - 4 / 9 - 2 / 36, abs=1e-6)
    covered = apply("g02_label_coverage", messages=m).first()
    assert (covered.node_coverage, covered.edge_coverage) == (pytest.approx(0.75), pytest.approx(2 / 3, abs=1e-6))
    assert {(r.community, r.n) for r in apply("g03_partition_cover", messages=m).collect()} == {(7, 2), (8, 1), (-1, 1)}


def test_chain_depth(spark):
    rows = [(1, 5, None), (1, 6, 5), (1, 7, 99), (1, 8, 6), (2, 1, 2), (2, 2, 1), (3, 4, 4)]
    got = {(r.msg_id): r.depth for r in chain_depth(spark.createDataFrame(rows, "thread_id long, msg_id long, parent_id long")).collect()}
    assert [got[i] for i in (5, 6, 7, 8)] == [1, 2, 1, 3] and {got[1], got[2]} == {1, 2} and got[4] == 1


def test_structural_fidelity_of_equal_sides(spark):
    rows = [(1, 0, None, "discuss", 0), (2, 2, 1, "discuss", 0), (3, 4, 2, "discuss", 0), (4, 6, 2, "discuss", 0), (5, 1, None, "discuss", 0), (6, 3, 5, "discuss", 0), (7, 5, 6, "discuss", 0), (8, 7, 6, "discuss", 0)]
    assert apply("g07_structural_fidelity", messages=messages(spark, rows)).first().fidelity == pytest.approx(1.0)


def test_scrubbing_of_handles(spark):
    said = ["As Colonel83 said", "x Foo12 Bar34, Abc1234567 Ab1 no", "Colonel83 first", "mail a.b@c.org by Jack99. 12345678"]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "msg_id long, text string")
    want = ["As [MENTION] said", "x [MENTION] [MENTION], Abc1234567 Ab1 no", "Colonel83 first", "mail [EMAIL] by [MENTION]. [ID]"]
    assert [r.digest for r in apply("p09_scrubbed_messages", texts=texts).orderBy("msg_id").collect()] == [hashlib.md5(t.encode()).hexdigest() for t in want]


def test_identities(spark):
    rows = [(1, 0, None, "discuss", 0), (2, 1, 1, "discuss", 0), (3, 2, 1, "edit", 0), (4, 3, 1, "edit", 0)]
    m = messages(spark, rows)
    assert apply("d06_action_ned", messages=m).first().ned == 0
    assert apply("o03_coverage", messages=m).first().coverage == 1
    assert apply("d09_uniformity", messages=m).first().uniformity == pytest.approx(1.0)
    apart = messages(spark, [(1, 0, None, "discuss", 0), (2, 1, 1, "edit", 0)])
    assert apply("d06_action_ned", messages=apart).first().ned == pytest.approx(math.sqrt(math.log(2)), abs=1e-6)


def test_order_of_rows_does_not_matter(spark):
    rows = [(i, i % 4, i - 1 if i else None, ("discuss", "edit", "revert")[i % 3], i % 2) for i in range(30)]
    m = messages(spark, [(i, u, p, a, r) for i, u, p, a, r in rows][:10])
    again = m.orderBy(m.msg_id.desc()).repartition(3)
    for name in ("u00_user_features", "m01_round_metrics", "x01_stratified_sample"):
        assert sorted(map(str, apply(name, messages=m).collect())) == sorted(map(str, apply(name, messages=again).collect()))


def test_observed_continuation_uses_same_thread_prefix_and_suffix(spark):
    """The suffix must hold a reply within itself, by parent ids and not by places; an event in it is preferred."""
    star = [(i, i % 3, 1 if i > 1 else None, "discuss", 0) for i in range(1, 7)]
    assert apply("x08_continuation_split", messages=messages(spark, star)).collect() == []
    reply = [*star[:5], (6, 0, 4, "discuss", 0)]  # place 5 answers place 3
    assert [r.split for r in apply("x08_continuation_split", messages=messages(spark, reply)).collect()] == [3]
    event = [(*r[:3], "edit" if r[0] == 3 else "discuss", 0) for r in reply]  # the only event is at place 2
    assert [r.split for r in apply("x08_continuation_split", messages=messages(spark, event)).collect()] == [2]


def test_summary_items_get_boost(spark):
    rows = [(1, 10, 0, "system", "old summary"), (1, 11, 1, "user", "an event"), (1, 12, 2, "user", "the last event")]
    turns = spark.createDataFrame(rows, "thread_id long, msg_id long, seq long, role string, text string")
    got = {r.msg_id: r.score for r in apply("w06_memory_ranking", turns=turns).collect()}
    assert got == {10: pytest.approx(1.25), 11: pytest.approx(1 / 1.1, abs=1e-6), 12: pytest.approx(1.0)}


def test_counter_arguments(spark):
    rows = [(1, None, "I don't think that this is so."), (2, 1, "I don't think that this is so."), (3, 1, "But I don't think so, really."), (4, None, "but no"), (5, None, "Nothing of the kind is said here.")]
    turns = spark.createDataFrame(rows, "msg_id long, parent_id long, text string")
    assert {r.msg_id: r.counter for r in apply("l10_counter_argument", turns=turns).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_kernels():
    assert dtw([0, 1], [0, 2]) == 2.0 and dtw([1, 2, 3], [1, 2, 3]) == 0
    assert ks_pvalue(0.0, 5, 5) == 1.0 and ks_pvalue(1.0, 50, 50) < 1e-6
    assert wilcoxon_exact([1, 2, 3], 6) == pytest.approx(1 / 8) and wilcoxon_exact([], 0) == 1.0
    assert assignment(np.array([[1, 5, 0], [4, 6, 0], [0, 0, 1]])) == [1, 0, 2]
    assert greedy_keep(np.array([[1, 0], [1, 0.01], [0, 1.0]])) == [0, 2]
    assert find_json('<think>{</think> so ```json {"a": "}", "b": [1, 2,],} ```') == '{"a": "}", "b": [1, 2]}'
    assert find_json("none") is None and find_json('{"a": 1') is None


def test_dialects():
    assert expand("@r6(avg(@f(x)))", spark=True) == "cast(round(avg(cast(x as double)) + 1e-10, 6) + 0.0D as double)"
    assert expand("@replace(t, @re('a, b'), 'c')", spark=False) == "regexp_replace(t, 'a, b', 'c', 'g')"
    assert expand("SELECT 1.5, '1.5'", spark=True) == "SELECT 1.5D, '1.5'"


def test_greedy_dedup_visits_all_of_a_leaf(spark, tmp_path):
    """600 near copies come first by id; those after them are kept too, and the nearest to the centroid is visited first."""
    rng = np.random.default_rng(4)
    near = np.concatenate([np.ones(64) + rng.normal(0, 0.01, (600, 64)), rng.normal(0, 1, (30, 64))])
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(near)] + [(1000 + i, [float(x) for x in rng.normal(3, 1, 64)], 1) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.leaf, r.user_id) for r in registry.queries()["x17_greedy_dedup"](spark, str(tmp_path)).collect()}
    vectors = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    leaf = {i: g for i, _, g in rows}
    centre = {g: np.mean([vectors[i] for i in leaf if leaf[i] == g], axis=0) for g in (0, 1)}
    score = {i: round(float(np.linalg.norm(v - centre[leaf[i]]) - np.linalg.norm(v - centre[1 - leaf[i]])), 6) for i, v in vectors.items()}
    want = set()
    for g in (0, 1):
        ids = sorted((i for i in leaf if leaf[i] == g), key=lambda i: (score[i], i))
        want |= {(g, ids[k]) for k in greedy_keep(np.stack([vectors[i] for i in ids]))}
    assert got == want and sum(600 <= i < 1000 for _, i in got) == 30


def test_typical_stops_at_the_first_overflow(spark):
    rows = [(0, i, float(i), [float(i == j) for j in range(60)], 400 if i else 5000) for i in range(60)]
    frame = spark.createDataFrame(rows, "leaf int, user_id long, score double, x array<double>, n_chars int")
    assert sorted(r.user_id for r in typical(frame, most_chars=3000).collect()) == list(range(6))  # 1000 at most of a text
    assert sorted(r.user_id for r in typical(frame, most_chars=10**6).collect()) == list(range(40))


@pytest.mark.parametrize("name", ["r08_streaming_rounds", "r10_streaming_sessions"])
def test_streams_over_many_files_in_any_order(spark, tmp_path, name):
    """Twelve files, latest first: nothing is late, and the last windows and sessions are there; a gap of just 30 minutes ends none."""
    minutes = [0, 10, 40, 71, 100, 200, 1500, 1530, 1561, 1600, 9000, 9001, 9031, 20000]
    rows = [(i, m, i % 2, ("view", "error", "signup")[i % 3]) for i, m in enumerate(m for m in minutes for _ in range(2))]
    frame = spark.createDataFrame(rows, "event_id long, m int, user_id long, event_type string")
    frame = frame.selectExpr("event_id", "cast(timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m) as timestamp_ntz) as ts", "user_id", "event_type", "1.0D as value", """'{"k": 1}' as props""")
    for k in range(12):
        frame.where(f"event_id % 12 = {11 - k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert plain(got) == plain(want) and got["n"].sum() == len(rows)
