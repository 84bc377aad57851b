import duckdb
import numpy as np
import pytest

import __spark_entry__  # noqa: F401

from threadloom.operators import sqlop, verdicts

SCHEMA = "condition string, dataset string, model string, repeat long, message_count long, action_distance double, interaction_distance double, language_distance double, safe_rate double, consistency double"


def verdict(spark, change=None, control=None, repeats=3):
    rows = []
    for repeat in range(repeats):
        base = dict(dataset="d", model="m", repeat=repeat, message_count=100, safe_rate=0.0, consistency=0.95)
        rows.append(base | dict(condition="plain", action_distance=1.0, interaction_distance=1.0, language_distance=1.0) | (control or {}))
        rows.append(base | dict(condition="full", action_distance=0.9, interaction_distance=0.9, language_distance=0.9) | (change or {}))
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    return sqlop._run(verdicts.viability("full", "plain", verdicts.METRICS), {"results": frame}).first()


def test_viability_go(spark):
    got = verdict(spark)
    assert (got.verdict, got.metric_wins, got.required_repeat_wins, got.n_pairs) == ("GO", 3, 2, 3)


@pytest.mark.parametrize(
    "change",
    [
        {"action_distance": 0.99, "interaction_distance": 0.99, "language_distance": 0.99},
        {"language_distance": 1.2},
        {"consistency": 0.8},
        {"consistency": None},
        {"safe_rate": 0.2},
        {"message_count": 94},
    ],
    ids=["effect", "regression", "text", "no text", "templates", "throughput"],
)
def test_viability_stop_guards(spark, change):
    assert verdict(spark, change).verdict == "STOP"


def test_viability_borders(spark):
    few = verdict(spark, repeats=2)
    assert (few.verdict, few.reason, few.n_pairs) == ("CONDITIONAL_GO", "insufficient_complete_pairs", 2)
    assert verdict(spark, repeats=0).verdict == "CONDITIONAL_GO"
    one = verdict(spark, {"interaction_distance": 1.0, "language_distance": 1.0})
    assert (one.verdict, one.metric_wins) == ("CONDITIONAL_GO", 1)
    lacking = verdict(spark, {"interaction_distance": None, "language_distance": None})
    assert (lacking.verdict, lacking.metric_wins) == ("CONDITIONAL_GO", 1)
    assert verdict(spark, control={"message_count": 0}).verdict == "STOP"  # no ratio: the guard isn't passed
    assert verdict(spark, {"dataset": None}, {"dataset": None}).n_pairs == 9 / 3


def test_dissociation(spark):
    rng = np.random.default_rng(4)
    means = {"full": (0.1, 0.2, 0.3, 0.9), "no a": (0.9, 0.25, 0.3, 0.9), "no b": (0.12, 0.9, 0.33, 0.88), "no c": (0.1, 0.2, 0.7, 0.2)}
    rows = [(c, "d", "m", r, 1, *(float(x + rng.normal(0, 0.02)) for x in m[:3]), 0.0, float(m[3] + rng.normal(0, 0.02))) for c, m in means.items() for r in range(6)]
    layers = {"a": ("action_distance",), "b": ("interaction_distance",), "c": ("language_distance", "consistency")}
    run = lambda expected, rows=rows: {r.condition: r for r in sqlop._run(verdicts.dissociation("full", expected, layers, frozenset({"consistency"})), {"results": spark.createDataFrame(rows, SCHEMA)}).collect()}
    got = run({"no a": "a", "no b": "b", "no c": "c"})
    x = {c: np.array([[r[5], r[6], r[7], r[9]] for r in rows if r[0] == c]) for c in means}
    z = {c: (x[c].mean(0) - x["full"].mean(0)) / x["full"].std(0) * [1, 1, 1, -1] for c in means if c != "full"}
    loss = {c: np.array([v[0], v[1], v[2:].mean()]) for c, v in z.items()}
    r = np.corrcoef(np.stack(list(loss.values())))
    for c, g in got.items():
        assert g.observed == c[-1] and g.matches and g.supported and g.loss == pytest.approx(loss[c].max(), abs=1e-5)
        assert g.mean_correlation == pytest.approx(r[~np.eye(3, dtype=bool)].mean(), abs=1e-5)
    wrong = run({"no a": "b", "no b": "b", "no c": "c"})
    assert not any(g.supported for g in wrong.values()) and not wrong["no a"].matches
    flat = [r[:5] + (None,) * 3 + r[8:] for r in rows]  # one layer left: no profile correlates
    assert not any(g.supported for g in run({"no a": "c", "no b": "c"}, flat).values())


@pytest.mark.parametrize("name", ["s16_dissociation", "s19_viability"])
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.01").toPandas()
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(map(tuple, got[sorted(got)].astype(str).values.tolist())) == sorted(map(tuple, want[sorted(want)].astype(str).values.tolist()))
