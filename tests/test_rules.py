import duckdb
import numpy as np

import __spark_entry__  # noqa: F401

from threadloom.operators import rules
from threadloom.operators.rules import drop_overlaps

SCHEMA = "scope string, place int, tokens array<string>, note string"


def in_order(rows):
    seen, kept = {}, {}
    for scope, place, tokens, _ in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        mine = {t for t in tokens or [] if t is not None}
        kept[scope, place] = not mine & seen.setdefault(scope, set())
        if kept[scope, place]:
            seen[scope] |= mine
    return kept


def check(spark, rows):
    got = drop_overlaps(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    assert {(r.scope, r.place): r.kept for r in got} == in_order(rows)


def test_random_rules(spark):
    rng = np.random.default_rng(2)
    rows = [(("a", "b", None)[i % 3], i, [f"t{t}" for t in rng.integers(0, 90, rng.integers(0, 4))], "x") for i in range(240)]
    check(spark, rows + [("a", 1000, None, None), ("a", 1001, [None, ""], "x"), ("a", 1002, [""], "x")])


def test_a_chain_that_waits(spark):
    """Each rule shares a token with the next: every other one stays."""
    check(spark, [("a", i, [f"l{i}", f"l{i + 1}"], "") for i in range(9)])


def test_a_token_of_all(spark):
    check(spark, [("a", i, ["all", f"own{i}"], "") for i in range(50)])


def test_equal_places_and_no_rows(spark):
    got = drop_overlaps(spark.createDataFrame([("a", 1, ["x"], "p"), ("a", 1, ["x"], "q"), ("a", 1, ["y"], "r")], SCHEMA)).collect()
    assert sorted(r.kept for r in got if r.tokens == ["x"]) == [False, True] and [r.kept for r in got if r.tokens == ["y"]] == [True]
    assert drop_overlaps(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    """Rows made for each salt look small to Spark, which sent them through the driver."""
    plans, before = [], rules.materialize
    monkeypatch.setattr(rules, "materialize", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or before(df, *a))
    out = drop_overlaps(spark.createDataFrame([("a", i, [f"t{i % 7}", f"own{i}"], "") for i in range(300)], SCHEMA))
    assert out.where("kept").count() == 7
    assert not [p for p in [*plans, out._jdf.queryExecution().executedPlan().toString()] if "Broadcast" in p]


def test_twin(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got = sorted((r.leaf, r.msg_id, r.kept) for r in __spark_entry__.queries()["o06_rule_overlap"](spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(con.execute(__spark_entry__.oracle_sql()["o06_rule_overlap"]).fetchall()) and any(not k for *_, k in got) and any(k for *_, k in got)
