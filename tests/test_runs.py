import json

from threadloom.sources import runs

GOOD = {"simulation_integrity_passed": True, "simulation_message_count": 5, "simulation_round_count": 3, "simulation_expected_round_count": 3, "run_fingerprint": "f"}


def test_write_json_replaces(spark, tmp_path):
    path = tmp_path / "deep" / "x.json"
    for value in ({"a": 1}, {"a": "é", "long": "y" * 100_000}):
        runs.write_json(spark, str(path), value)
        assert json.loads(path.read_text()) == value
    assert [p.name for p in path.parent.iterdir() if not p.name.endswith(".crc")] == ["x.json"]


def test_completed_runs(spark, tmp_path):
    markers, results = tmp_path / "markers", tmp_path / "results"
    results.mkdir()
    cases = {
        "good": (GOOD, None), "no integrity": ({k: v for k, v in GOOD.items() if k != "simulation_integrity_passed"}, "integrity is not confirmed"), "said": (GOOD | {"simulation_integrity_passed": "true"}, "integrity is not confirmed"),
        "silent": (GOOD | {"simulation_message_count": 0}, "no messages"), "short": (GOOD | {"simulation_round_count": 2}, "rounds differ"), "none": (GOOD | {"simulation_round_count": 0, "simulation_expected_round_count": 0}, "rounds differ"),
        "other": (GOOD | {"run_fingerprint": "g"}, "fingerprints differ"), "unnamed": ({k: v for k, v in GOOD.items() if k != "run_fingerprint"}, "fingerprints differ"), "empty": ({}, "result is broken"), "list": ([1], "result is broken"), "broken": ("{half", "result is broken"), "absent": (None, "result is missing"),
    }
    for name, (value, _) in cases.items():
        path = results / f"{name}.json"
        if value is not None:
            path.write_text(value if isinstance(value, str) else json.dumps(value))
        runs.mark_completed(spark, str(markers), name, str(path), "f")
    (markers / "torn_COMPLETE.json").write_text("{")
    (markers / "blank_COMPLETE.json").write_text('{"result_path": ""}')
    (markers / "x_FAILED.json").write_text("{}")
    got = {r.run_id: r for r in runs.completed_runs(spark, str(markers), str(results)).collect()}
    assert {k: r.reason for k, r in got.items()} == {k: reason for k, (_, reason) in cases.items()} | {"torn": "marker is broken", "blank": "marker names no result"}
    assert [k for k, r in got.items() if r.completed] == ["good"]
