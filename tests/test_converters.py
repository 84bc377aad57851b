import json

import duckdb
import pytest

import __spark_entry__  # noqa: F401

from threadloom.sources import converters, corpora


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_discover(spark, tmp_path):
    for name, files in {"wiki-2004": 2, "deep/wiki-2003": 2, "conversations-gone-AWRY": 2, "cga": 2, "half": 1}.items():
        (tmp_path / name).mkdir(parents=True)
        for f in ("index.json", "utterances.jsonl")[:files]:
            (tmp_path / name / f).write_text("{}")
    got = [r.path.rsplit("/", 1)[-1] for r in converters.discover(spark, str(tmp_path)).collect()]
    assert got == ["wiki-2003", "wiki-2004"]


def test_wiki(spark, tmp_path):
    said = converters.utterances(spark, lines(tmp_path / "utterances.jsonl", [
        {"id": "a", "root": "c1", "speaker": "ann", "text": "  Hello\nthere " + "x" * 200, "timestamp": "1.189190940E09", "reply-to": None, "meta": {"k": 1}},
        {"id": "b", "root": "c1", "speaker": {"id": "bob"}, "text": None, "timestamp": "odd", "reply-to": "a"}, {"id": "x", "root": "c1", "speaker": "", "reply-to": "a"},
        {"id": "d", "conversation_id": "c2", "user": "dan", "text": " ", "timestamp": 5}, {"id": "e", "conversation_id": "c3", "speaker": "eve", "text": "t"}, "{broken",
    ]))
    about = converters.conversations(spark, lines(tmp_path / "conversations.json", ['{"c3": {"meta": {"page_title": "", "title": "Given"}}, "c1": {"meta": {}}}']))
    got = {r.comment_id: r for r in converters.wiki_records(said, about).collect()}
    assert set(got) == {"a", "b", "d", "e"}
    assert got["a"].page_title == ("Hello there " + "x" * 200)[:120] == got["b"].page_title and got["d"].page_title == "c2" and got["e"].page_title == "Given"
    assert got["a"].timestamp == "2007-09-07T18:49:00" and got["b"].timestamp is None and got["b"].text == "" and got["b"].parent_comment_id == "a"
    # what was written is what the reader takes
    converters.wiki_records(said, about).write.json(str(tmp_path / "flat"))
    assert {r.msg_id: r.user_id for r in corpora.flat_messages(spark, str(tmp_path / "flat")).collect()} == {"a": "ann", "b": "bob", "d": "dan", "e": "eve"}


def test_reddit(spark):
    rows = [
        ("t3_p", "t3_p", "op", "CMV: it is so", None, None, None), ("t1_a", "t3_p", "ann", "no", "200", "t3_p", '{"success": 1}'), ("t1_b", "t3_p", None, "!delta well", "150", "t1_a", None), ("t1_c", "t3_p", "", "x", "9", "t1_a", None),
        ("t1_d", "t3_p", "dan", "y", None, None, '{"success": null, "delta": "Yes "}'), ("t1_e", "t3_q", "eve", "orphan", "7", "t3_q", '{"delta_awarded": false}'), ("t1_f", "t3_q", "fay", "Delta awarded", None, "t1_e", '{"success": [1]}'),
    ]
    said = spark.createDataFrame(rows, "id string, conversation_id string, speaker string, text string, timestamp string, reply_to string, meta string").repartition(3)
    about = spark.createDataFrame([("t3_q", '{"title": "q", "selftext": "Body", "op": "quin"}')], "conversation_id string, meta string")
    posts, comments = converters.reddit_records(said, about)
    p, q = (r for r in posts.orderBy("id").collect())
    assert (p.submission_id, p.author, p.title, p.created_utc) == ("p", "op", "CMV: it is so", 9)
    assert (q.author, q.title, q.selftext, q.created_utc) == ("quin", "Body", "Body", 7)  # a title that is the id is none
    got = {r.comment_id: r for r in comments.collect()}
    assert {k: (r.author, r.parent_comment_id, r.delta_awarded) for k, r in got.items()} == {
        "t1_a": ("ann", "t3_p", True), "t1_b": ("[deleted]", "t1_a", True), "t1_d": ("dan", "t3_p", True), "t1_e": ("eve", "t3_q", False), "t1_f": ("fay", "t1_e", True),
    }


@pytest.mark.parametrize(("meta", "want"), [('{"success": true}', True), ('{"success": false, "delta": 1}', False), ('{"success": 1.0}', True), ('{"success": "1.0"}', False), ('{"delta_label": " TRUE "}', True), ('{"success": 0}', False), ("{broken", False), (None, False), ("{}", False)])
def test_delta_flags(spark, meta, want):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(meta, "plain")], "meta string, text string")
    assert frame.select(converters.won_delta(F.col("meta"), F.col("text"))).first()[0] is want


def test_github(spark, tmp_path):
    pages = converters.github_pages(
        spark,
        lines(tmp_path / "i", [{"repo": "o/r", "number": 1, "title": "T", "body": None, "user": {"login": "ann"}, "created_at": "2020", "labels": [{"name": "bug"}, {"name": ""}]}, {"repo": "o/r", "number": 2, "pull_request": {"url": "x"}}, {"repo": "o/r", "number": 3, "user": None}]),
        lines(tmp_path / "c", [{"repo": "o/r", "id": 9, "issue_url": "https://h/repos/o/r/issues/1", "body": "hi", "user": {"login": "bob"}}, {"repo": "o/r", "id": 10, "issue_url": "https://h/repos/o/r/issues/2"}]),
        lines(tmp_path / "e", [{"repo": "o/r", "id": k, "event": e, "actor": {"login": "cy"}, "label": {"name": "bug"}, "issue": {"number": 1}} for k, e in enumerate(("labeled", "closed", "reopened", "assigned"))]),
    )
    got = {r.event_id: r for r in converters.github_records(*pages).collect()}
    assert {k: r.event_type for k, r in got.items()} == {"o/r#1_opened": "issue_opened", "o/r#3_opened": "issue_opened", "9": "comment", "0": "labeled", "1": "issue_closed", "2": "issue_reopened"}
    assert got["o/r#1_opened"].labels == ["bug"] and got["o/r#3_opened"].title == "o/r#3" and got["o/r#3_opened"].author == "" and got["9"].title == "T" and got["0"].labels == ["bug"] and got["1"].labels == []


@pytest.mark.parametrize("name", ["l16_wiki_records", "l17_reddit_submissions", "l17_reddit_comments"])
def test_twins(spark, name):
    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    made = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.01")
    columns = sorted(made.columns)
    want = con.execute(f"select {', '.join(columns)} from ({__spark_entry__.oracle_sql()[name]}) q").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in made.select(*columns).collect()) and want
