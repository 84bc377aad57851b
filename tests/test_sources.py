import json

import pytest

import __spark_entry__  # noqa: F401

from threadloom.operators.registry import queries
from threadloom.sources import corpora


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_wiki_utterances(spark, tmp_path):
    rows = [
        {"id": "u1", "conversation_id": "c", "speaker": {"id": "ann"}, "text": "hi", "timestamp": 1.18e9, "meta": {"toxicity": 0.5, "indentation": "2", "deletion": [{"speaker": "bob", "timestamp": "1180000001", "text": "x"}, {"speaker": ""}]}},
        {"id": "u2", "root": "c", "speaker": "carl", "reply-to": "u1", "timestamp": "2020-01-02T03:04:05Z"},
        {"id": "u3", "speaker": ""}, "", "{broken",
    ]
    got = {r.msg_id: r for r in corpora.wiki_utterances(spark, lines(tmp_path / "utterances.jsonl", rows)).collect()}
    assert set(got) == {"u1", "u2", "u1::deletion::0"}
    assert got["u1"].user_id == "ann" and got["u1"].indentation == 2 and got["u1"].ts.year == 2007
    assert got["u2"].parent_msg_id == "u1" and got["u2"].thread_id == "c" and got["u2"].ts.year == 2020
    event = got["u1::deletion::0"]
    assert (event.user_id, event.action, event.parent_msg_id) == ("bob", "delete", "u1")


def test_flat_messages(spark, tmp_path):
    rows = [
        {"comment_id": "1", "page_title": "T", "author": "a", "content": "x", "timestamp": "not a time"},
        {"_source": {"rev_id": "2", "thread_id": "T", "user": "b", "comment": "y", "reply_to": "1"}},
        {"id": "3", "thread_id": "T"},
    ]
    got = {r.msg_id: r for r in corpora.flat_messages(spark, lines(tmp_path / "flat.jsonl", rows)).collect()}
    assert set(got) == {"1", "2"} and got["1"].ts is None and got["1"].action == "discuss"
    assert got["2"].action == "edit" and got["2"].parent_msg_id == "1" and got["2"].text == "y"


def test_reddit(spark, tmp_path):
    posts = corpora.reddit_submissions(spark, lines(tmp_path / "s.jsonl", [{"id": "p", "author": "a", "title": "T", "selftext": "body", "created_utc": 1.5e9}])).first()
    assert (posts.msg_id, posts.text, posts.action) == ("p_0", "T\n\nbody", "post")
    rows = [
        {"id": "t1_c1", "link_id": "t3_p", "author": "b", "body": "However, I disagree with all of it", "parent_id": "t3_p"},
        {"id": "c2", "link_id": "t3_p", "author": "a", "body": "ok", "parent_id": "t1_c1", "delta_awarded": True},
        {"id": "c3", "link_id": "t3_p", "author": "c", "body": "However it is so", "parent_id": "t1_c2"},
    ]
    got = {r.msg_id: r for r in corpora.reddit_comments(spark, lines(tmp_path / "c.jsonl", rows)).collect()}
    assert got["c1"].action == "counter_argue" and got["c1"].parent_msg_id == "p_0"
    assert got["c2"].action == "award_delta" and got["c2"].parent_msg_id == "c1" and got["c3"].action == "reply"


def test_github_and_side_files(spark, tmp_path):
    rows = [{"repo": "r", "issue_number": 3, "event_type": "issue_closed", "author": "a", "created_at": "2020-01-02T03:04:05Z", "id": "e"}, {"repo": "r", "issue_number": 3, "event_type": "odd", "user": "b"}]
    got = corpora.github_events(spark, lines(tmp_path / "g.jsonl", rows)).collect()
    assert [(r.thread_id, r.action) for r in got] == [("r#3", "close"), ("r#3", "comment")] and all(r.msg_id for r in got)
    meta = corpora.conversation_meta(spark, lines(tmp_path / "conversations.json", ['{"c1": {"meta": {"page_type": "talk"}}, "c2": {"meta": {"page_title": "x"}}}']))
    assert sorted((r.thread_id, r.page_type) for r in meta.collect()) == [("c1", "talk"), ("c2", None)]
    assert corpora.year_folders(["/x/w-2003", "/x/w-2004/"], {2004}) == ["/x/w-2004/"]
    with pytest.raises(ValueError, match="2010"):
        corpora.year_folders(["/x/w-2003"], {2010})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "leaf int, text string")
    corpora.write_leaf_profiles(df, str(tmp_path / "p"))
    corpora.write_results(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "p")).count() == 2 and spark.read.parquet(str(tmp_path / "r/parquet")).count() == 2


@pytest.mark.parametrize("name", ["d04_ks_pvalue", "d05_dtw", "d07_rsa", "j13_greedy_matching", "x17_greedy_dedup", "json_spans"])
def test_rows_only_operators(spark, name):
    first = sorted(map(str, queries()[name](spark, "/root/testdata/sf0.001").collect()))
    assert first == sorted(map(str, queries()[name](spark, "/root/testdata/sf0.001").collect()))
