"""Discussion corpora as canonical messages: JSON lines read with explicit schemas, alternatives coalesced.

Nothing is inferred from the data, so one odd record can't change a schema; broken lines are
kept aside by the reader's permissive mode and dropped.  Values that can't be read are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MESSAGE = ("msg_id", "thread_id", "user_id", "platform", "ts", "text", "action", "parent_msg_id", "topic")

#: Markers of a counter-argument.
COUNTER_MARKERS = ("however", "but ", "disagree", "on the other hand", "although", "counterpoint", "not true", "i don't think", "actually", "instead", "wrong")
#: Event type of an issue tracker -> action.
ISSUE_ACTIONS = {"issue_opened": "post", "issue_closed": "close", "issue_reopened": "reopen", "comment": "comment", "labeled": "label", "assigned": "assign"}


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def read_time(value: Column) -> Column:
    """Epoch seconds (also 1.18E09) or ISO text to a timestamp; null if neither."""
    return F.coalesce(F.timestamp_micros((value.try_cast("double") * 1_000_000).try_cast("long")), F.try_to_timestamp(value))


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path).where("_corrupt_record is null").drop("_corrupt_record")


def wiki_utterances(spark: SparkSession, path: str) -> DataFrame:
    """Utterances and their events: each modification, deletion and restoration is a row of the acting user."""
    event = "array<struct<speaker:string,timestamp:string,text:string>>"
    raw = _lines(spark, path, "id string, conversation_id string, root string, speaker string, text string, timestamp string, `reply-to` string, reply_to string, "
                 f"meta struct<toxicity:double,sever_toxicity:double,is_section_header:boolean,indentation:string,modification:{event},deletion:{event},restoration:{event}>")  # fmt: skip
    who = F.coalesce(F.get_json_object("speaker", "$.id"), F.col("speaker"))
    base = raw.withColumn("who", F.nullif(who, F.lit(""))).withColumn("thread", first_filled(F.col("conversation_id"), F.col("root"), F.col("id")))
    columns = lambda msg, user, when, text, action, parent: (
        msg.alias("msg_id"), F.col("thread").alias("thread_id"), user.alias("user_id"), F.lit("wikipedia").alias("platform"), read_time(when).alias("ts"), F.coalesce(text, F.lit("")).alias("text"),
        F.lit(action).alias("action"), parent.alias("parent_msg_id"), F.lit(None).cast("string").alias("topic"), F.col("meta.toxicity").alias("toxicity"), F.col("meta.sever_toxicity").alias("severe_toxicity"),
        F.col("meta.indentation").try_cast("int").alias("indentation"),
    )
    out = base.where("who is not null").select(*columns(F.col("id"), F.col("who"), F.col("timestamp"), F.col("text"), "discuss", first_filled(F.col("reply-to"), F.col("reply_to"))))
    for field, action in (("modification", "edit"), ("deletion", "delete"), ("restoration", "restore")):
        each = base.select("id", "thread", "meta", F.posexplode(f"meta.{field}").alias("i", "e")).where("nullif(e.speaker, '') is not null")
        out = out.unionByName(each.select(*columns(F.concat_ws("::", "id", F.lit(field), "i"), F.col("e.speaker"), F.col("e.timestamp"), F.col("e.text"), action, F.col("id"))))
    return out


def flat_messages(spark: SparkSession, path: str) -> DataFrame:
    """Flat records of any of the known spellings, wrapped in ``_source`` or not."""
    fields = "thread_id string, conversation_id string, page_title string, comment_id string, id string, rev_id string, message_id string, user_id string, author string, speaker string, `user` string, text string, comment string, content string, body string, parent_comment_id string, parent_id string, reply_to string, timestamp string, created_at string, utc_timestamp string, action_type string"
    raw = _lines(spark, path, f"{fields}, _source struct<{', '.join(f.strip().replace(' ', ':', 1) for f in fields.split(','))}>")
    any_of = lambda *names: first_filled(*[c for n in names for c in (F.col(f"`{n}`"), F.col(f"_source.`{n}`"))])
    out = raw.select(
        any_of("comment_id", "id", "rev_id", "message_id").alias("msg_id"), any_of("thread_id", "conversation_id", "page_title").alias("thread_id"), any_of("user_id", "author", "speaker", "user").alias("user_id"),
        F.lit("wikipedia").alias("platform"), read_time(any_of("timestamp", "created_at", "utc_timestamp")).alias("ts"), F.coalesce(any_of("text", "comment", "content", "body"), F.lit("")).alias("text"),
        F.coalesce(F.lower(any_of("action_type")), F.when(any_of("rev_id").isNotNull(), F.lit("edit")), F.lit("discuss")).alias("action"),
        any_of("parent_comment_id", "parent_id", "reply_to").alias("parent_msg_id"), any_of("page_title").alias("topic"),
    )
    return out.where("msg_id is not null and thread_id is not null and user_id is not null")


def is_counter_argument(body: Column, top_level: Column) -> Column:
    """Two markers, or one at the top level; short texts never."""
    hits = sum((F.contains(F.lower(body), F.lit(m)).cast("int") for m in COUNTER_MARKERS), F.lit(0))
    return (F.length(body) >= 20) & ((hits >= 2) | (top_level & (hits >= 1)))


def reddit_submissions(spark: SparkSession, path: str) -> DataFrame:
    raw = _lines(spark, path, "submission_id string, id string, author string, title string, selftext string, body string, created_utc string")
    key = first_filled(F.col("submission_id"), F.col("id"))
    text = F.trim(F.concat_ws("\n\n", F.col("title"), first_filled(F.col("selftext"), F.col("body"))))
    return raw.where(key.isNotNull()).select(F.concat(key, F.lit("_0")).alias("msg_id"), key.alias("thread_id"), F.coalesce("author", F.lit("[deleted]")).alias("user_id"), F.lit("reddit").alias("platform"), read_time(F.col("created_utc")).alias("ts"), text.alias("text"), F.lit("post").alias("action"), F.lit(None).cast("string").alias("parent_msg_id"), F.col("title").alias("topic"))


def reddit_comments(spark: SparkSession, path: str) -> DataFrame:
    raw = _lines(spark, path, "submission_id string, link_id string, comment_id string, id string, author string, user_id string, body string, text string, parent_comment_id string, parent_id string, created_utc string, delta_awarded boolean, is_delta boolean, is_blocking boolean, blocked boolean, submission_title string")
    strip = lambda c: F.replace(F.replace(c, F.lit("t1_"), F.lit("")), F.lit("t3_"), F.lit(""))
    thread, parent = strip(first_filled(F.col("submission_id"), F.col("link_id"))), strip(first_filled(F.col("parent_comment_id"), F.col("parent_id")))
    body = F.coalesce(first_filled(F.col("body"), F.col("text")), F.lit(""))
    top = parent.isNull() | (parent == thread)
    action = F.when(F.coalesce("delta_awarded", "is_delta", F.lit(False)), "award_delta").when(F.coalesce("is_blocking", "blocked", F.lit(False)), "block").when(is_counter_argument(body, top), "counter_argue").otherwise("reply")
    return raw.select(strip(first_filled(F.col("comment_id"), F.col("id"))).alias("msg_id"), thread.alias("thread_id"), first_filled(F.col("author"), F.col("user_id")).alias("user_id"), F.lit("reddit").alias("platform"), read_time(F.col("created_utc")).alias("ts"), body.alias("text"), action.alias("action"), F.when(top, F.concat(thread, F.lit("_0"))).otherwise(parent).alias("parent_msg_id"), F.col("submission_title").alias("topic")).where("msg_id is not null and thread_id is not null and user_id is not null")


def github_events(spark: SparkSession, path: str) -> DataFrame:
    raw = _lines(spark, path, "repo string, issue_number string, event_type string, author string, `user` string, body string, created_at string, title string, labels array<string>, event_id string, id string, parent_comment_id string")
    thread = F.concat_ws("#", "repo", "issue_number")
    action = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in ISSUE_ACTIONS.items()], F.lit("comment"))
    key = F.coalesce(first_filled(F.col("event_id"), F.col("id")), F.substring(F.sha2(F.concat_ws("|", thread, "event_type", "created_at", "author"), 256), 1, 16))
    return raw.where("repo is not null and issue_number is not null").select(key.alias("msg_id"), thread.alias("thread_id"), first_filled(F.col("author"), F.col("user")).alias("user_id"), F.lit("github").alias("platform"), read_time(F.col("created_at")).alias("ts"), F.coalesce("body", F.lit("")).alias("text"), action.alias("action"), F.col("parent_comment_id").alias("parent_msg_id"), F.col("title").alias("topic")).where("user_id is not null")


def conversation_meta(spark: SparkSession, path: str) -> DataFrame:
    """The side file of one JSON object, conversation id -> metadata; one row each."""
    whole = spark.read.option("wholetext", True).text(path)
    kind = "map<string, struct<meta: struct<page_id:string, page_title:string, page_type:string, conversation_has_personal_attack:boolean>>>"
    return whole.select(F.explode(F.from_json("value", kind)).alias("thread_id", "c")).select("thread_id", "c.meta.*")


def year_folders(paths: list[str], years: set[int]) -> list[str]:
    """Folders whose name has an allowed year; an error if none has."""
    kept = sorted(p for p in paths if any(str(y) in p.rstrip("/").rsplit("/", 1)[-1] for y in years))
    if not kept:
        raise ValueError(f"no folder of the years {sorted(years)}")
    return kept


def write_leaf_profiles(profiles: DataFrame, path: str) -> None:
    """JSON lines, one folder a leaf."""
    profiles.write.mode("overwrite").partitionBy("leaf").json(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    results.write.mode("overwrite").parquet(f"{path}/parquet")
