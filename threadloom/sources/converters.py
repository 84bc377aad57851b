"""Raw corpora into the flat records that the readers of ``corpora`` take: discovery of folders, and a converter for each platform.

Utterances are rows id, conversation_id, speaker, text, timestamp (as given), reply_to and meta (JSON text);
conversations are rows conversation_id and meta.  A thread's opening is its utterance without ``reply_to``; of several
the one with the conversation's id, then the earliest by time, then id (without a time: last).  Times that can't be read are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadloom.operators.registry import register
from threadloom.operators.sqlop import canonical, twin
from threadloom.sources.corpora import _lines, first_filled, read_time

#: Keys of a post's metadata that tell whether it won a delta, texts that mean yes, and markers of bodies.
DELTA_KEYS = ("success", "delta_awarded", "delta_label", "is_delta", "delta")
DELTA_TEXTS = ("true", "1", "yes", "delta")
DELTA_STARTS, DELTA_PARTS = ("δ", "!delta"), ("delta awarded", "awarded a delta")
#: Events of an issue that are kept -> their type.
ISSUE_EVENTS = {"labeled": "labeled", "closed": "issue_closed", "reopened": "issue_reopened"}
#: Characters of an opening that stand in for a title.
STUB = 120


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path of each folder below ``root`` that holds index.json and utterances.jsonl, sorted; side corpora of labels are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{index.json,utterances.jsonl}").load(root).select("path")  # contents aren't read
    folder = files.select(F.regexp_extract("path", r"^(.*)/([^/]+)$", 1).alias("path"), F.regexp_extract("path", r"^(.*)/([^/]+)$", 2).alias("file"))
    both = folder.groupBy("path").agg(F.count_distinct("file").alias("n")).where("n = 2")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return both.where(~F.contains(name, F.lit("awry")) & (name != "cga")).select("path").orderBy("path")


def utterances(spark: SparkSession, path: str) -> DataFrame:
    """Utterances of a corpus file, whatever it names the conversation and the parent."""
    raw = _lines(spark, path, "id string, conversation_id string, root string, speaker string, `user` string, text string, timestamp string, `reply-to` string, reply_to string, meta string")
    who = F.coalesce("speaker", "user")
    return raw.select("id", first_filled(F.col("conversation_id"), F.col("root"), F.col("id")).alias("conversation_id"), F.coalesce(F.get_json_object(who, "$.id"), who).alias("speaker"), "text", "timestamp", first_filled(F.col("reply-to"), F.col("reply_to")).alias("reply_to"), "meta")


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """The side file of one JSON object, conversation id -> {meta: ...}."""
    whole = spark.read.option("wholetext", True).text(path)
    each = whole.select(F.explode(F.from_json("value", "map<string, string>")).alias("conversation_id", "c"))
    return each.select("conversation_id", F.get_json_object("c", "$.meta").alias("meta"))


def _openings(said: DataFrame) -> DataFrame:
    """conversation_id, o (id, speaker, text, timestamp of its opening), first_time: a row a thread."""
    time = read_time(F.col("timestamp"))
    order = F.when(F.col("reply_to").isNull(), F.struct((~F.col("id").eqNullSafe(F.col("conversation_id"))).alias("a"), time.isNull().alias("b"), time.alias("c"), F.col("id").alias("d")))
    earliest = F.min(F.when(time.isNotNull(), F.struct(time.alias("t"), F.col("timestamp").alias("v"))))
    return said.groupBy("conversation_id").agg(F.min_by(F.struct("id", "speaker", "text", "timestamp"), order).alias("o"), earliest["t"].alias("first_time"))


def _stub(text: Column) -> Column:
    """A text's beginning as a title; null if nothing is left."""
    clean = F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" "))
    return F.nullif(F.substring(clean, 1, STUB), F.lit(""))


def _titled(said: DataFrame, about: DataFrame | None) -> DataFrame:
    threads = _openings(said)
    if about is None:
        return threads.withColumn("meta", F.lit(None).cast("string"))
    return threads.join(about.groupBy("conversation_id").agg(F.max("meta").alias("meta")), "conversation_id", "left")


def wiki_records(said: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """Flat records of talk pages: a thread's title is its metadata's, else its opening's first 120 characters, else its id.

    Utterances without a speaker go; a null conversation is a thread of its own with a null id and title.
    """
    threads = _titled(said, about)
    given = first_filled(*[F.get_json_object("meta", f"$.{k}") for k in ("page_title", "title", "pageTitle")])
    titles = threads.select(F.col("conversation_id").alias("thread"), F.coalesce(given, _stub(F.col("o.text")), "conversation_id").alias("page_title"))
    met = said.where("nullif(speaker, '') is not null").join(titles, F.col("conversation_id").eqNullSafe(F.col("thread")))
    return met.select(
        F.col("conversation_id").alias("thread_id"), "page_title", F.col("id").alias("comment_id"), F.col("speaker").alias("user_id"), F.col("speaker").alias("author"),
        F.coalesce("text", F.lit("")).alias("text"), F.date_format(read_time(F.col("timestamp")), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.nullif(F.col("reply_to"), F.lit("")).alias("parent_comment_id"),
    )


def won_delta(meta: Column, text: Column) -> Column:
    """Whether a post won a delta: by the first key its metadata has (a flag, the number 1, a text that says so), else by its body."""
    values = [F.try_variant_get(F.try_parse_json(meta), f"$.{k}", "variant") for k in DELTA_KEYS]
    value = F.coalesce(*[F.when(F.coalesce(F.schema_of_variant(v), F.lit("VOID")) != "VOID", F.to_json(v)) for v in values])
    body = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    said = F.lit(False)
    for start in DELTA_STARTS:
        said = said | F.startswith(body, F.lit(start))
    for part in DELTA_PARTS:
        said = said | F.contains(body, F.lit(part))
    quoted = F.trim(F.lower(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")))
    return (
        F.when(value.isNull() | value.rlike(r"^[\[{]"), said).when(value.startswith('"'), quoted.isin(*DELTA_TEXTS)).when(value.isin("true", "false"), value == "true").otherwise(F.coalesce(value.try_cast("double") == 1, F.lit(False)))
    )


def reddit_records(said: DataFrame, about: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Submissions and comments: a thread's opening is its submission, all else are comments whose parent is t3_<thread> at the top level.

    A submission without a title takes its text's first 120 characters, else its id, and without a time the thread's
    earliest; without an opening its text and author are the metadata's.  A null speaker is "[deleted]"; comments with an empty one go.
    """
    bare = F.replace(F.col("conversation_id"), F.lit("t3_"), F.lit(""))
    meta = lambda *keys: F.coalesce(*[F.get_json_object("meta", f"$.{k}") for k in keys])
    opened = F.col("o.id").isNotNull()
    selftext = F.when(opened, F.coalesce("o.text", F.lit(""))).otherwise(F.coalesce(meta("selftext", "body"), F.lit("")))
    author = F.when(opened, F.coalesce(F.nullif(F.col("o.speaker"), F.lit("")), F.lit("[deleted]"))).otherwise(F.coalesce(meta("author", "op"), F.lit("[deleted]")))
    title = F.nullif(F.nullif(meta("title", "submission_title"), F.lit("")), bare)
    time = F.coalesce(read_time(F.col("o.timestamp")), "first_time")
    threads = _titled(said, about).where("conversation_id is not null")
    posts = threads.select(bare.alias("submission_id"), F.col("conversation_id").alias("id"), author.alias("author"), F.coalesce(title, _stub(selftext), bare).alias("title"), selftext.alias("selftext"), F.unix_seconds(time).alias("created_utc"), F.col("o.id").alias("opening"))
    met = said.join(posts.select(F.col("id").alias("conversation_id"), "submission_id", "title", "opening"), "conversation_id").where("opening is null or id != opening").where("speaker is null or speaker != ''")
    top = F.coalesce(F.nullif(F.col("reply_to"), F.lit("")).isNull() | F.col("reply_to").isin(F.col("conversation_id"), F.col("submission_id")) | (F.col("reply_to") == F.coalesce("opening", "conversation_id")), F.lit(False))
    comments = met.select(
        "submission_id", F.col("id").alias("comment_id"), F.coalesce("speaker", F.lit("[deleted]")).alias("author"), F.coalesce("text", F.lit("")).alias("body"), F.when(top, F.concat(F.lit("t3_"), "submission_id")).otherwise(F.col("reply_to")).alias("parent_comment_id"),
        F.unix_seconds(read_time(F.col("timestamp"))).alias("created_utc"), won_delta(F.col("meta"), F.col("text")).alias("delta_awarded"), F.col("title").alias("submission_title"),
    )
    return posts.drop("opening"), comments


def github_pages(spark: SparkSession, issues: str, comments: str, events: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saved answers of an issue tracker, an object a line, with the columns of ``github_records``."""
    who = "struct<login:string>"
    opened = _lines(spark, issues, f"repo string, number long, title string, body string, `user` {who}, created_at string, labels array<struct<name:string>>, pull_request string")
    said = _lines(spark, comments, f"repo string, id string, issue_url string, body string, `user` {who}, created_at string")
    done = _lines(spark, events, f"repo string, id string, event string, actor {who}, created_at string, label struct<name:string>, issue struct<number:long>")
    number = F.regexp_extract("issue_url", r"(\d+)$", 1).try_cast("long")
    return opened, said.withColumn("number", number), done.withColumn("number", F.col("issue.number"))


def github_records(issues: DataFrame, comments: DataFrame, events: DataFrame) -> DataFrame:
    """Event records: the opening of each issue (pull requests aren't issues), its comments, and labels, closings and reopenings."""
    real = issues.where("pull_request is null and number is not null")
    title = F.coalesce("title", F.concat_ws("#", "repo", F.col("number").cast("string")))
    names = F.filter(F.coalesce("labels.name", F.array().cast("array<string>")), lambda n: F.coalesce(n != "", F.lit(False)))
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c.split(".")[0] if "." not in c else "author")
    none = F.array().cast("array<string>").alias("labels")
    opened = real.select("repo", F.col("number").alias("issue_number"), F.lit("issue_opened").alias("event_type"), text("user.login"), text("body"), text("created_at"), title.alias("title"), names.alias("labels"), F.concat_ws("", "repo", F.lit("#"), "number", F.lit("_opened")).alias("event_id"))
    known = real.groupBy("repo", "number").agg(F.min(title).alias("title"))
    said = comments.join(known, ["repo", "number"]).select("repo", F.col("number").alias("issue_number"), F.lit("comment").alias("event_type"), text("user.login"), text("body"), text("created_at"), "title", none, F.col("id").alias("event_id"))
    kind = F.coalesce(*[F.when(F.col("event") == k, v) for k, v in ISSUE_EVENTS.items()])
    label = F.when((F.col("event") == "labeled") & (F.coalesce("label.name", F.lit("")) != ""), F.array("label.name")).otherwise(F.array().cast("array<string>"))
    done = events.withColumn("kind", kind).where("kind is not null").join(known, ["repo", "number"])
    changed = done.select("repo", F.col("number").alias("issue_number"), F.col("kind").alias("event_type"), text("actor.login"), F.lit("").alias("body"), text("created_at"), "title", label.alias("labels"), F.col("id").alias("event_id"))
    return opened.unionByName(said).unionByName(changed)


# queries --------------------------------------------------------------------------------------------


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as utterances: threads are t3_<number>, turns are a second apart, every fifth has metadata."""
    columns = ("cast(msg_id as string) as id", "concat('t3_', cast(thread_id as string)) as conversation_id", "cast(user_id as string) as speaker", "text", "cast(1000000000 + msg_id as string) as timestamp", "cast(parent_id as string) as reply_to")
    return canonical(spark, sf_dir, "turns").selectExpr(*columns, "case when msg_id % 5 = 0 then concat('{\"success\": ', cast(seq % 2 as string), '}') end as meta")


_SAID = """u AS (SELECT msg_id, msg_id::VARCHAR AS id, thread_id, user_id::VARCHAR AS speaker, text, 1000000000 + msg_id AS t, parent_id, seq FROM {turns}),
o AS (SELECT thread_id, arg_min(text, t) FILTER (parent_id IS NULL) AS text, arg_min(speaker, t) FILTER (parent_id IS NULL) AS speaker, arg_min(msg_id, t) FILTER (parent_id IS NULL) AS opening, min(t) AS first_t FROM u GROUP BY thread_id),
h AS (SELECT *, coalesce(nullif(substr(replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' '), 1, 120), ''), CASE WHEN wiki THEN 't3_' ELSE '' END || thread_id) AS title FROM o CROSS JOIN (SELECT unnest([true, false]) AS wiki) w)"""
_L16 = f"""WITH {_SAID} SELECT 't3_' || u.thread_id AS thread_id, h.title AS page_title, u.id AS comment_id, u.speaker AS user_id, u.speaker AS author, u.text, strftime(make_timestamp(u.t * 1000000), '%Y-%m-%dT%H:%M:%S') AS timestamp, u.parent_id::VARCHAR AS parent_comment_id
FROM u JOIN h ON h.thread_id = u.thread_id AND h.wiki"""
_L17S = f"WITH {_SAID} SELECT thread_id::VARCHAR AS submission_id, 't3_' || thread_id AS id, speaker AS author, title, text AS selftext, coalesce(1000000000 + opening, first_t) AS created_utc FROM h WHERE NOT wiki"
_L17C = f"""WITH {_SAID} SELECT u.thread_id::VARCHAR AS submission_id, u.id AS comment_id, u.speaker AS author, u.text AS body, CASE WHEN u.parent_id IS NULL OR u.parent_id = h.opening THEN 't3_' || u.thread_id ELSE u.parent_id::VARCHAR END AS parent_comment_id, u.t AS created_utc,
  CASE WHEN u.msg_id % 5 = 0 THEN u.seq % 2 = 1 ELSE regexp_matches(lower(trim(u.text)), '^(δ|!delta)|delta awarded|awarded a delta') END AS delta_awarded, h.title AS submission_title FROM u JOIN h ON h.thread_id = u.thread_id AND NOT h.wiki WHERE u.msg_id <> h.opening"""

register("l16_wiki_records", lambda s, d: wiki_records(_said(s, d)), twin(_L16))
register("l17_reddit_submissions", lambda s, d: reddit_records(_said(s, d))[0], twin(_L17S))
register("l17_reddit_comments", lambda s, d: reddit_records(_said(s, d))[1], twin(_L17C))
