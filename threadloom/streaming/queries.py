"""The streaming forms run to the end over the event table, as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.operators.registry import register
from threadloom.streaming import logs
from threadloom.workspace import shared_folder


def _drain(spark: SparkSession, sf_dir: str, form, mode: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    # a source is a folder; one file is picked out of its folder by name
    stream = read.option("pathGlobFilter", "*.parquet").parquet(path) if _is_folder(spark, path) else read.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    k = F.get_json_object("props", "$.k").cast("long")
    action = F.expr("CASE event_type WHEN 'view' THEN 'discuss' WHEN 'click' THEN 'edit' WHEN 'error' THEN 'revert' WHEN 'signup' THEN 'report' ELSE 'restore' END")
    messages = stream.select(F.col("event_id").alias("msg_id"), (k * 100 + F.dayofmonth("ts")).alias("thread_id"), "user_id", "ts", action.alias("action"))
    base = f"{shared_folder(spark)}/threadloom/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")  # idempotent: a replayed batch replaces itself

    query = form(messages).writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(where).isDirectory()


def _latest(frame: DataFrame, key: str) -> DataFrame:
    columns = [c for c in frame.columns if c not in ("batch", key)]
    return frame.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("s")).select(key, "s.*")


register("r01_streaming_counts", lambda s, d: _latest(_drain(s, d, logs.counts, "update"), "user_id"), "SELECT user_id, cast(count(*) as bigint) AS n FROM events GROUP BY user_id")
register("r02_conversation_state", lambda s, d: _latest(_drain(s, d, logs.conversations, "update"), "thread_id"),
         "SELECT cast(json_extract_string(props, '$.k') as bigint) * 100 + day(ts) AS thread_id, cast(count(*) as bigint) AS n, cast(count(DISTINCT user_id) as bigint) AS people FROM events GROUP BY 1")
def _whole(spark: SparkSession, sf_dir: str, form) -> DataFrame:
    """The result over all rows, whatever their order: complete mode without a bound on lateness, as of the last batch."""
    made = _drain(spark, sf_dir, lambda messages: form(messages, late=None), "complete")
    last = made.agg(F.max("batch")).first()[0]
    return made.where(F.col("batch") == last).drop("batch")


register("r08_streaming_rounds", lambda s, d: _whole(s, d, logs.round_metrics).selectExpr("window.start as start", "n", "round(conflict_ratio, 6) as conflict_ratio"),
         "SELECT cast(date_trunc('day', ts) as timestamp) AS start, cast(count(*) as bigint) AS n, round(avg(CASE WHEN event_type IN ('error', 'signup') THEN 1.0 ELSE 0.0 END), 6) AS conflict_ratio FROM events WHERE ts IS NOT NULL GROUP BY 1")
register("r10_streaming_sessions", lambda s, d: _whole(s, d, logs.sessions).selectExpr("user_id", "session_window.start as start", "n"),
         "WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE ts IS NOT NULL), g AS (SELECT user_id, ts, sum(CASE WHEN ts - before <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, cast(count(*) as bigint) AS n FROM g GROUP BY user_id, k")
