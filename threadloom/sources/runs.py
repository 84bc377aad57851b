"""Folders of runs: markers and results written whole or not at all, and which runs count as completed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MARKER = "_COMPLETE.json"


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """``value`` as JSON at ``path``: written beside it, then renamed over what is there, so a reader sees the old text or the new one."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    out = target.getFileSystem(conf).create(beside, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
    finally:
        out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(beside, target, options)


def mark_completed(spark: SparkSession, markers: str, run_id: str, result_path: str, fingerprint: str) -> None:
    write_json(spark, f"{markers}/{run_id}{MARKER}", {"run_id": run_id, "result_path": result_path, "run_fingerprint": fingerprint})


def _whole(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, v (the JSON value; null if broken) of each file below ``path``, those still being written aside."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    where = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))  # the path is a URI
    return files.select(_plain(where).alias("path"), F.try_parse_json("value").alias("v"))


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def completed_runs(spark: SparkSession, markers: str, results: str) -> DataFrame:
    """run_id, completed, reason (the first check that fails; null if none) of each marker below ``markers``.

    A run is complete if its marker names a result file below ``results`` that is a JSON object with members, passed the integrity
    check (true itself), has messages, as many rounds as expected and more than none, and the marker's fingerprint.
    Broken files and values of another kind fail the check they are met at; runs without a marker have no row.
    """
    marked = _whole(spark, markers, f"*{MARKER}").select(F.regexp_extract("path", rf"([^/]+){MARKER}$", 1).alias("run_id"), F.col("v").alias("m"))
    text = lambda v, k: F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))
    number = lambda k: F.coalesce(F.try_variant_get("r", f"$.{k}", "long"), F.lit(0))
    made = _whole(spark, results, "*.json").select("path", F.col("v").alias("r"), F.lit(True).alias("there"))
    both = marked.withColumn("at", _plain(text("m", "result_path"))).join(made, F.col("at") == F.col("path"), "left")
    kind = F.coalesce(F.schema_of_variant("r"), F.lit(""))
    passed = F.coalesce((F.schema_of_variant(F.variant_get("r", "$.simulation_integrity_passed", "variant")) == "BOOLEAN") & F.try_variant_get("r", "$.simulation_integrity_passed", "boolean"), F.lit(False))
    rounds, expected = number("simulation_round_count"), number("simulation_expected_round_count")
    checks = [
        ("marker is broken", F.col("m").isNull()), ("marker names no result", F.col("at").isNull()), ("result is missing", F.col("there").isNull()), ("result is broken", ~F.startswith(kind, F.lit("OBJECT")) | (kind == "OBJECT<>")),
        ("integrity is not confirmed", ~passed), ("no messages", number("simulation_message_count") <= 0), ("rounds differ", (rounds <= 0) | (rounds != expected)),
        ("fingerprints differ", ~F.coalesce(text("m", "run_fingerprint") == text("r", "run_fingerprint"), F.lit(False))),
    ]
    reason = F.coalesce(*[F.when(failed, F.lit(name)) for name, failed in checks])
    return both.select("run_id", reason.isNull().alias("completed"), reason.alias("reason"))
