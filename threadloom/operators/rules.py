"""Rules of agents: those that overlap an earlier one are dropped, in the order given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.operators.registry import register
from threadloom.operators.sqlop import canonical, twin
from threadloom.workspace import discard, materialize

#: Parts of a token's rows, so that one that a third of the rules share isn't one task's.
SALTS = 32


def drop_overlaps(rules: DataFrame) -> DataFrame:
    """``rules`` (scope, place, tokens) with ``kept``: a rule stays unless one that stays, earlier in its scope, has a token of it.

    Tokens are compared as they are; nulls match nothing, empty strings match each other.  Rules without tokens stay; of rules
    with an equal place the one whose tokens hash less comes first, and of equal rules one stays; rows without a scope share one.
    Each round keeps the rules that are the first undecided one at each of their tokens, and drops what shares a token with them:
    the same choice as one after the other, in as many rounds as the longest chain of decisions that wait for each other.
    """
    spark = rules.sparkSession
    tokens = F.array_sort(F.array_distinct(F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: t.isNotNull())))
    numbered = materialize(rules.withColumn("_tokens", tokens).withColumn("_row", F.struct("place", F.xxhash64("_tokens").alias("h"), F.monotonically_increasing_id().alias("i"))), "rules")
    each = numbered.select(F.struct("scope").alias("scope"), F.col("_row").alias("r"), F.size("_tokens").alias("n"), F.explode("_tokens").alias("token"), F.pmod(F.xxhash64("_row.i"), F.lit(SALTS)).cast("int").alias("salt"))
    left = materialize(each, "undecided")
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    at = ["scope", "token"]
    parts = []
    while left.limit(1).count():
        first = materialize(left.groupBy(*at).agg(F.min(F.struct("r", "n")).alias("f")).select(*at, "f.r", "f.n"), "first")
        new = materialize(first.groupBy("r", "n").agg(F.count("*").alias("led")).where("led = n").select("r"), "kept-rules")  # first at each of its tokens
        parts.append(new)
        covered = first.join(new.hint("merge"), "r", "left_semi").select(*at)
        # a row a salt is many times what Spark takes it for, so it must not be broadcast
        hit = left.join(covered.select(*at, salts).hint("merge"), [*at, "salt"], "left_semi").select("r").distinct()
        old, left = left, materialize(left.join(hit.hint("merge"), "r", "left_anti"), "undecided")
        discard(old)
        discard(first)
    stay = spark.createDataFrame([], numbered.select("_row").schema)
    for part in parts:
        stay = stay.union(part)
    won = stay.select(F.col("_row").alias("r"), F.lit(True).alias("_won"))
    out = numbered.join(won.hint("merge"), F.col("_row") == F.col("r"), "left")
    return out.select(*rules.columns, (F.coalesce("_won", F.lit(False)) | (F.size("_tokens") == 0)).alias("kept"))


# queries --------------------------------------------------------------------------------------------


def o06_rule_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as rules of their leaf in the order of their numbers, triggered by their words of 14 letters and more."""
    words = F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: F.length(w) >= 14)
    rules = canonical(spark, sf_dir, "texts").where("leaf is not null").select(F.col("leaf").alias("scope"), F.col("msg_id").alias("place"), words.alias("tokens"))
    return drop_overlaps(rules).select(F.col("scope").alias("leaf"), F.col("place").alias("msg_id"), "kept")


_O06 = """WITH RECURSIVE r AS (SELECT leaf, msg_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{14,}')) AS t, row_number() OVER (PARTITION BY leaf ORDER BY msg_id) AS k FROM {texts} WHERE leaf IS NOT NULL),
s AS (SELECT leaf, msg_id, k, true AS kept, t AS seen FROM r WHERE k = 1 UNION ALL
  SELECT r.leaf, r.msg_id, r.k, NOT list_has_any(s.seen, r.t), CASE WHEN list_has_any(s.seen, r.t) THEN s.seen ELSE list_concat(s.seen, r.t) END FROM s JOIN r ON r.leaf = s.leaf AND r.k = s.k + 1)
SELECT leaf, msg_id, kept FROM s"""

register("o06_rule_overlap", o06_rule_overlap, twin(_O06))
