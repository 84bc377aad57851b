"""Operators that SQL can't say: sequential or random by nature, each a small numeric kernel.

The data are reduced on the cluster to what the kernel needs (a series of 30 bins, a matrix of
actions, a table of pairs), or the kernel runs within its group, group by group.
"""

from __future__ import annotations

import math
import re
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.operators.registry import register
from threadloom.operators.sqlop import BODIES, apply, canonical, twin
from threadloom.operators.vectors import DIST


#: The score by which e05 ranks, of every vector; own distance where no other leaf is.
BODIES["x17_scores"] = f"WITH {DIST} SELECT user_id, leaf, @r6(max(CASE WHEN leaf = to_leaf THEN d END) - coalesce(min(CASE WHEN leaf <> to_leaf THEN d END), 0.0)) AS score FROM dist GROUP BY user_id, leaf"


def dtw(a: list[float], b: list[float]) -> float:
    """Dynamic time warping with the symmetric pattern that counts a diagonal step twice."""
    cost = np.full((len(a) + 1, len(b) + 1), np.inf)
    cost[0, 0] = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d = abs(x - y)
            diagonal = 0 + d if (i, j) == (1, 1) else cost[i - 1, j - 1] + 2 * d
            cost[i, j] = min(diagonal, cost[i - 1, j] + d, cost[i, j - 1] + d)
    return float(cost[-1, -1])


def ks_pvalue(d: float, n: int, m: int) -> float:
    """Asymptotic two-sided p-value of the two-sample statistic."""
    z = d * math.sqrt(n * m / (n + m))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101)))) if z > 0 else 1.0


def wilcoxon_exact(ranks: list[float], w: float) -> float:
    """P(W+ >= w) over all signs; ranks may be halves."""
    doubled = [int(round(2 * r)) for r in ranks]
    ways = np.zeros(sum(doubled) + 1)
    ways[0] = 1
    for r in doubled:
        ways[r:] = ways[r:] + ways[: len(ways) - r] if r else ways * 2
    return float(ways[int(math.ceil(2 * w - 1e-9)) :].sum() / ways.sum())


def assignment(gain: np.ndarray) -> list[int]:
    """Column for each row with the greatest total gain (rows <= columns <= 15), by subsets."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in gain:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (total, path) in best.items():
            for j, g in enumerate(row):
                if not used >> j & 1:
                    new = (total + float(g), (*path, j))
                    if used | 1 << j not in step or new[0] > step[used | 1 << j][0] + 1e-12:
                        step[used | 1 << j] = new
        best = step
    return list(max(best.values())[1]) if len(gain) else []


def greedy_keep(vectors: np.ndarray, least: float = 0.9, most: int = 40) -> list[int]:
    """Places kept in the given order: none closer than ``least`` (cosine) to one kept before."""
    kept: list[int] = []
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    for i in range(len(unit)):
        if len(kept) < most and (not kept or float((unit[kept] @ unit[i]).max()) < least):
            kept.append(i)
    return kept


def find_json(text: str) -> str | None:
    """The first balanced object or array in noisy text, brackets in strings aside."""
    text = re.sub(r"<think>.*?</think>|```(?:json)?", "", text, flags=re.DOTALL)
    for start in (i for i, c in enumerate(text) if c in "{["):
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
                if not depth:
                    return re.sub(r",\s*([}\]])", r"\1", text[start : i + 1])
    return None


def _row(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in values.items()))


def _messages(spark, sf_dir):
    return canonical(spark, sf_dir, "messages")


def d05_dtw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of the two sides' conflict trajectories, each at most 30 bins."""
    m = _messages(spark, sf_dir)
    series = {s: [r.conflict for r in sorted(apply("d17_conflict_trajectory", messages=m.where(F.col("side") == s)).collect(), key=lambda r: r.bin)] for s in ("sim", "real")}
    return _row(spark, distance=dtw(series["sim"], series["real"]))


def d04_ks_pvalue(spark, sf_dir) -> DataFrame:
    m = _messages(spark, sf_dir)
    ks = apply("d04_ks_distance", messages=m).first().ks
    n = {r.side: r.n for r in m.groupBy("side").agg(F.count("*").alias("n")).collect()}
    return _row(spark, ks=ks, p_value=ks_pvalue(ks, n.get("sim", 0), n.get("real", 0)) if len(n) == 2 else 0.0)


def d07_rsa(spark, sf_dir) -> DataFrame:
    """Spectra of the sides' profile similarity, by way of the actions' p x p Gram matrix."""
    actions, spectra, rows = ("discuss", "edit", "report", "restore", "revert"), {}, {}
    for s in ("sim", "real"):
        p = apply("a07_action_profiles", messages=_messages(spark, sf_dir).where(F.col("side") == s))
        gram = p.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in actions for b in actions], F.count("*").alias("n")).first()
        rows[s] = gram["n"]
        values = np.linalg.eigvalsh(np.array([gram[f"{a}_{b}"] or 0.0 for a in actions for b in actions]).reshape(5, 5))
        spectra[s] = np.sort(np.pad(values, (0, 5)))[::-1]
    ok = min(rows.values()) >= 10
    return _row(spark, similarity=float(np.corrcoef(spectra["sim"], spectra["real"])[0, 1]) if ok else 0.0, available=int(ok))


def s01_wilcoxon_exact(spark, sf_dir) -> DataFrame:
    pairs = apply("w13_average_ranks", results=canonical(spark, sf_dir, "results")).collect()  # one row a pair of cells
    return _row(spark, n=len(pairs), p_value=wilcoxon_exact([r["rank"] for r in pairs], sum(r["rank"] for r in pairs if r.d > 0)))


def _bootstrap(spark, sf_dir, statistic, reps: int = 10_000) -> DataFrame:
    x = np.array([r.d for r in apply("w13_average_ranks", results=canonical(spark, sf_dir, "results")).orderBy("d").collect()])
    if not len(x):
        return _row(spark, value=0.0, low=0.0, high=0.0)
    picks = np.random.default_rng(42).integers(0, len(x), (reps, len(x)))
    low, high = np.percentile([statistic(x[p]) for p in picks], (2.5, 97.5))
    return _row(spark, value=float(statistic(x)), low=float(low), high=float(high))


def c03_quantile_normal(spark, sf_dir) -> DataFrame:
    """Each component to normal scores by its rank, clipped to +-5.2."""
    v = canonical(spark, sf_dir, "vectors")
    ranked = v.selectExpr("user_id", "dim", "percent_rank() over (partition by dim order by x) as q")

    @F.pandas_udf("double")
    def score(q: pd.Series) -> pd.Series:
        inverse = NormalDist().inv_cdf
        return q.clip(1e-7, 1 - 1e-7).map(inverse)

    return ranked.select("user_id", "dim", F.round(score("q"), 6).alias("x"))


def _dense(v: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    wide = v.groupBy("user_id", "leaf").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("s"))
    return wide.select("user_id", "leaf", array_to_vector(F.transform("s", lambda e: e["x"])).alias("features"))


def c04_kmeans(spark, sf_dir, k: int = 12) -> DataFrame:
    from pyspark.ml.clustering import KMeans

    rows = _dense(canonical(spark, sf_dir, "vectors"))
    fitted = KMeans(k=k, seed=42, maxIter=20).fit(rows)
    return fitted.transform(rows).select("user_id", F.col("prediction").alias("leaf"))


def e18_pca(spark, sf_dir, k: int = 5) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    rows = _dense(canonical(spark, sf_dir, "vectors"))
    return PCA(k=k, inputCol="features", outputCol="style").fit(rows).transform(rows).select("user_id", vector_to_array("style").alias("style"))


def j14_alignment(spark, sf_dir) -> DataFrame:
    """Fitted clusters to canonical ones, from the k x k contingency table."""
    fitted = c04_kmeans(spark, sf_dir, 10).withColumnRenamed("leaf", "fitted")
    table = fitted.join(canonical(spark, sf_dir, "vectors").select("user_id", "leaf").distinct(), "user_id").groupBy("fitted", "leaf").agg(F.count("*").alias("n")).collect()
    gain = np.zeros((10, 10))
    for r in table:
        gain[r.fitted, r.leaf % 10] = r.n
    return spark.createDataFrame(list(enumerate(assignment(gain))), "fitted long, leaf long")


def typical(candidates: DataFrame, least: float = 0.9, most: int = 40, most_chars: int = 12000) -> DataFrame:
    """(leaf, user_id) kept of candidates (leaf, user_id, score, x, n_chars), visited by score, then id.

    In each leaf all candidates are visited until ``most`` are kept, none nearer than ``least``
    to one kept before; of these, those before the first that exceeds ``most_chars`` in all.  A
    leaf is read as a stream: what is held of it is the vectors kept.
    """

    def keep(batches):
        leaf, kept, chars, started = None, [], 0, False
        for pdf in batches:
            rows = []
            for at, user, x, n in zip(pdf["leaf"], pdf["user_id"], pdf["x"], pdf["n_chars"], strict=True):
                at = None if pd.isna(at) else int(at)
                if not started or at != leaf:
                    leaf, kept, chars, started = at, [], 0, True
                if len(kept) >= most or chars > most_chars:
                    continue
                unit = np.asarray(x, float)
                unit = unit / max(float(np.linalg.norm(unit)), 1e-12)
                if kept and float((np.stack(kept) @ unit).max()) >= least:
                    continue
                kept.append(unit)
                chars += min(int(n), 1000)
                if chars <= most_chars:
                    rows.append((at, user))
            yield pd.DataFrame({"leaf": pd.array([r[0] for r in rows], "Int32"), "user_id": pd.array([r[1] for r in rows], "Int64")})

    ordered = candidates.select("leaf", "user_id", "score", "x", "n_chars").repartition("leaf").sortWithinPartitions("leaf", "score", "user_id")
    return ordered.select("leaf", "user_id", "x", "n_chars").mapInPandas(keep, "leaf int, user_id long")


def x17_greedy_dedup(spark, sf_dir) -> DataFrame:
    """In each leaf, the utterances kept in order of their contrastive score (the embeddings have no texts: no characters count)."""
    vectors = canonical(spark, sf_dir, "vectors")
    scores = apply("x17_scores", vectors=vectors)
    v = vectors.groupBy("leaf", "user_id").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("s"))
    v = v.select("leaf", "user_id", F.transform("s", lambda e: e["x"]).alias("x"), F.lit(0).alias("n_chars"))
    return typical(v.join(scores, "user_id").where(v["leaf"].eqNullSafe(scores["leaf"])).select(v["leaf"], "user_id", "score", "x", "n_chars"))


def chain_depth(messages: DataFrame) -> DataFrame:
    """(msg_id, depth) of every message: orphans start a chain, cycles end one; a thread at a time."""

    def depths(pdf: pd.DataFrame) -> pd.DataFrame:
        parent = {int(i): int(p) if pd.notna(p) else None for i, p in zip(pdf["msg_id"], pdf["parent_id"], strict=True)}
        known: dict[int, int] = {}
        for start in parent:
            path: dict[int, None] = {}
            at = start
            while at in parent and at not in known and at not in path:
                path[at] = None
                at = parent[at]
            base = known.get(at, 0)
            for k, node in enumerate(reversed(path), 1):
                known[node] = base + k
        return pd.DataFrame({"msg_id": pdf["msg_id"], "depth": [known[int(i)] for i in pdf["msg_id"]]})

    return messages.select("thread_id", "msg_id", "parent_id").groupBy("thread_id").applyInPandas(depths, "msg_id long, depth long")


_CHAIN = """WITH RECURSIVE chain AS (
  SELECT m.msg_id, m.thread_id, 1 AS depth FROM {messages} m WHERE NOT EXISTS (SELECT 1 FROM {messages} p WHERE p.thread_id = m.thread_id AND p.msg_id = m.parent_id)
  UNION ALL SELECT m.msg_id, m.thread_id, c.depth + 1 AS depth FROM {messages} m JOIN chain c ON m.thread_id = c.thread_id AND m.parent_id = c.msg_id)"""
register("g09_chain_depth", lambda s, d: chain_depth(_messages(s, d)), twin(f"{_CHAIN} SELECT msg_id, @n(depth) AS depth FROM chain"))
register("g11_depth_distribution", lambda s, d: chain_depth(_messages(s, d)).groupBy("depth").agg(F.count("*").alias("n")), twin(f"{_CHAIN} SELECT @n(depth) AS depth, @n(count(*)) AS n FROM chain GROUP BY 1"))


def d12_caricature_ci(spark, sf_dir, reps: int = 500) -> DataFrame:
    """Bootstrap of the caricature index, agents drawn within clusters."""
    messages = _messages(spark, sf_dir)
    rows = apply("a07_action_profiles", messages=messages).join(messages.groupBy("user_id").agg(F.min("community").alias("c")), "user_id").where("c >= 0").orderBy("user_id").toPandas()  # one row an agent of the simulation
    x, c = rows.drop(columns=["user_id", "c"]).to_numpy(float), rows["c"].to_numpy()
    groups = [x[c == k] for k in sorted(set(c)) if (c == k).sum() >= 2]

    def index(gs):
        d = []
        for i in range(len(gs)):
            for j in range(i):
                s = math.sqrt((gs[i].var(0, ddof=1).mean() + gs[j].var(0, ddof=1).mean()) / 2)
                if s > 1e-10:
                    d.append(np.linalg.norm(gs[i].mean(0) - gs[j].mean(0)) / s)
        return float(np.mean(d)) if d else 0.0

    rng = np.random.default_rng(42)
    draws = [index([g[rng.integers(0, len(g), len(g))] for g in groups]) for _ in range(reps)]
    low, high = np.percentile(draws, (2.5, 97.5))
    return _row(spark, caricature=index(groups), low=float(low), high=float(high))


def j13_greedy_matching(spark, sf_dir) -> DataFrame:
    """Each simulated round to the real round nearest in volume and conflict, without replacement."""
    both = {s: apply("m01_round_metrics", messages=_messages(spark, sf_dir).where(F.col("side") == s)).orderBy("round").collect() for s in ("sim", "real")}
    free, out = list(both["real"]), []
    for r in both["sim"]:
        if free:
            best = min(free, key=lambda x: (abs(x.message_count - r.message_count) + 100 * abs(x.conflict_ratio - r.conflict_ratio), x["round"]))  # noqa: B023
            free.remove(best)
            out.append((int(r["round"]), int(best["round"])))
    return spark.createDataFrame(out, "sim_round long, real_round long")


def json_spans(spark, sf_dir) -> DataFrame:
    @F.pandas_udf("string")
    def span(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: find_json(t or ""))

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    noisy = F.concat(F.lit("<think>{</think> ```json "), F.regexp_replace("props", "}$", ",}"), F.lit(" ``` done"))
    return e.select("event_id", span(noisy).alias("json")).withColumn("k", F.get_json_object("json", "$.k").cast("long"))


for _name, _query in {
    "d04_ks_pvalue": d04_ks_pvalue, "d05_dtw": d05_dtw, "d07_rsa": d07_rsa, "d12_caricature_ci": d12_caricature_ci, "s01_wilcoxon_exact": s01_wilcoxon_exact,
    "s02_bootstrap_mean": lambda s, d: _bootstrap(s, d, np.mean), "s18_ceiling_ci": lambda s, d: _bootstrap(s, d, np.max), "c03_quantile_normal": c03_quantile_normal, "c04_kmeans": c04_kmeans,
    "e18_pca": e18_pca, "j13_greedy_matching": j13_greedy_matching, "j14_alignment": j14_alignment, "x17_greedy_dedup": x17_greedy_dedup,
    "json_spans": json_spans,
}.items():
    register(_name, _query)
