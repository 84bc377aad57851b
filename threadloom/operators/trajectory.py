"""Drift of a population over rounds: rolling states of agents, snapshots at checkpoints, verdicts on their trends.

An action is a row run, user_id, round, seq, action and x, its vector (null if its text has none).  States are taken from all
actions up to a checkpoint.  No task sees all of a user's actions or all states of a checkpoint: users are cut into blocks
with a margin, states are met in blocks, and what a task returns are sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from threadloom.operators.clusters import dense_index, distances, kmeans
from threadloom.operators.dialect import expand
from threadloom.operators.registry import register
from threadloom.operators.sqlop import canonical, twin
from threadloom.workspace import materialize, small_batches

#: Rounds at which snapshots are taken.
POINTS = (1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50)
#: States of a checkpoint that centres are fitted on, states that silhouettes are taken of, and states of a block: bounds of a task.
FIT, SAMPLE, BLOCK = 4096, 2048, 2048


def rounded(c: str) -> Column:
    return F.expr(expand(f"@r6({c})", spark=True))


# W03 ------------------------------------------------------------------------------------------------


def rolling_states(actions: DataFrame, window: int = 5, block: int = 1024) -> DataFrame:
    """``actions`` that have a vector, with ``state``: the mean of the user's last ``window`` vectors, this one included.

    Order is by round, then seq.  A user's actions are numbered by sorted ranges and cut into blocks, each with the
    last ``window`` - 1 rows of the one before, so a user who holds a third of all rows is many small groups.
    """
    placed = dense_index(actions.where("x is not null"), ["run", "user_id"], ["round", "seq"])
    own = F.floor(F.col("pos") / block)
    parts = F.when(F.col("pos") % block >= block - (window - 1), F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.withColumn("_block", F.explode(parts)).withColumn("_own", F.col("_block") == own)
    last = Window.partitionBy("run", "user_id", "_block").orderBy("pos").rowsBetween(1 - window, 0)
    held = spread.withColumn("_xs", F.collect_list("x").over(last)).where("_own")
    mean = F.expr("transform(x, (v, d) -> aggregate(_xs, 0D, (s, y) -> s + y[d]) / size(_xs))")
    return held.withColumn("state", mean).select(*actions.columns, "state")


# R12 ------------------------------------------------------------------------------------------------


def checkpoint_of(round_: Column, points: tuple[int, ...]) -> Column:
    """The first checkpoint that an action of ``round_`` counts for; null beyond the last."""
    return F.coalesce(*[F.when(round_ <= p, F.lit(p)) for p in sorted(points)])


def snapshots(actions: DataFrame, points: tuple[int, ...] = POINTS, window: int = 5) -> DataFrame:
    """run, point, user_id, x: each agent's state at each checkpoint that its run reached in a round of that number.

    An agent without actions since the last checkpoint keeps its state; one without a vector so far has no row.
    """
    reached = actions.where(F.col("round").isin(*points)).select("run", F.col("round").cast("int").alias("point")).distinct()
    states = rolling_states(actions, window).withColumn("point", checkpoint_of(F.col("round"), points)).where("point is not null")
    last = states.groupBy("run", "user_id", "point").agg(F.max_by("state", F.struct("round", "seq")).alias("x"))
    until = F.coalesce(F.lead("point").over(Window.partitionBy("run", "user_id").orderBy("point")), F.lit(max(points) + 1))  # a row a checkpoint
    held = last.withColumn("until", until).withColumn("point", F.explode(F.filter(F.lit(sorted(points)), lambda p: (p >= F.col("point")) & (p < F.col("until")))))
    return held.join(reached, ["run", "point"], "left_semi").select("run", "point", "user_id", "x")


def entropies(actions: DataFrame, points: tuple[int, ...] = POINTS) -> DataFrame:
    """run, point, entropy in bits of the actions of all agents up to the checkpoint."""
    counts = actions.withColumn("from", checkpoint_of(F.col("round"), points)).where("from is not null").groupBy("run", "from", "action").agg(F.count("*").alias("n"))
    total = counts.withColumn("point", F.explode(F.filter(F.lit(sorted(points)), lambda p: p >= F.col("from")))).groupBy("run", "point", "action").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("run", "point"))  # a row an action
    return total.withColumn("p", share).groupBy("run", "point").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


# M06 ------------------------------------------------------------------------------------------------

_KEYS = "run string, point int"


def _matrix(xs) -> np.ndarray:
    return np.array([np.asarray(x, float) for x in xs])


def _blocks(states: DataFrame) -> DataFrame:
    """States in blocks of ``BLOCK`` (expected) with a hash each: run, point, n, users, hs, xs."""
    sizes = states.groupBy("run", "point").agg(F.count("*").alias("n"))
    h = F.conv(F.substring(F.md5(F.col("user_id").cast("string")), 1, 8), 16, 10).cast("double") / 2**32
    dealt = states.join(sizes, ["run", "point"]).withColumn("h", h).withColumn("block", F.pmod(F.xxhash64("user_id"), F.ceil(F.col("n") / BLOCK)))
    rows = dealt.groupBy("run", "point", "n", "block").agg(F.sort_array(F.collect_list(F.struct("h", "user_id", "x"))).alias("s"))
    return materialize(rows.select("run", "point", "n", F.col("s.user_id").alias("users"), F.col("s.h").alias("hs"), F.col("s.x").alias("xs")), "states")


def _centres(blocks: DataFrame, k: int, seed: int) -> DataFrame:
    """Centres of each checkpoint, fitted on ``FIT`` states at most, the least by hash."""
    chosen = F.expr(f"filter(arrays_zip(hs, xs), s -> n <= {FIT} or s.hs < {2.0 * FIT} / n)")
    drawn = blocks.select("run", "point", F.explode(chosen).alias("s")).select("run", "point", "s.hs", "s.xs")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(rows.sort_values("hs", kind="stable")["xs"][:FIT])
        count = min(k, len(x))
        centre = kmeans(x, count, seed, 10)[0] if count > 1 else x.mean(0, keepdims=True)
        return pd.DataFrame({"run": [rows["run"].iloc[0]], "point": [rows["point"].iloc[0]], "centres": [[c.tolist() for c in centre]]})

    return materialize(drawn.groupBy("run", "point").applyInPandas(fit, f"{_KEYS}, centres array<array<double>>"), "centres")


def _each(blocks: DataFrame, row, schema: str) -> DataFrame:
    """Rows that ``row`` yields for each block, with the block's keys."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            made = [(r.run, r.point, *out) for r in batch.itertuples() for out in row(r)]
            if made:
                yield pd.DataFrame(made, columns=["run", "point", *names])

    return blocks.mapInPandas(run, f"{_KEYS}, {schema}")


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Element-wise sums of the array s, and sums of n, for each checkpoint and ``keys``."""
    flat = rows.select("run", "point", *keys, F.posexplode("s").alias("d", "v")).groupBy("run", "point", *keys, "d").agg(F.sum("v").alias("v"))
    sums = flat.groupBy("run", "point", *keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda e: e["v"]).alias("s"))
    return sums.join(rows.groupBy("run", "point", *keys).agg(F.sum("n").alias("n")), ["run", "point", *keys])


def snapshot_measures(states: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """run, point, n_agents, silhouette, davies_bouldin, mean_cosine, cosine_halfwidth of states re-clustered with ``k`` at each checkpoint.

    Cosines and Davies-Bouldin are of all states, as sums and a d x d table of products (the squares' sum is its square
    norm); silhouettes are means over ``SAMPLE`` states drawn by hash (all, where there are no more), each against all.
    Under two agents, or clusters, they are 0.
    """
    small_batches(states.sparkSession)  # a row holds one block or two
    blocks = _blocks(states)
    near = lambda x, c: distances(x, np.array([np.asarray(v) for v in c])).argmin(1)
    labelled = _each(blocks.join(_centres(blocks, k, seed), ["run", "point"]), lambda r: [(r.n, r.hs, r.xs, near(_matrix(r.xs), r.centres).tolist())], "n long, hs array<double>, xs array<array<double>>, labels array<int>")
    labelled = materialize(labelled, "labelled")

    def gram(r):
        x = _matrix(r.xs)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        u = x / np.where(norm == 0, 1.0, norm)
        yield "cosine", [*u.sum(0).tolist(), *(u.T @ u).ravel().tolist(), float((u * u).sum()), float(((u * u).sum(1) ** 2).sum())], len(x)

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples():
            s, n = np.asarray(r.s), int(r.n)
            d = int((np.sqrt(4 * len(s) - 7) - 1) / 2)  # d + d * d + 2 numbers
            count = n * (n - 1) / 2
            total, squares = ((s[:d] ** 2).sum() - s[-2]) / 2, ((s[d:-2] ** 2).sum() - s[-1]) / 2
            mean = total / count if count else 0.0
            sd = np.sqrt(max(squares - count * mean * mean, 0.0) / (count - 1)) if count > 1 else 0.0
            out.append((r.run, r.point, n, mean, 1.96 * sd / np.sqrt(count) if count > 1 else 0.0))
        return pd.DataFrame(out, columns=["run", "point", "n_agents", "mean_cosine", "cosine_halfwidth"])

    cosine = _summed(_each(labelled, gram, "kind string, s array<double>, n long"), "kind").mapInPandas(lambda it: (pairs(b) for b in it), f"{_KEYS}, n_agents long, mean_cosine double, cosine_halfwidth double")

    def sums(r):
        x, label = _matrix(r.xs), np.asarray(r.labels)
        for c in np.unique(label).tolist():
            yield c, x[label == c].sum(0).tolist(), int((label == c).sum())

    means = _summed(_each(labelled, sums, "label int, s array<double>, n long"), "label").select("run", "point", "label", F.transform("s", lambda v: v / F.col("n")).alias("mean"), F.col("n").alias("size"))
    tables = materialize(means.groupBy("run", "point").agg(F.array_sort(F.collect_list(F.struct("label", "mean", "size"))).alias("c")).select("run", "point", F.col("c.label").alias("names"), F.col("c.mean").alias("means"), F.col("c.size").alias("sizes")), "means")  # k rows a checkpoint

    def spread(r):
        x, label = _matrix(r.xs), np.asarray(r.labels)
        for c, m in zip(r.names, r.means, strict=True):
            mine = x[label == c]
            yield int(c), [float(np.linalg.norm(mine - np.asarray(m), axis=1).sum())], len(mine)

    scatter = _summed(_each(labelled.join(tables, ["run", "point"]), spread, "label int, s array<double>, n long"), "label")
    scatter = scatter.groupBy("run", "point").agg(F.array_sort(F.collect_list(F.struct("label", (F.col("s")[0] / F.col("n")).alias("v")))).alias("c")).select("run", "point", F.col("c.v").alias("scatter"))

    def bouldin(r):
        m, s = _matrix(r.means), np.asarray(r.scatter)
        between = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
        ratio = np.divide(s[:, None] + s[None], between, out=np.zeros_like(between), where=between > 0)
        np.fill_diagonal(ratio, 0.0)
        yield (float(ratio.max(1).mean()) if len(m) > 1 else 0.0,)

    index = _each(tables.join(scatter, ["run", "point"]), bouldin, "davies_bouldin double")
    picked = F.expr(f"filter(arrays_zip(hs, xs, labels), s -> n <= {SAMPLE} or s.hs < {float(SAMPLE)} / n)")
    drawn = labelled.select("run", "point", picked.alias("s")).select("run", "point", F.col("s.hs").alias("ph"), F.col("s.xs").alias("px"), F.col("s.labels").alias("pl"))

    def away(r):
        if len(r.px):
            p, x, own, label = _matrix(r.px), _matrix(r.xs), np.asarray(r.pl), np.asarray(r.labels)
            d = distances(p, x)
            for c in np.unique(label).tolist():
                for h, mine, total in zip(r.ph, own.tolist(), d[:, label == c].sum(1).tolist(), strict=True):
                    yield float(h), int(mine), int(c), [total], int((label == c).sum())

    met = _each(drawn.join(labelled, ["run", "point"]), away, "h double, own int, label int, s array<double>, n long")
    met = met.groupBy("run", "point", "h", "own", "label").agg(F.sum(F.col("s")[0]).alias("s"), F.sum("n").alias("n"))
    mine = F.col("own") == F.col("label")
    sides = met.groupBy("run", "point", "h").agg(F.max(F.when(mine, F.col("n"))).alias("n"), F.max(F.when(mine, F.col("s"))).alias("a"), F.min(F.when(~mine, F.col("s") / F.col("n"))).alias("b")).withColumn("a", F.col("a") / F.greatest(F.col("n") - 1, F.lit(1)))
    value = F.when((F.col("n") > 1) & F.col("b").isNotNull() & (F.greatest("a", "b") > 0), (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    silhouette = sides.groupBy("run", "point").agg(F.avg(value).alias("silhouette"))
    return cosine.join(index, ["run", "point"]).join(silhouette, ["run", "point"])


def trajectory(actions: DataFrame, points: tuple[int, ...] = POINTS, window: int = 5, k: int = 5, seed: int = 42) -> DataFrame:
    """``snapshot_measures`` and the entropy of actions for each checkpoint that a run reached; all 0 where under two agents have a state."""
    actions = actions.withColumn("run", F.col("run").cast("string"))
    reached = actions.where(F.col("round").isin(*points)).select("run", F.col("round").cast("int").alias("point")).distinct()
    whole = reached.join(snapshot_measures(snapshots(actions, points, window), k, seed), ["run", "point"], "left").join(entropies(actions, points), ["run", "point"], "left")
    enough = F.coalesce(F.col("n_agents"), F.lit(0)) >= 2
    measures = [F.when(enough, F.col(c)).otherwise(0.0).alias(c) for c in ("silhouette", "davies_bouldin", "entropy", "mean_cosine", "cosine_halfwidth")]
    return whole.select("run", "point", F.coalesce("n_agents", F.lit(0)).alias("n_agents"), *measures)


# Z14, S20 -------------------------------------------------------------------------------------------


def drifts(measured: DataFrame) -> DataFrame:
    """run with slopes of silhouette, entropy and cosine by the checkpoint's place, and their changes from the first to the last."""
    placed = measured.withColumn("t", (F.row_number().over(Window.partitionBy("run").orderBy("point")) - 1).cast("double"))  # a row a checkpoint
    slope = lambda c: F.coalesce(F.covar_pop("t", c) / F.nullif(F.var_pop("t"), F.lit(0.0)), F.lit(0.0))
    change = lambda c: F.max_by(c, "t") - F.min_by(c, "t")
    return placed.groupBy("run").agg(
        slope("silhouette").alias("silhouette_slope"), slope("entropy").alias("entropy_slope"), slope("mean_cosine").alias("cosine_slope"),
        (-change("silhouette")).alias("silhouette_drop"), (-change("entropy")).alias("entropy_drop"), change("mean_cosine").alias("cosine_rise"),
    )


def hypotheses(runs: DataFrame, plain: str, full: str, without: str, collapse: float = 0.10, entropy: float = 0.30, cosine: float = 0.05) -> DataFrame:
    """hypothesis, supported (null: an arm is missing), value, bound for H1 to H6 from means of ``drifts`` over each ``method``."""
    mean = lambda arm, c: F.avg(F.when(F.col("method") == arm, F.col(c)))
    m = runs.agg(
        mean(plain, "silhouette_slope").alias("ps"), mean(full, "silhouette_slope").alias("fs"), mean(without, "silhouette_slope").alias("ws"), mean(plain, "silhouette_drop").alias("pd"),
        mean(plain, "entropy_drop").alias("pe"), mean(full, "entropy_drop").alias("fe"), mean(plain, "cosine_rise").alias("pc"),
    )
    base = "coalesce(ps, 0D)"
    rules = [
        ("H1", "pd >= bound", "pd", f"{collapse}D"), ("H2", "value < bound", "abs(fs)", "abs(ps) / 2"), ("H3", "pe > bound", "pe", "0D"), ("H4", "value < bound", "abs(fe)", f"{entropy}D / 2"),
        ("H5", "pc > bound", "pc", f"{cosine}D"), ("H6", f"value > bound and abs(ws - {base}) < abs(fs - {base})", "abs(ws)", "abs(fs)"),
    ]
    made = [m.selectExpr(f"'{n}' as hypothesis", f"{v} as value", f"cast({b} as double) as bound", "*").selectExpr("hypothesis", f"{r} as supported", "value", "bound") for n, r, v, b in rules]
    out = made[0]
    for each in made[1:]:
        out = out.unionByName(each)
    return out


# queries --------------------------------------------------------------------------------------------

def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as actions of runs (their communities); the vector of a message is the embedding of its number, where one is."""
    vectors = canonical(spark, sf_dir, "embeddings").selectExpr("vec_id as seq", "cast(embedding as array<double>) as x")
    rows = canonical(spark, sf_dir, "messages").where("community is not null").selectExpr("cast(community as string) as run", "user_id", "cast(round + 1 as int) as round", "msg_id as seq", "action")
    return rows.join(vectors, "seq", "left").select("run", "user_id", "round", "seq", "action", "x")


def w03_rolling_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_states(actions(spark, sf_dir)).select("run", "user_id", "seq", F.transform("state", lambda v: F.round(v, 4) + 0.0).alias("s")).select("run", "user_id", "seq", rounded("aggregate(s, 0D, (a, v) -> a + v)").alias("total"), rounded("s[0]").alias("first"), rounded("s[63]").alias("last"))


def m06(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = trajectory(actions(spark, sf_dir))
    return made.select("run", "point", "n_agents", *[rounded(c).alias(c) for c in ("silhouette", "davies_bouldin", "entropy", "mean_cosine", "cosine_halfwidth")])


def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a trajectory needs no clustering: agents with a state, entropy, cosines."""
    return m06(spark, sf_dir).drop("silhouette", "davies_bouldin")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drifts(materialize(trajectory(actions(spark, sf_dir)), "trajectory")).withColumn("method", F.expr("element_at(array('plain', 'full', 'without'), cast(run as int) % 3 + 1)"))


def z14(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return runs.select("method", "run", *[rounded(c).alias(c) for c in runs.columns if c not in ("method", "run")])


def s20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypotheses(_runs(spark, sf_dir), "plain", "full", "without").select("hypothesis", "supported", rounded("value").alias("value"), rounded("bound").alias("bound"))


_A = """a AS (SELECT m.community::VARCHAR AS run, m.user_id, (m.round + 1)::INTEGER AS round, m.msg_id AS seq, m.action, e.embedding::DOUBLE[] AS x FROM {messages} m LEFT JOIN embeddings e ON e.vec_id = m.msg_id WHERE m.community IS NOT NULL)"""
_W03 = f"""WITH {_A}, k AS (SELECT *, row_number() OVER (PARTITION BY run, user_id ORDER BY round, seq) AS k FROM a WHERE x IS NOT NULL),
d AS (SELECT u.run, u.user_id, u.seq, i.i, avg(w.x[i.i]) AS v FROM k u JOIN k w ON w.run = u.run AND w.user_id = u.user_id AND w.k BETWEEN u.k - 4 AND u.k CROSS JOIN range(1, 65) i(i) GROUP BY u.run, u.user_id, u.seq, i.i)
SELECT run, user_id, seq, @r6(sum(round(v, 4))) AS total, @r6(max(round(v, 4)) FILTER (i = 1)) AS first, @r6(max(round(v, 4)) FILTER (i = 64)) AS last FROM d GROUP BY run, user_id, seq"""
_R12 = f"""WITH {_A}, p AS (SELECT DISTINCT run, round AS point FROM a WHERE round IN (1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50)),
k AS (SELECT p.point, a.*, row_number() OVER (PARTITION BY p.run, p.point, user_id ORDER BY round DESC, seq DESC) AS k FROM p JOIN a ON a.run = p.run AND a.round <= p.point WHERE x IS NOT NULL),
s AS (SELECT run, point, user_id, i.i, avg(x[i.i]) AS v FROM k CROSS JOIN range(1, 65) i(i) WHERE k <= 5 GROUP BY run, point, user_id, i.i), v AS (SELECT run, point, user_id, list(v ORDER BY i) AS v FROM s GROUP BY run, point, user_id),
c AS (SELECT a.run, a.point, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.run = b.run AND a.point = b.point AND a.user_id < b.user_id),
m AS (SELECT run, point, avg(c) AS mean_cosine, CASE WHEN count(*) > 1 THEN 1.96 * stddev_samp(c) / sqrt(count(*)) ELSE 0 END AS h FROM c GROUP BY run, point), g AS (SELECT run, point, count(*) AS n FROM v GROUP BY run, point),
e AS (SELECT p.run, p.point, entropy(a.action) AS e FROM p JOIN a ON a.run = p.run AND a.round <= p.point GROUP BY p.run, p.point)
SELECT p.run, p.point, @n(coalesce(g.n, 0)) AS n_agents, @r6(CASE WHEN g.n >= 2 THEN e.e ELSE 0 END) AS entropy, @r6(coalesce(m.mean_cosine, 0)) AS mean_cosine, @r6(coalesce(m.h, 0)) AS cosine_halfwidth
FROM p LEFT JOIN g ON p.run = g.run AND p.point = g.point LEFT JOIN m ON p.run = m.run AND p.point = m.point LEFT JOIN e ON p.run = e.run AND p.point = e.point"""

register("w03_rolling_states", w03_rolling_states, twin(_W03))
register("r12_checkpoints", r12, twin(_R12))
register("m06_collapse_trajectory", m06)
register("z14_collapse_frame", z14)
register("s20_collapse_hypotheses", s20)
