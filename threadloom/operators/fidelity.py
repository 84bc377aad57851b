"""Reply graphs, and how far one log is from another: graph, distribution and sequence metrics."""

from pyspark.sql import DataFrame, functions as F

from threadloom.operators.features import CANONICAL_ACTION, LINKED
from threadloom.operators.sqlop import operator, run
from threadloom.workspace import materialize

EDGES = f"{LINKED}, edges AS (SELECT least(user_id, parent_user) AS u, greatest(user_id, parent_user) AS v, count(*) AS w FROM linked WHERE parent_user <> user_id GROUP BY 1, 2)"
NODES = "nodes AS (SELECT user_id AS id, min(community) AS c FROM {messages} GROUP BY user_id)"
#: Edges with the labels of both ends; who has none shares community -1.
LABELLED = f"{EDGES}, {NODES}, le AS (SELECT e.u, e.v, e.w, coalesce(a.c, -1) AS cu, coalesce(b.c, -1) AS cv, a.c IS NOT NULL AND b.c IS NOT NULL AS known FROM edges e JOIN nodes a ON e.u = a.id JOIN nodes b ON e.v = b.id)"


def sided(text: str, side: str) -> str:
    """The same over the messages of one side."""
    return text.replace("{messages}", f"(SELECT * FROM {{messages}} WHERE side = '{side}')")


MODULARITY = """SELECT sum(inside / m - (degree / (2 * m)) * (degree / (2 * m))) AS q FROM (
    SELECT c, sum(inside) AS inside, sum(degree) AS degree FROM (
      SELECT cu AS c, CASE WHEN cu = cv THEN @f(w) ELSE 0.0 END AS inside, @f(w) AS degree FROM le UNION ALL SELECT cv AS c, 0.0 AS inside, @f(w) AS degree FROM le) x GROUP BY c) y
    CROSS JOIN (SELECT @f(sum(w)) AS m FROM le) z"""
# twins from the definitions: sums over pairs of nodes, and counts of edges within and across
_PAIRS = """WITH r AS (SELECT a.user_id AS x, b.user_id AS y FROM {messages} a JOIN {messages} b ON a.thread_id = b.thread_id AND a.parent_id = b.msg_id AND a.user_id <> b.user_id),
ends_ AS (SELECT x, y FROM r UNION ALL SELECT y, x FROM r), k AS (SELECT x, count(*) AS k FROM ends_ GROUP BY x), l AS (SELECT user_id AS id, coalesce(min(community), -1) AS c, min(community) IS NOT NULL AS known FROM {messages} GROUP BY user_id)"""
_PAIR_MODULARITY = f"""{_PAIRS}, n AS (SELECT k.x, k.k, l.c FROM k JOIN l ON k.x = l.id), t AS (SELECT count(*) AS two_m FROM ends_)
SELECT (SELECT sum(CASE WHEN a.c = b.c THEN 1.0 ELSE 0.0 END) FROM ends_ JOIN l a ON ends_.x = a.id JOIN l b ON ends_.y = b.id) / max(two_m) - (SELECT sum(1.0 * p.k * q.k) FROM n p JOIN n q ON p.c = q.c) / (max(two_m) * max(two_m)) AS q FROM t"""

operator("g01_reply_graph", f"WITH {EDGES} SELECT u, v, @n(w) AS w FROM edges")
operator("g02_label_coverage", f"""WITH {LABELLED} SELECT (SELECT @r6(avg(CASE WHEN c IS NOT NULL THEN 1.0 ELSE 0.0 END)) FROM nodes) AS node_coverage,
  (SELECT @r6(avg(CASE WHEN known THEN 1.0 ELSE 0.0 END)) FROM le) AS edge_coverage""")
operator("g03_partition_cover", f"WITH {NODES} SELECT coalesce(c, -1) AS community, @n(count(*)) AS n FROM nodes GROUP BY 1")
operator("g04_modularity", f"WITH {LABELLED} SELECT @r6(q) AS modularity FROM ({MODULARITY}) q", check=f"SELECT @r6(q) AS modularity FROM ({_PAIR_MODULARITY}) z")
operator("g04_delta_modularity", f"SELECT @r6(coalesce(abs(a.q - b.q), 0.0)) AS delta FROM (WITH {sided(LABELLED, 'sim')} {MODULARITY}) a CROSS JOIN (WITH {sided(LABELLED, 'real')} {MODULARITY}) b",
         check=f"SELECT @r6(coalesce(abs(a.q - b.q), 0.0)) AS delta FROM ({sided(_PAIR_MODULARITY, 'sim')}) a CROSS JOIN ({sided(_PAIR_MODULARITY, 'real')}) b")
operator("g05_ei_index", f"WITH {LABELLED} SELECT @r6(avg(CASE WHEN cu <> cv THEN 1.0 ELSE -1.0 END)) AS ei_index FROM le WHERE known",
         check=f"{_PAIRS}, e AS (SELECT DISTINCT least(x, y) AS x, greatest(x, y) AS y FROM r), g AS (SELECT count(*) FILTER (a.c <> b.c) AS outer_, count(*) FILTER (a.c = b.c) AS inner_ FROM e JOIN l a ON e.x = a.id JOIN l b ON e.y = b.id WHERE a.known AND b.known) SELECT @r6(1.0 * (outer_ - inner_) / (outer_ + inner_)) AS ei_index FROM g")
DESCRIPTOR = f"""WITH {EDGES}, {NODES},
ends AS (SELECT u AS a, v AS b FROM edges UNION ALL SELECT v AS a, u AS b FROM edges), deg AS (SELECT a, count(*) AS k FROM ends GROUP BY a),
tri AS (SELECT x.a AS a, count(*) AS t FROM ends x JOIN ends y ON x.b = y.a JOIN edges z ON z.u = least(x.a, y.b) AND z.v = greatest(x.a, y.b) WHERE y.b <> x.a GROUP BY x.a),
full_ AS (SELECT n.id, coalesce(d.k, 0) AS k, coalesce(@f(t.t) / nullif(d.k * (d.k - 1), 0), 0.0) AS cc FROM nodes n LEFT JOIN deg d ON n.id = d.a LEFT JOIN tri t ON n.id = t.a)"""
_DESCRIBED = """SELECT ln(1.0 + count(*)) AS n, ln(1.0 + (SELECT count(*) FROM edges)) AS m, ln(1.0 + 2.0 * (SELECT count(*) FROM edges) / (@f(count(*)) * (count(*) - 1))) AS density, ln(1.0 + avg(@f(k))) AS degree_mean,
  ln(1.0 + stddev_pop(@f(k))) AS degree_std, ln(1.0 + @percentile(k, 0.5)) AS degree_median, ln(1.0 + max(k)) AS degree_max, ln(1.0 + @percentile(k, 0.75)) AS degree_p75, ln(1.0 + @percentile(k, 0.25)) AS degree_p25,
  ln(1.0 + avg(cc)) AS clustering_mean, ln(1.0 + stddev_pop(cc)) AS clustering_std FROM full_"""
_NAMES = ("n", "m", "density", "degree_mean", "degree_std", "degree_median", "degree_max", "degree_p75", "degree_p25", "clustering_mean", "clustering_std")


def clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, k, cc of ``nodes`` (id): degree and local clustering in the simple graph ``edges`` (u < v, each once).

    Each edge is kept at its end of the lesser degree, so no list is longer than the root of twice the edges.  A list goes
    to each of its members with what comes after that one, and meets the member's own list: a triangle is found once.
    """
    ends = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u"))
    degree = materialize(ends.groupBy("a").agg(F.count("*").alias("k")), "degrees")
    rank = lambda x: degree.select(F.col("a").alias(x), F.struct("k", "a").alias(f"{x}_rank"))
    ranked = edges.join(rank("u"), "u").join(rank("v"), "v").select(F.least("u_rank", "v_rank").alias("low"), F.greatest("u_rank", "v_rank").alias("high"))
    up = materialize(ranked.groupBy(F.col("low.a").alias("x")).agg(F.transform(F.array_sort(F.collect_list("high")), lambda h: h["a"]).alias("up")), "neighbours")
    after = up.select("x", "up", F.posexplode("up").alias("i", "y")).select("x", "y", F.expr("slice(up, i + 2, size(up))").alias("rest")).where(F.size("rest") > 0)
    met = after.join(up.select(F.col("x").alias("y"), F.col("up").alias("of_y")), "y").select("x", "y", F.array_intersect("rest", "of_y").alias("zs")).where(F.size("zs") > 0)
    corners = F.concat(F.array(*(F.struct(F.col(c).alias("id"), F.size("zs").cast("long").alias("t")) for c in "xy")), F.transform("zs", lambda z: F.struct(z.alias("id"), F.lit(1).cast("long").alias("t"))))
    triangles = met.select(F.inline(corners)).groupBy("id").agg(F.sum("t").alias("t"))
    full = nodes.join(degree.withColumnRenamed("a", "id"), "id", "left").join(triangles, "id", "left")
    return full.select("id", F.coalesce("k", F.lit(0)).cast("long").alias("k"), F.expr("coalesce(2D * t / nullif(k * (k - 1), 0), 0D)").alias("cc"))


def _slim(messages: DataFrame) -> DataFrame:
    return materialize(messages.select("thread_id", "msg_id", "parent_id", "user_id", "side"), "messages")


def _structure(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) of the reply graph, and id, k, cc of all users."""
    text = "SELECT DISTINCT least(m.user_id, p.user_id) AS u, greatest(m.user_id, p.user_id) AS v FROM {messages} m JOIN {messages} p ON m.thread_id = p.thread_id AND m.parent_id = p.msg_id WHERE m.user_id <> p.user_id"
    edges = materialize(run(text, {"messages": messages}), "edges")
    return edges, clustering(edges, messages.select(F.col("user_id").alias("id")).distinct())


def _described(messages: DataFrame) -> DataFrame:
    edges, full = _structure(messages)
    return materialize(run(f"WITH edges AS (SELECT * FROM {{edges}}), full_ AS (SELECT * FROM {{full}}) {_DESCRIBED}", {"edges": edges, "full": materialize(full, "clustering")}), "descriptor")


def descriptor(messages: DataFrame) -> DataFrame:
    return run(f"SELECT {', '.join(f'@r6({x}) AS {x}' for x in _NAMES)} FROM {{described}}", {"described": _described(_slim(messages))})


def structural_fidelity(messages: DataFrame) -> DataFrame:
    slim = _slim(messages)
    return run(f"SELECT @r6({_correlation('s', 'r')}) AS fidelity FROM {{sim}} s CROSS JOIN {{real}} r", {side: _described(slim.where(F.col("side") == side)) for side in ("sim", "real")})


def local_clustering(messages: DataFrame) -> DataFrame:
    return run("SELECT id, @r6(cc) AS clustering FROM {full}", {"full": _structure(_slim(messages))[1]})


operator("g06_structural_descriptor", f"{DESCRIPTOR} SELECT {', '.join(f'@r6({x}) AS {x}' for x in _NAMES)} FROM ({_DESCRIBED}) d", steps=descriptor)


def _correlation(x: str, y: str, names=_NAMES) -> str:
    """Pearson of two rows with the same columns."""
    sums = lambda f: "(" + " + ".join(f.format(x=f"{x}.{n}", y=f"{y}.{n}") for n in names) + ")"
    n = f"{len(names)}.0"
    cov, vx, vy = (f"({n} * {sums(p)} - {sums(a)} * {sums(b)})" for p, a, b in (("{x} * {y}", "{x}", "{y}"), ("{x} * {x}", "{x}", "{x}"), ("{y} * {y}", "{y}", "{y}")))
    return f"CASE WHEN {vx} > 1e-12 AND {vy} > 1e-12 THEN ({cov} / sqrt({vx} * {vy}) + 1) / 2 ELSE 0.0 END"


_BOTH = f"({sided(DESCRIPTOR, 'sim')} {_DESCRIBED}) s CROSS JOIN ({sided(DESCRIPTOR, 'real')} {_DESCRIBED}) r"
_LONG = " UNION ALL ".join(f"SELECT s.{x} AS x, r.{x} AS y FROM b" for x in _NAMES).replace("s.", "s_").replace("r.", "r_")
operator("g07_structural_fidelity", f"SELECT @r6({_correlation('s', 'r')}) AS fidelity FROM {_BOTH}",
         check=f"WITH b AS (SELECT {', '.join(f's.{x} AS s_{x}, r.{x} AS r_{x}' for x in _NAMES)} FROM {_BOTH}) SELECT @r6(coalesce((corr(x, y) + 1) / 2, 0.0)) AS fidelity FROM ({_LONG}) l", steps=structural_fidelity)
operator("j17_local_clustering", f"{DESCRIPTOR} SELECT id, @r6(cc) AS clustering FROM full_", steps=local_clustering)
operator("g10_copresence_density", """
WITH t AS (SELECT round, thread_id, count(DISTINCT user_id) AS k FROM {messages} GROUP BY round, thread_id), a AS (SELECT count(DISTINCT user_id) AS n FROM {messages})
SELECT round, @r6(sum(@f(k) * (k - 1) / 2) / greatest(max(n) * (max(n) - 1) / 2, 1)) AS density FROM t CROSS JOIN a GROUP BY round""")
_SHARES = "p AS (SELECT action, @f(sum(CASE WHEN side = 'sim' THEN 1 ELSE 0 END)) / (SELECT count(*) FROM {messages} WHERE side = 'sim') AS p, @f(sum(CASE WHEN side = 'real' THEN 1 ELSE 0 END)) / (SELECT count(*) FROM {messages} WHERE side = 'real') AS q FROM {messages} GROUP BY action)"
_JS = "0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0.0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0.0 END)"
operator("d04_ks_distance", """
WITH d AS (SELECT toxicity AS x, side FROM {messages}), g AS (SELECT x, sum(CASE WHEN side = 'sim' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN side = 'real' THEN 1 ELSE 0 END) AS b FROM d GROUP BY x),
c AS (SELECT sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER (ORDER BY x) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM g) SELECT @r6(max(abs(@f(ca) / na - @f(cb) / nb))) AS ks FROM c""")
operator("d06_action_ned", f"WITH {_SHARES} SELECT @r6(sqrt(greatest({_JS}, 0.0))) AS ned FROM p")
operator("d08_action_cosine", f"WITH {_SHARES} SELECT @r6(sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q)) + 1e-10)) AS cosine FROM p")
operator("d09_uniformity", "WITH c AS (SELECT action, @f(count(*)) AS n FROM {messages} GROUP BY action), s AS (SELECT n / sum(n) OVER () AS p, count(*) OVER () AS k FROM c) SELECT @r6(-sum(p * ln(p)) / nullif(ln(max(k)), 0.0)) AS uniformity FROM s")
_PROFILE = "pr AS (SELECT user_id, min(community) AS c, " + ", ".join(f"avg(CASE WHEN action = '{a}' THEN 1.0 ELSE 0.0 END) AS {a}" for a in ("discuss", "edit", "report", "restore", "revert")) + " FROM {messages} GROUP BY user_id)"
_ACTIONS = ("discuss", "edit", "report", "restore", "revert")
operator("d10_complexity", f"WITH {_PROFILE} SELECT @r6(({' + '.join(f'var_pop({a})' for a in _ACTIONS)}) / 5) AS complexity FROM pr")
operator("d11_caricature", f"""WITH {_PROFILE}, g AS (SELECT c, {', '.join(f'avg({a}) AS {a}' for a in _ACTIONS)}, ({' + '.join(f'var_samp({a})' for a in _ACTIONS)}) / 5 AS v FROM pr WHERE c >= 0 GROUP BY c HAVING count(*) >= 2)
SELECT @r6(avg(sqrt({' + '.join(f'(x.{a} - y.{a}) * (x.{a} - y.{a})' for a in _ACTIONS)}) / nullif(sqrt((x.v + y.v) / 2), 0.0))) AS caricature FROM g x JOIN g y ON x.c < y.c""")
operator("d13_discourse_similarity", f"WITH {_SHARES.replace('action', 'page_type')} SELECT @r6(1 / (1 + ({_JS}))) AS similarity FROM p")
operator("d14_trajectory_shape", """
WITH s AS (SELECT user_id, toxicity AS y, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS i FROM {messages}), d AS (SELECT *, sign(y - lag(y) OVER (PARTITION BY user_id ORDER BY i)) AS sg FROM s),
e AS (SELECT *, lag(sg) OVER (PARTITION BY user_id ORDER BY i) AS before FROM d)
SELECT user_id, @r6(var_pop(y)) AS variance, @r6(coalesce(covar_pop(@f(i), y) / nullif(var_pop(@f(i)), 0.0), 0.0)) AS slope, @n(sum(CASE WHEN sg <> before THEN 1 ELSE 0 END)) AS oscillation, @r6(max(y) - min(y)) AS spread FROM e GROUP BY user_id""")
operator("d15_trajectory_similarity", """
WITH a AS (SELECT side, var_pop(toxicity) AS v, max(toxicity) - min(toxicity) AS r, avg(toxicity) AS m FROM {messages} GROUP BY side)
SELECT @r6(((x.v * y.v + x.r * y.r + x.m * y.m) / (sqrt(x.v * x.v + x.r * x.r + x.m * x.m) * sqrt(y.v * y.v + y.r * y.r + y.m * y.m)) + 1) / 2) AS similarity FROM a x JOIN a y ON x.side = 'sim' AND y.side = 'real'""")
operator("d16_speech_acts", """
WITH k AS (SELECT user_id % 2 AS side, CASE WHEN @matches(text, @re('[?]')) THEN 'question' WHEN @contains(text, '!') THEN 'directive' WHEN length(text) < 40 THEN 'expressive' ELSE 'assertive' END AS act FROM {turns}),
s AS (SELECT act, avg(CASE WHEN side = 0 THEN 1.0 ELSE 0.0 END) * count(*) AS a, avg(CASE WHEN side = 1 THEN 1.0 ELSE 0.0 END) * count(*) AS b FROM k GROUP BY act)
SELECT @r6(1 - sum(abs(a / (SELECT sum(a) FROM s) - b / (SELECT sum(b) FROM s))) / 2) AS similarity FROM s""")
operator("d17_conflict_trajectory", """
WITH p AS (SELECT action, row_number() OVER (PARTITION BY thread_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY thread_id) AS n FROM {messages})
SELECT least(@floor(@f(i) / greatest(n - 1, 1) * 30), 29) AS bin, @r6(avg(CASE WHEN action = 'revert' THEN 1.0 ELSE 0.0 END)) AS conflict FROM p GROUP BY 1""")
operator("d18_round_conflict", f"SELECT round, @r6(avg(CASE WHEN {CANONICAL_ACTION} = 'conflict' THEN 1.0 ELSE 0.0 END)) AS conflict FROM {{messages}} GROUP BY round")
operator("d19_composite", f"WITH {_SHARES}, n AS (SELECT sqrt(greatest({_JS}, 0.0)) AS ned, sum(abs(p - q)) / 2 AS l1 FROM p) SELECT @r6(ned) AS action_distance, @r6(0.5 * ned + 0.5 * l1) AS composite FROM n")
operator("d20_plan_consistency", "SELECT @r6(coalesce(avg(CASE WHEN planned IS NOT NULL THEN CASE WHEN planned = action THEN 1.0 ELSE 0.0 END END), 1.0)) AS consistency FROM (SELECT action, CASE WHEN msg_id % 3 = 0 THEN NULL WHEN msg_id % 3 = 1 THEN action ELSE 'edit' END AS planned FROM {messages}) x")
operator("d21_entropy_bits", "WITH c AS (SELECT community, action, @f(count(*)) AS n FROM {messages} GROUP BY community, action), s AS (SELECT community, n / sum(n) OVER (PARTITION BY community) AS p FROM c) SELECT community, @r6(-sum(p * log2(p))) AS bits FROM s GROUP BY community")
operator("d22_metric_row", f"""
WITH {LABELLED}, {_SHARES} SELECT 'ned' AS metric, @r6(sqrt(greatest({_JS}, 0.0))) AS value FROM p UNION ALL SELECT 'modularity', @r6(q) FROM ({MODULARITY}) z UNION ALL SELECT 'ei_index', @r6(avg(CASE WHEN cu <> cv THEN 1.0 ELSE -1.0 END)) FROM le WHERE known
UNION ALL SELECT 'cosine', @r6(sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q)) + 1e-10)) FROM p UNION ALL SELECT 'edges', @f(count(*)) FROM edges""")
