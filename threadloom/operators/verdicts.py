"""Verdicts over tables of results: the feasibility gate, the dissociation of ablations and layers.

Bodies are made for the names of a user's own conditions, metrics and bounds; each has a twin written on its own.
"""

from __future__ import annotations

from threadloom.operators.sqlop import operator

# S19 ------------------------------------------------------------------------------------------------


def viability(treatment: str, control: str, metrics: tuple[str, ...], min_pairs: int = 3, min_metric_wins: int = 2, win_fraction: float = 0.6666666667, min_improvement: float = 0.05,
              max_regression: float = 0.10, min_message_ratio: float = 0.95, max_safe_rate: float = 0.10, min_consistency: float = 0.90) -> str:
    """One row: pairs, metrics won, what the guards met, verdict and its reason.

    A treatment and a control pair on dataset, model and repeat (nulls are equal there).  A metric, lower being
    better, is won if no pair lacks it and enough pairs improve by ``min_improvement``.  Without pairs enough the verdict
    is CONDITIONAL_GO; a guard whose column is null throughout isn't passed; a ratio to a control without messages doesn't count.
    """
    same = " AND ".join(f"t.{k} IS NOT DISTINCT FROM c.{k}" for k in ("dataset", "model", "repeat"))
    sides = ", ".join(f"@f(t.{m}) AS t{i}, @f(c.{m}) AS c{i}" for i, m in enumerate(metrics))
    long = " UNION ALL ".join(f"SELECT {i} AS metric, t{i} AS t, c{i} AS c FROM p" for i in range(len(metrics)))
    return f"""
WITH p AS (SELECT @f(t.message_count) AS mt, @f(c.message_count) AS mc, @f(t.safe_rate) AS safe_rate, @f(t.consistency) AS consistency, {sides}
  FROM {{results}} t JOIN {{results}} c ON {same} WHERE t.condition = '{treatment}' AND c.condition = '{control}'),
v AS ({long}), d AS (SELECT metric, CASE WHEN c IS NOT NULL THEN t END AS t, CASE WHEN t IS NOT NULL THEN c END AS c FROM v),
m AS (SELECT metric, count(*) AS n, count(t) AS valid, sum(CASE WHEN (c - t) / greatest(abs(c), 1e-12) >= {min_improvement} THEN 1 ELSE 0 END) AS wins, avg(t) AS t, avg(c) AS c FROM d GROUP BY metric),
w AS (SELECT coalesce(sum(CASE WHEN valid = n AND wins >= ceil({win_fraction} * n - 1e-9) THEN 1 ELSE 0 END), 0) AS won, coalesce(@any((t - c) / greatest(abs(c), 1e-12) > {max_regression}), false) AS regressed FROM m),
g AS (SELECT count(*) AS n, min(CASE WHEN mc > 0 THEN mt / mc END) AS ratio, max(safe_rate) AS safe_rate, min(consistency) AS consistency FROM p),
q AS (SELECT g.n, w.won, g.ratio, g.safe_rate, g.consistency, coalesce(g.ratio >= {min_message_ratio}, false) AS throughput_pass, coalesce(g.safe_rate <= {max_safe_rate}, false) AS safe_pass,
  coalesce(g.consistency >= {min_consistency}, false) AS consistency_pass, NOT w.regressed AS regression_pass FROM g CROSS JOIN w),
r AS (SELECT *, CASE WHEN n < {min_pairs} THEN 0 WHEN NOT (throughput_pass AND safe_pass AND consistency_pass AND regression_pass) THEN 3 WHEN won >= {min_metric_wins} THEN 1 WHEN won = {min_metric_wins} - 1 THEN 2 ELSE 3 END AS k FROM q)
SELECT @n(n) AS n_pairs, @n(won) AS metric_wins, @n(ceil({win_fraction} * n - 1e-9)) AS required_repeat_wins, @r6(ratio) AS min_message_ratio, @r6(safe_rate) AS max_safe_rate, @r6(consistency) AS min_consistency,
  throughput_pass, safe_pass, consistency_pass, regression_pass, CASE k WHEN 1 THEN 'GO' WHEN 3 THEN 'STOP' ELSE 'CONDITIONAL_GO' END AS verdict,
  CASE k WHEN 0 THEN 'insufficient_complete_pairs' WHEN 1 THEN 'primary_metric_and_quality_gates_passed' WHEN 2 THEN 'borderline_primary_metric_support' ELSE 'primary_metric_or_quality_gate_failed' END AS reason FROM r"""


METRICS = ("action_distance", "interaction_distance", "language_distance")

_S19 = """
WITH t AS (SELECT * FROM {results} WHERE condition = '1-URGENT'), c AS (SELECT * FROM {results} WHERE condition = '5-LOW'),
p AS (SELECT t.message_count / c.message_count::DOUBLE AS ratio, t.safe_rate AS s, t.consistency AS y,
  [t.action_distance, t.interaction_distance, t.language_distance]::DOUBLE[] AS a, [c.action_distance, c.interaction_distance, c.language_distance]::DOUBLE[] AS b FROM t JOIN c USING (dataset, model, repeat)),
e AS (SELECT unnest(a) AS a, unnest(b) AS b, generate_subscripts(a, 1) AS m FROM p),
k AS (SELECT m, count(*) FILTER ((b - a) / abs(b) >= 0.05) >= ceil(2 * count(*) / 3.0 - 1e-6) AND count(a) = count(*) AND count(b) = count(*) AS won, avg(a) / avg(b) - 1 > 0.1 AS worse FROM e GROUP BY m),
s AS (SELECT (SELECT count(*) FROM p) AS n, (SELECT count(*) FROM k WHERE won) AS won, (SELECT min(ratio) FROM p) AS ratio, (SELECT max(s) FROM p) AS safe, (SELECT min(y) FROM p) AS cons, (SELECT count(*) FROM k WHERE worse) AS worse),
v AS (SELECT *, ratio >= 0.95 AND safe <= 0.1 AND cons >= 0.9 AND worse = 0 AS fine FROM s)
SELECT @n(n) AS n_pairs, @n(won) AS metric_wins, @n(ceil(2 * n / 3.0 - 1e-6)) AS required_repeat_wins, @r6(ratio) AS min_message_ratio, @r6(safe) AS max_safe_rate, @r6(cons) AS min_consistency,
  ratio >= 0.95 AS throughput_pass, safe <= 0.1 AS safe_pass, cons >= 0.9 AS consistency_pass, worse = 0 AS regression_pass,
  CASE WHEN n < 3 OR (fine AND won = 1) THEN 'CONDITIONAL_GO' WHEN fine AND won >= 2 THEN 'GO' ELSE 'STOP' END AS verdict,
  CASE WHEN n < 3 THEN 'insufficient_complete_pairs' WHEN fine AND won >= 2 THEN 'primary_metric_and_quality_gates_passed' WHEN fine AND won = 1 THEN 'borderline_primary_metric_support' ELSE 'primary_metric_or_quality_gate_failed' END AS reason FROM v"""

operator("s19_viability", viability("1-URGENT", "5-LOW", METRICS), check=_S19)


# S16 ------------------------------------------------------------------------------------------------


def dissociation(full: str, predicted: dict[str, str], layers: dict[str, tuple[str, ...]], higher: frozenset[str] = frozenset(), threshold: float = 0.7) -> str:
    """A row for each ablation: its losses' greatest layer, whether that is the one predicted, and over all of them the mean
    correlation of loss profiles and the verdict.

    A loss is the mean over a layer's metrics of the worsening against ``full``, in that condition's population deviations (1 if 0);
    metrics in ``higher`` are better when greater.  The first layer named wins a tie; metrics without values are left out, and so are
    pairs of profiles without a correlation; with none left the verdict is false.
    """
    names = "', '".join(predicted)
    parts = [f"SELECT condition, {at} AS layer, '{m}' AS metric, {1 if m in higher else -1} AS sign, @f({m}) AS x FROM {{results}}" for at, ms in enumerate(layers.values()) for m in ms]
    layer_of = lambda c: "CASE " + c + "".join(f" WHEN {i} THEN '{n}'" for i, n in enumerate(layers)) + " END"
    expected = "CASE o.condition" + "".join(f" WHEN '{c}' THEN '{n}'" for c, n in predicted.items()) + " END"
    return f"""
WITH v AS ({" UNION ALL ".join(parts)}), s AS (SELECT condition, layer, metric, sign, avg(x) AS m, stddev_pop(x) AS sd FROM v WHERE x IS NOT NULL GROUP BY condition, layer, metric, sign),
l AS (SELECT a.condition, a.layer, avg(a.sign * (f.m - a.m) / coalesce(nullif(f.sd, 0.0), 1.0)) AS loss FROM s a JOIN s f ON a.metric = f.metric AND a.layer = f.layer AND f.condition = '{full}' WHERE a.condition IN ('{names}') GROUP BY a.condition, a.layer),
c AS (SELECT @corr(x.loss, y.loss) AS r FROM l x JOIN l y ON x.layer = y.layer AND x.condition < y.condition GROUP BY x.condition, y.condition), r AS (SELECT avg(r) AS r FROM c),
o AS (SELECT condition, layer, loss FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY loss DESC, layer) AS k FROM l) q WHERE k = 1),
t AS (SELECT o.condition, {expected} AS predicted, {layer_of("o.layer")} AS observed, o.loss FROM o), a AS (SELECT min(CASE WHEN predicted = observed THEN 1 ELSE 0 END) AS hit FROM t)
SELECT t.condition, t.predicted, t.observed, @r6(t.loss) AS loss, t.predicted = t.observed AS matches, @r6(r.r) AS mean_correlation, coalesce(r.r < {threshold} AND a.hit = 1, false) AS supported FROM t CROSS JOIN r CROSS JOIN a"""


_S16 = """
WITH m AS (SELECT condition, avg(action_distance) AS a, avg(interaction_distance) AS i, avg(language_distance) AS g, avg(consistency) AS y, stddev_pop(action_distance) AS da, stddev_pop(interaction_distance) AS di, stddev_pop(language_distance) AS dg, stddev_pop(consistency) AS dy FROM {results} GROUP BY condition),
f AS (SELECT * FROM m WHERE condition = '1-URGENT'),
l AS (SELECT m.condition, [(m.a - f.a) / f.da, (m.i - f.i) / f.di, ((m.g - f.g) / f.dg + (f.y - m.y) / f.dy) / 2] AS p FROM m, f WHERE m.condition IN ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')),
e AS (SELECT condition, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM l), c AS (SELECT corr(u.x, w.x) AS r FROM e u JOIN e w ON u.i = w.i AND u.condition <> w.condition GROUP BY u.condition, w.condition),
t AS (SELECT condition, list_max(p) AS loss, ['action', 'interaction', 'language'][list_position(p, list_max(p))] AS observed, CASE condition WHEN '2-HIGH' THEN 'action' WHEN '3-MEDIUM' THEN 'interaction' ELSE 'language' END AS predicted FROM l)
SELECT condition, predicted, observed, @r6(loss) AS loss, predicted = observed AS matches, @r6((SELECT avg(r) FROM c)) AS mean_correlation, (SELECT avg(r) FROM c) < 0.7 AND (SELECT bool_and(predicted = observed) FROM t) AS supported FROM t"""

operator(
    "s16_dissociation",
    dissociation("1-URGENT", {"2-HIGH": "action", "3-MEDIUM": "interaction", "4-NOT SPECIFIED": "language"}, {"action": ("action_distance",), "interaction": ("interaction_distance",), "language": ("language_distance", "consistency")}, frozenset({"consistency"})),
    check=_S16,
)
