"""Rounds, runs, sampling, loading rules and the remaining data-bearing operators over messages."""

from threadloom.operators.features import LINKED, _ROUND
from threadloom.operators.sqlop import operator

operator("m01_round_metrics", """
WITH a AS (SELECT count(DISTINCT user_id) AS agents FROM {messages}), e AS (SELECT round, -sum(p * ln(p)) AS h FROM (SELECT round, action, @f(count(*)) / sum(count(*)) OVER (PARTITION BY round) AS p FROM {messages} GROUP BY round, action) x GROUP BY round),
t AS (SELECT round, sum(k * (k - 1) / 2) AS pairs FROM (SELECT round, thread_id, @f(count(DISTINCT user_id)) AS k FROM {messages} GROUP BY round, thread_id) y GROUP BY round),
r AS (SELECT round, count(*) AS n, sum(CASE WHEN action IN ('disagree', 'revert', 'counter_argue', 'report', 'block') THEN 1 ELSE 0 END) AS c, count(DISTINCT user_id) AS people FROM {messages} GROUP BY round)
SELECT r.round, @n(r.n) AS message_count, @n(r.c) AS conflict_count, @r6(@f(r.c) / r.n) AS conflict_ratio, @n(r.people) AS unique_participants, @r6(e.h) AS action_diversity, @r6(t.pairs / greatest(agents * (agents - 1) / 2, 1)) AS interaction_density
FROM r JOIN e ON r.round = e.round JOIN t ON r.round = t.round CROSS JOIN a""")
operator("m02_first_events", f"""
WITH {_ROUND}, h AS (SELECT round, conflicts, @f(conflicts) / n > 0.3 AS high, lag(@f(conflicts) / n > 0.3) OVER (ORDER BY round) AS before FROM r)
SELECT @n(min(CASE WHEN conflicts > 0 THEN round END)) AS first_conflict, @n(coalesce(min(CASE WHEN high AND before THEN round END), -1)) AS first_escalation, (SELECT @n(coalesce(min(round), -1)) FROM {{messages}} WHERE action = 'award_delta') AS first_persuasion FROM h""")
operator("m03_escalation_runs", f"WITH {_ROUND}, h AS (SELECT round, @f(conflicts) / n > 0.3 AS high FROM r), g AS (SELECT high, round - row_number() OVER (PARTITION BY high ORDER BY round) AS island, round FROM h) SELECT high, @n(min(round)) AS first_round, @n(max(round)) AS last_round FROM g GROUP BY high, island")
operator("m04_run_totals", "SELECT community AS run, @n(count(*)) AS turns, @r6(avg(CASE WHEN action <> 'revert' THEN 1.0 ELSE 0.0 END)) AS success_rate, avg(CASE WHEN action <> 'revert' THEN 1.0 ELSE 0.0 END) >= 0.95 AS passes FROM {messages} GROUP BY community")
operator("m05_replay_ceiling", """
WITH replay AS (SELECT action, 'real' AS side FROM {messages} WHERE side = 'real' UNION ALL SELECT action, 'sim' AS side FROM {messages} WHERE side = 'real'),
c AS (SELECT action, @f(sum(CASE WHEN side = 'sim' THEN 1 ELSE 0 END)) AS a, @f(sum(CASE WHEN side = 'real' THEN 1 ELSE 0 END)) AS b FROM replay GROUP BY action), p AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c)
SELECT @r6(sqrt(greatest(0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0.0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0.0 END), 0.0))) AS ned, @r6(sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q)))) AS cosine FROM p""",
         check="SELECT CASE WHEN count(*) > 0 THEN @f(0) END AS ned, CASE WHEN count(*) > 0 THEN @f(1) END AS cosine FROM {messages} WHERE side = 'real'")
operator("r01_counts_by_year", "SELECT round % 3 AS part, user_id, @n(count(*)) AS n FROM {messages} GROUP BY round % 3, user_id")
operator("r03_merged_counts", "SELECT user_id, @n(sum(n)) AS n FROM (SELECT user_id, round % 3 AS part, count(*) AS n FROM {messages} GROUP BY user_id, round % 3) x GROUP BY user_id")
operator("r04_targeted_collection", f"WITH {LINKED}, a AS (SELECT user_id FROM {{messages}} GROUP BY user_id HAVING count(*) >= 60), k AS (SELECT l.user_id, l.msg_id, l.parent_action, row_number() OVER (PARTITION BY l.user_id ORDER BY l.seq) AS k FROM linked l WHERE l.user_id IN (SELECT user_id FROM a)) SELECT user_id, msg_id, coalesce(parent_action, 'none') AS parent_action FROM k WHERE k <= 20")
operator("r05_evidence_collection", "WITH e AS (SELECT leaf, msg_id, CASE WHEN quality = 0 THEN 'delete' WHEN toxic = 1 THEN 'attack' END AS kind FROM {texts}), k AS (SELECT *, row_number() OVER (PARTITION BY leaf, kind ORDER BY msg_id) AS k FROM e WHERE kind IS NOT NULL) SELECT leaf, kind, msg_id FROM k WHERE k <= CASE kind WHEN 'delete' THEN 13 ELSE 2 END")
operator("r08_round_windows", "SELECT cast(cast(ts as date) as varchar(10)) AS day, @n(count(*)) AS n, @r6(avg(CASE WHEN action = 'revert' THEN 1.0 ELSE 0.0 END)) AS conflict FROM {messages} GROUP BY 1")
operator("r09_resume_point", "WITH c AS (SELECT round, count(*) AS n FROM {messages} GROUP BY round), l AS (SELECT max(round) AS last FROM c WHERE n >= 300) SELECT @n(count(*)) AS kept, @n(max(last)) AS last_round FROM {messages} m CROSS JOIN l WHERE m.round <= l.last")
operator("r11_compaction_window", "WITH k AS (SELECT thread_id, msg_id, row_number() OVER (PARTITION BY thread_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY thread_id) AS n FROM {turns}) SELECT thread_id, msg_id FROM k WHERE i <= least(4, n - 2)")

operator("l04_conflict_flags", "SELECT thread_id, msg_id, coalesce(toxic, 0) = 1 AS comment_flag, max(coalesce(toxic, 0)) OVER (PARTITION BY thread_id) = 1 AS conversation_flag FROM {texts}")
operator("l05_event_expansion", "SELECT msg_id * 10 AS id, user_id, 'discuss' AS action, parent_id FROM {turns} UNION ALL SELECT msg_id * 10 + 1, user_id, 'edit', msg_id FROM {turns} WHERE role = 'assistant' UNION ALL SELECT msg_id * 10 + 2, user_id, 'delete', msg_id FROM {turns} WHERE role = 'system'")
operator("l07_action_inference", "SELECT event_id, CASE WHEN event_type = 'signup' THEN 'report' WHEN event_type = 'error' THEN 'revert' WHEN cast(@json(props, '$.k') as bigint) > 50 THEN 'edit' ELSE 'discuss' END AS action FROM {events}")
# Markers of disagreement; ` stands for an apostrophe.
DISAGREE = ("i disagree", "i don`t think", "i`d argue", "actually,", "but ", "however ", "that`s not", "you`re wrong", "not necessarily", "on the contrary", "the problem with")
_SAID = "SELECT msg_id, parent_id IS NULL AS top, length(text) AS n, replace(lower(trim(text)), @char(39), '`') AS said FROM {turns}"
operator("l10_counter_argument", f"SELECT msg_id, n >= 20 AND (marks >= 2 OR (top AND marks >= 1)) AS counter FROM (SELECT msg_id, top, n, {' + '.join(f"CASE WHEN @contains(said, '{m}') THEN 1 ELSE 0 END" for m in DISAGREE)} AS marks FROM ({_SAID}) s) m",
         check=f"SELECT msg_id, CASE WHEN n < 20 THEN false ELSE len(list_filter({list(DISAGREE)}, lambda m: strpos(said, m) > 0)) >= CASE WHEN top THEN 1 ELSE 2 END END AS counter FROM ({_SAID}) s")
operator("l12_source_quota", "SELECT community, msg_id FROM (SELECT community, msg_id, row_number() OVER (PARTITION BY community ORDER BY seq) AS k FROM {messages}) x WHERE k <= @div(200, 5)")
operator("l13_year_pruning", "SELECT msg_id, round FROM {messages} WHERE round IN (1, 3, 5)")
operator("l14_thread_filter", "SELECT thread_id, @n(count(*)) AS n, @n(count(DISTINCT user_id)) AS people FROM {messages} GROUP BY thread_id HAVING count(*) >= 3 AND count(DISTINCT user_id) >= 2")
operator("l15_user_history", "SELECT user_id, msg_id, @n(row_number() OVER (PARTITION BY user_id ORDER BY ts, msg_id)) AS place FROM {messages}")

_RR = "k AS (SELECT round, thread_id, msg_id, row_number() OVER (PARTITION BY round, thread_id ORDER BY seq) AS i FROM {messages})"
operator("x01_stratified_sample", f"WITH {_RR} SELECT msg_id, round FROM k ORDER BY i, round, thread_id, msg_id LIMIT 200")
operator("w09_round_robin", f"WITH {_RR} SELECT msg_id, @n(row_number() OVER (ORDER BY i, round, thread_id, msg_id)) AS place FROM k")
operator("x02_thread_sample", "WITH k AS (SELECT thread_id, msg_id, row_number() OVER (PARTITION BY thread_id ORDER BY seq, msg_id) AS i FROM {turns} WHERE trim(text) <> '') SELECT msg_id FROM k ORDER BY i, thread_id LIMIT 150")
_T = "t AS (SELECT thread_id, count(*) AS n, count(DISTINCT user_id) AS p, max(toxicity) AS tox, avg(CASE WHEN action = 'revert' THEN 1.0 ELSE 0.0 END) AS rev FROM {messages} GROUP BY thread_id)"
operator("x03_representative_threads", f"WITH {_T} SELECT thread_id, @n(n) AS n, @n(p) AS people FROM t ORDER BY n DESC, p DESC, thread_id LIMIT 20")
operator("x04_negative_cases", f"WITH {_T} SELECT thread_id FROM t WHERE n < 3 OR p < 2")
operator("x05_controversial", f"WITH {_T}, r AS (SELECT thread_id, row_number() OVER (ORDER BY p DESC, n DESC, thread_id) AS k, count(*) OVER () AS c FROM t) SELECT thread_id FROM r WHERE k <= greatest(@div(c, 5), 5)")
operator("x06_conflict_tuple", f"WITH {_T} SELECT thread_id, @r6(tox) AS max_toxicity, @r6(rev) AS revert_share, @n(n) AS n FROM t")
operator("x07_annotation_candidates", """
WITH s AS (SELECT thread_id, avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END) AS a, count(*) AS n, count(DISTINCT user_id) AS p FROM {texts} GROUP BY thread_id)
SELECT thread_id, @r6(CASE WHEN a > 0 THEN 2.0 ELSE 0.0 END + CASE WHEN a >= 0.1 AND a <= 0.5 THEN 1.5 ELSE 0.0 END) AS score FROM s WHERE n >= 2 AND p >= 2 ORDER BY CASE WHEN a > 0 THEN 2.0 ELSE 0.0 END + CASE WHEN a >= 0.1 AND a <= 0.5 THEN 1.5 ELSE 0.0 END DESC, thread_id LIMIT 50""")
operator("x08_continuation_split", """
WITH e AS (SELECT m.thread_id, max(least(m.idx, p.idx)) AS latest FROM {messages} m JOIN {messages} p ON p.thread_id = m.thread_id AND p.msg_id = m.parent_id GROUP BY m.thread_id),
t AS (SELECT thread_id, count(*) AS n, coalesce(max(CASE WHEN action <> 'discuss' THEN idx END), -1) AS event FROM {messages} GROUP BY thread_id),
s AS (SELECT t.thread_id, t.n, least(t.n - 2, e.latest) AS top, least(t.n - 2, e.latest, t.event) AS preferred FROM t JOIN e ON t.thread_id = e.thread_id WHERE least(t.n - 2, e.latest) >= 2)
SELECT thread_id, @n(greatest(2, least(@div(n, 2), CASE WHEN preferred >= 2 THEN preferred ELSE top END))) AS split FROM s""",
         check="""
WITH o AS (SELECT thread_id, msg_id, parent_id, action, row_number() OVER (PARTITION BY thread_id ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY thread_id) AS n FROM {messages}),
c AS (SELECT DISTINCT thread_id, n, unnest(range(2, n - 1)) AS s FROM o),
l AS (SELECT c.*, EXISTS (SELECT 1 FROM o WHERE o.thread_id = c.thread_id AND o.i >= c.s AND o.action <> 'discuss') AS event FROM c
  WHERE EXISTS (SELECT 1 FROM o a JOIN o b ON a.thread_id = b.thread_id AND a.parent_id = b.msg_id WHERE a.thread_id = c.thread_id AND a.i >= c.s AND b.i >= c.s)),
r AS (SELECT thread_id, s, row_number() OVER (PARTITION BY thread_id ORDER BY event DESC, abs(s - n / 2), s) AS k FROM l) SELECT thread_id, @n(s) AS split FROM r WHERE k = 1""")  # fmt: skip
operator("x09_stimulus_selection", f"WITH {_T}, r AS (SELECT thread_id, rev > 0 AS event, row_number() OVER (PARTITION BY rev > 0 ORDER BY rev DESC, tox DESC, n DESC, md5(concat('7|', cast(thread_id as varchar(20))))) AS k FROM t) SELECT thread_id, event FROM r WHERE (event AND k <= 12) OR (NOT event AND k <= 8)")
operator("x11_seeded_cap", "SELECT thread_id FROM (SELECT DISTINCT thread_id FROM {messages}) x ORDER BY md5(concat('42|', cast(thread_id as varchar(20)))) LIMIT 50")
operator("x10_blind_samples", """
WITH f AS (SELECT thread_id, user_id, min(seq) AS s FROM {turns} GROUP BY thread_id, user_id), l AS (SELECT thread_id, user_id, row_number() OVER (PARTITION BY thread_id ORDER BY s) AS i FROM f),
c AS (SELECT thread_id, row_number() OVER (ORDER BY md5(concat('9|', cast(thread_id as varchar(20))))) AS k FROM (SELECT DISTINCT thread_id FROM {turns}) x)
SELECT l.thread_id, l.user_id, concat('User_', @char(@int(64 + l.i))) AS alias FROM l JOIN c ON l.thread_id = c.thread_id WHERE c.k <= 20""")
operator("x12_length_strata", """
WITH q AS (SELECT @percentile(length(text), 0.2) AS a, @percentile(length(text), 0.4) AS b, @percentile(length(text), 0.6) AS c, @percentile(length(text), 0.8) AS d FROM {texts}),
s AS (SELECT msg_id, CASE WHEN length(text) <= a THEN 0 WHEN length(text) <= b THEN 1 WHEN length(text) <= c THEN 2 WHEN length(text) <= d THEN 3 ELSE 4 END AS bin FROM {texts} CROSS JOIN q),
r AS (SELECT msg_id, bin, row_number() OVER (PARTITION BY bin ORDER BY md5(concat('3|', cast(msg_id as varchar(20))))) AS k FROM s) SELECT msg_id, @n(bin) AS bin FROM r WHERE k <= 20""")
operator("x13_toxicity_pools", """
WITH p AS (SELECT leaf, msg_id, coalesce(toxic, 0) AS hi, row_number() OVER (PARTITION BY leaf, coalesce(toxic, 0) ORDER BY msg_id) AS k FROM {texts}), n AS (SELECT leaf, least(sum(hi), 7) AS high FROM p GROUP BY leaf)
SELECT p.leaf, p.msg_id FROM p JOIN n ON p.leaf = n.leaf WHERE (hi = 1 AND k <= high) OR (hi = 0 AND k <= 15 - high)""")
operator("x15_evidence_budgets", "WITH e AS (SELECT leaf, msg_id, CASE WHEN quality = 0 THEN 'delete' WHEN toxic = 1 THEN 'attack' WHEN length(text) > 4000 THEN 'tox' END AS kind FROM {texts}), k AS (SELECT *, row_number() OVER (PARTITION BY leaf, kind ORDER BY msg_id) AS k FROM e WHERE kind IS NOT NULL) SELECT leaf, kind, msg_id FROM k WHERE k <= CASE kind WHEN 'delete' THEN 13 WHEN 'tox' THEN 10 ELSE 2 END")
operator("x16_distinct_topics", "WITH o AS (SELECT topic, thread_id, row_number() OVER (PARTITION BY topic ORDER BY md5(concat('5|', cast(thread_id as varchar(20))))) AS k FROM (SELECT DISTINCT topic, thread_id FROM {messages}) x) SELECT topic, thread_id FROM o WHERE k = 1")
operator("x19_top_actions", "WITH c AS (SELECT community, action, count(*) AS n FROM {messages} GROUP BY community, action), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, action) AS k FROM c) SELECT community, action, @n(n) AS n FROM r WHERE k <= 3")
operator("x20_oldest_events", "WITH k AS (SELECT thread_id, msg_id, row_number() OVER (PARTITION BY thread_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY thread_id) AS n FROM {turns}) SELECT msg_id FROM k WHERE i <= least(3, n - 3)")

operator("z01_importance", "SELECT msg_id, @r6(1.0 + CASE WHEN length(text) > 200 THEN 0.5 ELSE 0.0 END + CASE WHEN role = 'system' THEN 1.0 ELSE 0.0 END) AS importance FROM {turns}")
operator("z02_fan_out", "WITH a AS (SELECT thread_id, user_id, count(*) AS own FROM {messages} GROUP BY thread_id, user_id), t AS (SELECT thread_id, count(*) AS n FROM {messages} GROUP BY thread_id) SELECT a.thread_id, a.user_id, @n(n - own) AS observed FROM a JOIN t ON a.thread_id = t.thread_id")
operator("z03_thread_history", "SELECT thread_id, msg_id FROM {turns} WHERE role = 'user'")
operator("z04_agent_state", "SELECT user_id, @n(count(*)) AS sent, @n(sum(CASE WHEN action = 'revert' THEN 1 ELSE 0 END)) AS violations, @join_sorted(action, ',') AS actions FROM {messages} GROUP BY user_id")
operator("z05_member_blocks", "WITH f AS (SELECT user_id, min(msg_id) AS first FROM {turns} GROUP BY user_id), n AS (SELECT user_id, dense_rank() OVER (ORDER BY first) AS ordinal FROM f) SELECT n.ordinal, @n(count(*)) AS n_lines FROM {turns} t JOIN n ON t.user_id = n.user_id GROUP BY n.ordinal")
operator("z06_prompt_packing", "WITH c AS (SELECT thread_id, msg_id, row_number() OVER (PARTITION BY thread_id ORDER BY seq) AS k, sum(least(length(text), 400)) OVER (ORDER BY thread_id, seq) AS used FROM {turns}) SELECT msg_id FROM c WHERE k <= 30 AND used <= 30000")
operator("z09_turn_truncation", "SELECT @n(count(*)) AS kept, @n(max(round * 100000 + idx)) AS last_turn FROM {messages} WHERE round < 10 OR (round = 10 AND idx <= 2)")
operator("z12_year_presence", "SELECT user_id, @join_sorted(cast(round % 3 as varchar(4)), ',') AS years FROM {messages} GROUP BY user_id")
operator("z15_applied_actions", "WITH l AS (SELECT thread_id, max(seq) AS s FROM {messages} GROUP BY thread_id) SELECT m.thread_id, m.msg_id + 1000000 AS msg_id, m.msg_id AS parent_id FROM {messages} m JOIN l ON m.thread_id = l.thread_id AND m.seq = l.s")
operator("z18_failure_trips", "WITH f AS (SELECT user_id, seq, CASE WHEN action IN ('revert', 'report') THEN 1 ELSE 0 END AS bad FROM {messages}), g AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY seq) AS island FROM f), r AS (SELECT user_id, island, sum(bad) AS run FROM g GROUP BY user_id, island) SELECT user_id, @n(max(run)) AS longest_run, max(run) >= 5 AS tripped FROM r GROUP BY user_id")
