"""Canonical tables, derived from the driver's tables.

Operators read these, whatever they were made of: a user's own frames with the same columns
do as well.  Each is a query over source tables, written once for both engines.
"""

from __future__ import annotations

#: name -> (source tables, body)
CANONICAL: dict[str, tuple[tuple[str, ...], str]] = {
    # threaded messages of the event table: a binary reply tree in each (k, day)
    "messages": (
        ("events",),
        """
        WITH b AS (SELECT event_id, cast(@json(props, '$.k') as bigint) AS k, cast(@json(props, '$.k') as bigint) * 100 + day(ts) AS thread_id, user_id, ts, event_type, value FROM {events}),
        i AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ts, event_id) - 1 AS idx FROM b)
        SELECT i.event_id AS msg_id, i.thread_id, i.event_id AS seq, i.idx AS idx, i.user_id, i.ts AS ts, p.event_id AS parent_id,
          CASE i.event_type WHEN 'view' THEN 'discuss' WHEN 'click' THEN 'edit' WHEN 'error' THEN 'revert' WHEN 'signup' THEN 'report' ELSE 'restore' END AS action,
          least(i.value / 100, 1.0) AS toxicity, least(i.value / 100, 1.0) * least(i.value / 100, 1.0) AS severe_toxicity, i.idx AS indentation, i.k AS topic,
          CASE i.thread_id % 4 WHEN 0 THEN 'talk' WHEN 1 THEN 'user_talk' WHEN 2 THEN 'wikipedia_talk' ELSE 'other' END AS page_type,
          day(i.ts) - 1 AS round, CASE WHEN i.user_id % 2 = 0 THEN 'real' ELSE 'sim' END AS side, i.user_id % 5 AS community
        FROM i LEFT JOIN i p ON p.thread_id = i.thread_id AND i.idx > 0 AND p.idx = @div((i.idx - 1), 2)
        """,
    ),
    # turns of conversations: each replies to the one before
    "turns": (
        ("conversations",),
        """
        SELECT c.conv_id AS thread_id, c.conv_id * 100 + c.turn AS msg_id, c.turn AS seq, CASE WHEN p.turn IS NOT NULL THEN c.conv_id * 100 + p.turn END AS parent_id,
          (c.conv_id * 31 + c.turn) % 40 AS user_id, c.role AS role, coalesce(c.text, '') AS text
        FROM {conversations} c LEFT JOIN {conversations} p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
        """,
    ),
    # labelled documents
    "texts": (
        ("documents", "labels"),
        """
        SELECT d.doc_id AS msg_id, @div(d.doc_id, 10) AS thread_id, d.source AS user_id, d.lang AS platform, coalesce(d.text, '') AS text, d.source AS leaf, l.toxic AS toxic, l.quality AS quality
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
        """,
    ),
    # vectors, a row for each component
    "vectors": (
        ("embeddings",),
        """
        SELECT vec_id AS user_id, label AS leaf, i AS dim, @f(@get(embedding, i)) AS x FROM (SELECT vec_id, label, embedding, @explode(@range(0, 63)) AS i FROM {embeddings}) e
        """,
    ),
    # condition by metric results: one row for each cell of the grid
    "results": (
        ("orders", "customer"),
        """
        SELECT o_orderpriority AS condition, c_mktsegment AS dataset, 'm' AS model, o_orderkey % 10 AS repeat, count(*) AS message_count,
          avg(@f(o_totalprice)) / 400000 AS action_distance, stddev_pop(@f(o_totalprice)) / 400000 AS interaction_distance,
          avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS language_distance, avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END) AS safe_rate,
          avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END) AS consistency
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY o_orderpriority, c_mktsegment, o_orderkey % 10
        """,
    ),
}
