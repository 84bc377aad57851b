"""Louvain communities of a weighted graph, round by round on DataFrames.

A level has edges (u < v, w), loops of nodes that stand for several, and a label for each node.  A
round weighs the best move of every node by joins.  Nodes that gain are dealt into blocks of some ``ENDS``
edge ends; each block moves its nodes one after the other to where the modularity gains most, as if
the other blocks stood still.  What room one block leaves, nodes that nearly gain fill: moves of the first
make them gain, and they follow in the same round.  A single block is exact.  Of several, a random half of the
moved nodes move at once, since they don't see each other; when the modularity, measured anew, doesn't grow by
that, a quarter does, and so on, and at last a single block.  So it grows in every round, and the number of rounds is
not fixed: a level ends when no move of any node gains, then communities become the nodes of the next level, and all
ends with a level without moves.  A node with more than ``ENDS`` ends is a block by itself, moved as it was weighed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.operators.registry import register
from threadloom.operators.sqlop import apply, canonical
from threadloom.workspace import discard, materialize

#: Least gain in modularity that is a gain.
LEAST = 1e-9
#: Edge ends of a block (expected), and of the largest node that is in one with others.
ENDS = 1 << 22


def _ends(edges: DataFrame) -> DataFrame:
    """Both directions of each edge that isn't a loop."""
    apart = edges.where("u <> v")
    return apart.select("u", "v", "w").union(apart.select("v", "u", "w"))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Q of ``labels`` (node, label) on ``edges`` (u, v, w), loops counting twice for their node."""
    a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label")) for x in "uv")
    known = edges.join(a, "u").join(b, "v")
    inside = known.select(F.col("u_label").alias("c"), F.when(F.col("u_label") == F.col("v_label"), F.col("w")).otherwise(0.0).alias("i"), F.col("w").alias("k"))
    both = inside.union(known.select("v_label", F.lit(0.0), "w"))
    of = both.groupBy("c").agg(F.sum("i").alias("i"), F.sum("k").alias("k"))
    row = of.agg(F.sum("i"), F.sum(F.col("k") * F.col("k")), F.sum("k")).first()
    inside_, squares, twice = row
    return 2 * inside_ / twice - squares / (twice * twice) if twice else 0.0


def _best(ends: DataFrame, of: DataFrame, twice: float) -> DataFrame:
    """(node, label, k, total, n, met, to, gain): each node's best move to another of the communities it has met, gain or loss, ties to the least."""
    sent = ends.join(of.select(F.col("node").alias("v"), F.col("label").alias("to")), "v").groupBy(F.col("u").alias("node"), "to").agg(F.sum("w").alias("sent"))
    known = sent.join(of, "node").join(of.select(F.col("label").alias("to"), F.col("total").alias("to_total")).distinct(), "to")
    score = F.when(F.col("to") != F.col("label"), F.struct((F.col("sent") - F.col("k") * F.col("to_total") / twice).alias("score"), (-F.col("to")).alias("to")))
    own = F.coalesce(F.max(F.when(F.col("to") == F.col("label"), F.col("sent"))), F.lit(0.0))
    best = known.groupBy("node", "label", "k", "total", "n").agg(F.max(score).alias("m"), own.alias("own"), F.count("*").alias("met")).where("m is not null")
    gain = 2 * (F.col("m.score") - F.col("own") + F.col("k") * (F.col("total") - F.col("k")) / twice) / twice
    return best.select("node", "label", "k", "total", "n", "met", (-F.col("m.to")).alias("to"), gain.alias("gain"))


def _moved(labels: DataFrame, moves: DataFrame) -> DataFrame:
    return materialize(labels.join(moves.select("node", "to"), "node", "left").select("node", F.coalesce("to", "label").alias("label")), "louvain")


def _settle(node: np.ndarray, k: list[float], label: np.ndarray, total: list[float], first: np.ndarray, near: np.ndarray, weight: np.ndarray, twice: float) -> None:
    """Move nodes in turn, in place, until none gains whose neighbours moved.

    ``label`` holds the nodes' communities, then all communities in order: an end at ``near`` is a node of the block, or a community outside.
    """
    n, first = len(node), first.tolist()
    due = np.ones(n, bool)
    while due.any():
        for u in np.flatnonzero(due).tolist():
            due[u] = False
            at = near[first[u] : first[u + 1]]
            sent: dict[int, float] = {}
            for c, w in zip(label[at].tolist(), weight[first[u] : first[u + 1]].tolist()):
                sent[c] = sent.get(c, 0.0) + w
            own, share = int(label[u]), k[u] / twice
            stay, best, to = sent.pop(own, 0.0) - share * (total[own] - k[u]), -math.inf, -1
            for c, w in sent.items():
                score = w - share * total[c]
                if score > best or score == best and c < to:
                    best, to = score, c
            if 2 * (best - stay) / twice > LEAST:
                label[u] = to
                total[own] -= k[u]
                total[to] += k[u]
                due[at[at < n]] = True


def _moves(ends: DataFrame, of: DataFrame, who: DataFrame, twice: float, merge: bool) -> DataFrame:
    """(block, node, to): where each block's nodes of ``who`` (node, block) end when they move in turn and all others stay.

    With ``merge``, a node's ends at one community outside its block become one before they go to Python.
    """

    def settle(rows: pa.Table) -> pa.Table:
        u, v, w, name, total, inside = (rows[c].to_numpy() for c in ("u", "v", "w", "label", "total", "inside"))
        names, place = np.unique(name, return_inverse=True)
        totals = np.zeros(len(names))
        totals[place] = total
        of_node = np.flatnonzero(inside & (u == v))
        of_node = of_node[np.argsort(u[of_node])]
        node, k, start = u[of_node], w[of_node], place[of_node]
        end = np.flatnonzero(~inside | (u != v))
        n, size = len(node), len(node) + len(names)
        slot = np.where(inside[end], np.searchsorted(node, v[end]), n + place[end])
        key, back = np.unique(np.searchsorted(node, u[end]) * size + slot, return_inverse=True)  # ends of one node at one community outside are one
        weight, near, first = np.bincount(back, weights=w[end]), key % size, np.searchsorted(key, np.arange(n + 1) * size)
        label = np.concatenate([start, np.arange(len(names))])
        del u, v, w, name, total, inside, place, end, slot, key, back
        _settle(node, k.tolist(), label, totals.tolist(), first, near, weight, twice)
        moved = label[:n] != start
        block = np.full(moved.sum(), rows["block"][0].as_py(), "int64")
        return pa.table({"block": block, "node": node[moved], "to": names[label[:n][moved]]})

    inside = F.coalesce(F.col("v_block") == F.col("block"), F.lit(False))
    far = ends.join(who.select(F.col("node").alias("u"), "block"), "u").join(of.select(F.col("node").alias("v"), "label", "total"), "v").join(who.select(F.col("node").alias("v"), F.col("block").alias("v_block")), "v", "left")
    far = far.select("block", "u", F.when(inside, F.col("v")).otherwise(F.col("u")).alias("v"), "w", "label", "total", inside.alias("inside"))
    if merge:
        far = far.groupBy("u", "block", "v", "label", "total", "inside").agg(F.sum("w").alias("w")).select(far.columns)
    self_ = who.join(of, "node").select("block", F.col("node").alias("u"), F.col("node").alias("v"), F.col("k").alias("w"), "label", "total", F.lit(True).alias("inside"))
    return far.union(self_).groupBy("block").applyInArrow(settle, "block long, node long, to long")


def _nearly(best: DataFrame, room: int) -> float:
    """The least gain at which nodes of ``room`` ends at most, whose best move doesn't gain, are over it."""
    step = F.ceil(16 * F.log2(F.greatest(-F.col("gain"), F.lit(1e-30)))).cast("int")
    cut = LEAST
    for at, n in best.where(F.col("gain") <= LEAST).groupBy(step).agg(F.sum("n")).orderBy(step).collect():
        room -= n
        if room < 0:
            break
        cut = -(2.0 ** (at / 16)) * (1 + 1e-9)
    return cut


def local_moves(edges: DataFrame) -> DataFrame | None:
    """(node, label) when no node gains any more; None if none ever did."""
    ends = materialize(_ends(edges).repartition("u"), "ends")  # so that few sums of a node's ends are shuffled
    degree = edges.select(F.col("u").alias("node"), "w", (F.col("u") != F.col("v")).cast("long").alias("n")).union(edges.select("v", "w", (F.col("u") != F.col("v")).cast("long")))
    nodes = materialize(degree.groupBy("node").agg(F.sum("w").alias("k"), F.sum("n").alias("n")), "degrees")
    twice = nodes.agg(F.sum("k")).first()[0]
    labels = materialize(nodes.select("node", F.col("node").alias("label")), "louvain")
    q, turn, any_, share = modularity(edges, labels), 0, False, 0.5
    while True:
        of = nodes.join(labels, "node")
        of = materialize(of.join(of.groupBy("label").agg(F.sum("k").alias("total")), "label"), "known")
        best = materialize(_best(ends, of, twice), "best")
        gains, large = F.col("gain") > LEAST, F.col("n") > ENDS
        some, willing, met, all_ = best.agg(F.count(F.when(gains, 1)), F.sum(F.when(gains & ~large, F.col("n"))), F.sum("met"), F.sum("n")).first()
        if not some:
            discard(of), discard(best)
            return labels if any_ else None
        willing = willing or 0
        blocks = max(1, -(-willing // ENDS))
        cut = _nearly(best.where(~large), ENDS - willing) if 0 < willing < ENDS else LEAST
        turn += 1
        who = best.where(~large & (F.col("gain") > cut)).select("node", F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(blocks)).alias("block"))
        moves = _moves(ends, of, who, twice, 2 * met < all_).union(best.where(large & gains).select((-F.col("node") - 1).alias("block"), "node", "to"))
        moves = materialize(moves, "moves")
        discard(of), discard(best)
        first, units = moves.agg(F.min("block"), F.countDistinct("block")).first()
        if first is None:  # gains on the border of ``LEAST``, by a sum in another order
            discard(moves)
            return labels if any_ else None
        place = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 30)) / (1 << 30)
        while True:
            single = share * (units + 1) <= 1 or units == 1
            tried = _moved(labels, moves.where((F.col("block") == first) if single else place < share))
            now = modularity(edges, tried)
            if now > q + LEAST or single:
                break
            discard(tried)
            share /= 2
        discard(moves)
        if now <= q + LEAST / 2:  # a sum in another order: nothing is left to gain
            discard(tried)
            return labels if any_ else None
        discard(labels)
        labels, q, any_, share = tried, now, True, min(0.5, share * 2)


def louvain(edges: DataFrame) -> DataFrame:
    """(node, community) of every node of ``edges`` (u, v, w); a community is named by its least node."""
    level = materialize(edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum(F.col("w").cast("double")).alias("w")), "graph")
    of = materialize(level.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("community")), "members")
    while not level.isEmpty():
        labels = local_moves(level)
        if labels is None:
            break
        of = materialize(of.join(labels.select(F.col("node").alias("community"), "label"), "community").select("node", F.col("label").alias("community")), "members")
        a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label")) for x in "uv")
        met = level.join(a, "u").join(b, "v")
        level = materialize(met.groupBy(F.least("u_label", "v_label").alias("u"), F.greatest("u_label", "v_label").alias("v")).agg(F.sum("w").alias("w")), "graph")
    least = of.groupBy("community").agg(F.min("node").alias("least"))
    return of.join(least, "community").select("node", F.col("least").alias("community"))


def g08_communities(spark, sf_dir: str) -> DataFrame:
    """Communities of the reply graph."""
    edges = apply("g01_reply_graph", messages=canonical(spark, sf_dir, "messages"))
    return louvain(edges).select(F.col("node").alias("user_id"), "community")


register("g08_communities", g08_communities)
