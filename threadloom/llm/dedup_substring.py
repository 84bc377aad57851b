"""Substring dedup: words covered by a repeated window of ``WINDOW`` words.

Every window gets a Rabin-Karp hash, and hashes are counted in Spark.  To count all of them
as rows would move far more than the text, so windows are counted in groups that equal
windows share.  A window's *anchor* is the least hash among its ``GRAM``-word grams; equal
windows have equal anchors, and the windows around one place of a text form a run of one
anchor, so there are about 14 times fewer anchors than windows.

1. One scan gives each document's anchors and the hash of its words.  Documents with equal
   texts form a class; a class of two or more is repeated throughout, and one member
   stands for it from here on.
2. Anchors are counted.  One that occurs once holds no repeated window.  The most frequent, at most
   ``HOT``, go back to their texts by a broadcast, the others by a shuffle.
3. The texts that have repeated anchors send the window hashes of those runs, grouped by
   anchor.  Windows that a task already saw twice are settled there and announced once, so
   a passage that half of all documents share doesn't pile up in a task.  The counts
   come from sorted streams, an anchor at a time.  Anchors with over ``HUGE`` occurrences are
   split further by window hash.
4. Repeated windows go back to their documents, merge into maximal intervals, and those go.

Defined results: a null text has no words; fewer than 35 words lose nothing; repeated rows
lose all their words if they have 35; very long texts count whole; ids may be null or repeat; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.held import held
from threadloom.llm.words import Words, blocks, mix, sliding_min
from threadloom.workspace import materialize, small_batches

WINDOW, GRAM, HUGE, HOT = 35, 8, 100_000, 1024
#: Bytes of window hashes that the counting step holds at a time, beyond one anchor's.
HELD = 16 << 20
U = np.uint64


class Runs:
    """Runs of windows by anchor for a block of texts."""

    def __init__(self, words: Words, window: int, gram: int):
        grams, _, of = words.windows(gram)
        per = np.maximum(np.diff(words.of) - window + 1, 0)
        self.of = np.concatenate(([0], np.cumsum(per)))  # windows by text
        self.doc = np.repeat(np.arange(len(per)), per)
        n = int(self.of[-1])
        self.start = self.anchor = self.length = np.empty(0, np.int64)
        if not n:
            return
        span = window - gram + 1
        bits = max(int(len(grams)).bit_length(), 1)
        # the place in the low bits: least hash first, leftmost place on ties
        placed = (grams >> U(bits) << U(bits)) | np.arange(len(grams), dtype=np.uint64)
        first = np.arange(n) - np.repeat(self.of[:-1] - of[:-1], per)  # its first gram
        place = (sliding_min(placed, span)[first] & U((1 << bits) - 1)).astype(np.int64)
        begins = np.ones(n, bool)
        begins[1:] = (place[1:] != place[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.start = np.flatnonzero(begins)
        self.length = np.diff(np.append(self.start, n))
        self.anchor = grams[place[self.start]].view(np.int64)


def _scan(window: int, gram: int):
    def scan(batches):
        held(None)
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column("text")):
                words = Words(data, offsets)
                runs = Runs(words, window, gram)
                cut = np.searchsorted(runs.start, runs.of)
                raw, anchors = data.tobytes(), runs.anchor.tobytes()
                sha = [hashlib.sha256(b" ".join(raw[x:y].split())).digest() for x, y in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("g").slice(a, b - a), pa.array(np.diff(words.of)), pa.array(sha, pa.binary()),
                     pa.array([anchors[x * 8 : y * 8] for x, y in zip(cut, cut[1:], strict=False)], pa.binary())],
                    names=["doc_id", "g", "n_words", "sha", "anchors"],
                )

    return scan


def _anchors(batches):
    """A row for each anchor of each class."""
    for batch in batches:
        lists = batch.column("anchors").to_pylist()
        for i in range(0, len(lists), 256):
            part = lists[i : i + 256]
            sizes = np.array([len(x) // 8 for x in part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(b"".join(part), np.int64)), batch.column("g").take(pa.array(np.repeat(np.arange(i, i + len(part)), sizes)))], names=["anchor", "g"]
            )


def _send(window: int, gram: int):
    def send(batches):
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column("text"), 1 << 20):
                words = Words(data, offsets)
                runs = Runs(words, window, gram)
                hashes, _, _ = words.windows(window)
                live = batch.column("live").slice(a, b - a)
                huge = batch.column("huge").slice(a, b - a)

                def owned(lists):
                    sizes = np.diff(lists.offsets.to_numpy())
                    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    return mix(flat ^ mix(np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64)))

                mine = mix(runs.anchor.view(np.uint64) ^ mix(runs.doc[runs.start].astype(np.uint64)))
                chosen = np.flatnonzero(np.isin(mine, owned(live)))
                if not len(chosen):
                    continue
                anchor, start, length = runs.anchor[chosen], runs.start[chosen], runs.length[chosen]
                split = np.isin(mine[chosen], owned(huge))
                if split.any():  # a run of its own for each window, keyed by the window
                    parts = np.repeat(np.arange(len(chosen)), np.where(split, length, 1))
                    nth = np.arange(len(parts)) - np.searchsorted(parts, parts)
                    start = np.where(split[parts], start[parts] + nth, start[parts])
                    length = np.where(split[parts], 1, length[parts])
                    anchor = np.where(split[parts], mix(hashes[start]).view(np.int64), anchor[parts])
                own = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
                sent = hashes[own]
                _, where, times = np.unique(sent, return_inverse=True, return_counts=True)
                edge = np.concatenate(([0], np.cumsum(length)))
                settled = np.minimum.reduceat(times[where], edge[:-1]) >= 2
                sign = np.add.reduceat(mix(sent), edge[:-1])
                tells = np.zeros(len(settled), bool)
                known = np.flatnonzero(settled)
                tells[known[np.unique(sign[known], return_index=True)[1]]] = True
                doc = runs.doc[start]
                alone = batch.column("m").slice(a, b - a).to_numpy()[doc] == 1
                payload = sent.tobytes()

                def rows(pick, key, done, weight, refer):
                    return pa.RecordBatch.from_arrays(
                        [pa.array(key[pick]), batch.column("g").slice(a, b - a).take(pa.array(doc[pick])), pa.array((start - runs.of[doc])[pick].astype(np.int32)),
                         pa.array(length[pick].astype(np.int32)), pa.array([b"" if done else payload[edge[i] * 8 : edge[i + 1] * 8] for i in pick], pa.binary()),
                         pa.array(np.broadcast_to(weight, len(anchor))[pick].astype(np.int32)), pa.array(np.broadcast_to(refer, len(anchor))[pick])],
                        names=["anchor", "g", "first", "length", "hashes", "weight", "refers"],
                    )

                yield rows(np.flatnonzero(~settled), anchor, False, np.where(alone, 1, 2), alone)
                yield rows(np.flatnonzero(tells), anchor, False, 2, False)
                # settled here, nothing to count: text and place spread them, as equal runs may be most of all rows
                text = np.frombuffer(b"".join(batch.column("g").slice(a, b - a).to_pylist()), np.uint64)[::2]
                yield rows(np.flatnonzero(settled & alone), mix(text[doc] ^ mix((start - runs.of[doc]).astype(np.uint64))).view(np.int64), True, 0, True)

    return send


SENT = "anchor long, g binary, first int, length int, hashes binary, weight int, refers boolean"


def _count(batches):
    """Windows counted an anchor at a time, from rows sorted by anchor."""

    def settle(table: pa.Table):
        table = table.combine_chunks()
        length = table.column("length").to_numpy().astype(np.int64)
        blobs = table.column("hashes").to_pylist()
        here = np.array([len(x) > 0 for x in blobs])
        full = (np.int64(1) << length) - 1
        mask = np.where(here, 0, full)
        at = np.flatnonzero(here)
        if len(at):
            sent = np.frombuffer(b"".join(blobs), np.uint64)
            size = length[at]
            weight = np.repeat(table.column("weight").to_numpy()[at], size)
            _, where = np.unique(sent, return_inverse=True)
            again = np.bincount(where, weight)[where] >= 2
            edge = np.concatenate(([0], np.cumsum(size)[:-1]))
            bit = np.int64(1) << (np.arange(len(sent)) - np.repeat(edge, size))
            mask[at] = np.add.reduceat(np.where(again, bit, 0), edge)
        pick = np.flatnonzero((mask != 0) & table.column("refers").to_numpy())
        out = table.select(["g", "first"]).take(pa.array(pick)).append_column("mask", pa.array(mask[pick]))
        return out.combine_chunks().to_batches()

    held, size, enough = [], 0, HELD
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < enough:
            continue
        whole = pa.Table.from_batches(held)
        anchors = whole.column("anchor").to_numpy()
        cut = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on
        if cut:
            yield from settle(whole.slice(0, cut))
        held = whole.slice(cut).combine_chunks().to_batches()
        size = sum(b.nbytes for b in held)
        enough = HELD + size
    if held:
        yield from settle(pa.Table.from_batches(held))


def _remove(window: int):
    nothing = hashlib.sha256(b"").hexdigest()

    def remove(batches):
        for batch in batches:
            out = []
            for id_, text, runs in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("runs"), strict=True):
                words = (text or b"").split()
                first = runs.values.field("first").to_numpy(zero_copy_only=False).astype(np.int64)
                mask = runs.values.field("mask").to_numpy(zero_copy_only=False)
                bit = np.arange(64)[None, :]
                row, nth = np.nonzero((mask[:, None] >> bit) & 1)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, first[row] + nth, 1)
                np.add.at(edge, first[row] + nth + window, -1)
                keep = np.cumsum(edge[:-1]) == 0
                kept = b" ".join([words[i] for i in np.flatnonzero(keep)])
                out.append((id_, len(words), len(words) - int(keep.sum()), hashlib.sha256(kept).hexdigest() if kept else nothing))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return remove


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, huge: int = HUGE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("id"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("g"), F.coalesce("text", F.lit("")).alias("text"))
    scanned = materialize(texts.select("doc_id", "g", "text").mapInArrow(_scan(window, gram), "doc_id long, g binary, n_words long, sha binary, anchors binary"), "anchors")
    classes = scanned.groupBy("g").agg(F.count("*").alias("m"), F.min(F.coalesce("doc_id", F.lit(-1))).alias("id"))
    one = scanned.where(F.length("anchors") > 0).groupBy("g").agg(F.any_value("anchors").alias("anchors"))
    each = one.mapInArrow(_anchors, "anchor long, g binary")
    often = materialize(each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "often")
    # anchors of over 1/HOT of all occurrences, at most HOT, are met on the map side; the others can't fill a task
    total = often.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(materialize(often.where(F.col("n") * HOT > total), "hot"))
    met = each.join(hot, "anchor").unionByName(each.join(hot, "anchor", "left_anti").join(often, "anchor"))
    live = (
        met.groupBy("g")
        .agg(F.collect_list("anchor").alias("live"), F.collect_list(F.when(F.col("n") > huge, F.col("anchor"))).alias("huge"))
        .join(classes, "g")
    )
    sent = texts.select("id", "g", "text").join(live, ["g", "id"]).select("g", "text", "live", "huge", "m").mapInArrow(_send(window, gram), SENT)
    found = sent.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_count, "g binary, first int, mask long")
    answers = materialize(found.groupBy("g").agg(F.collect_list(F.struct("first", "mask")).alias("runs")).join(classes.select("g", "id"), "g"), "repeats")
    cut = texts.join(answers, ["g", "id"]).select("doc_id", "text", "runs").mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    rest = scanned.select("doc_id", "g", "n_words", "sha").join(answers.select("g"), "g", "left_anti").join(classes.select("g", "m"), "g")
    gone = (F.col("m") > 1) & (F.col("n_words") >= window)
    rest = rest.select(
        "doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(0).alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"),
    )
    return cut.unionByName(rest)


def op9_dedup_substring(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
