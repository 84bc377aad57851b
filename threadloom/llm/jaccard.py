"""Near-duplicate documents: exact Jaccard join on word shingles.

Documents are sets of distinct 5-word shingles (63-bit Rabin-Karp hashes).  Equal sets form a
class, and one member stands for it.  Two sets link when they share three quarters of their
union; only the components matter, so no group is ever expanded into its pairs.

1. Misra-Gries over all shingles finds the frequent ones (at most ``HEAVY + 1``, broadcast).
   Any order of shingles gives exact prefixes; rare before frequent gives small tiles.
2. One scan gives each set's size, a bitmap signature (parity of the shingles in each of
   512 cells), eight least hashes, its prefix and its sample.  Of two linked sets, the first
   shared shingle lies in the first n - ceil(3n/4) + 1 of either, and in the first
   n - ceil(6n/7) + 1 of the smaller.  The sample is the shingles whose hash is below
   ``SAMPLE``, and all of them in small sets.
3. A shingle that no other set has is *alone*.  A set that links with any other has at most
   n - ceil(3n/4) lone shingles, in its sample as well.  The samples are counted in
   partitions of the hash, and sets with more lone ones leave: exact, and linear in the text.
4. Sets left that agree in a least hash are compared with ``HUBS`` of their group, drawn by hash, and
   tested with the ``TRIES`` likeliest: linear in the group.  One hub would not do, since most sets of
   a group may not link with it; several join nearly all of a large group of near copies at once.
5. Tiles hold the rows of one prefix shingle and one band of sizes (a factor 4/3; larger
   sets come from the same band or the next).  Shingles that lie in one component only are
   left out first, by an aggregation, and of shingles that exactly the same sets have one stays.
   Within a tile, pairs from different components pass if sizes allow, and if the bits in which
   the signatures differ, a lower bound of the sets' difference, leave enough overlap.  Near sets
   share many shingles of their prefixes; a pair is made at the least one only, as far as the
   ``FIRST`` least of either tell, so that rows are few more than pairs.
6. What passes is decided by intersecting the sorted shingle arrays of the whole texts.
   Where there are more than ``TRIES`` candidates to a set, each set tries its likeliest first,
   whatever components they lead to, and those that are joined by then need no test; with fewer,
   a further round would cost more than the tests that it saves.  New links are added to the
   components as known, and none is found twice.

Defined results: null or empty texts have no shingles, are linked with nothing and are
components of their own; fewer than five words are one shingle; ids may be null or repeat;
very long texts count whole; an empty table gives an empty result; other columns, whatever
their names, are ignored (``keep_one`` carries them along).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from threadloom.llm.components import components
from threadloom.llm.held import held
from threadloom.llm.keep import keep_rows
from threadloom.llm.sketch import heavy_keys
from threadloom.llm.words import Words, blocks, mix
from threadloom.workspace import discard, materialize, release, sieve, small_batches

SHINGLE, HEAVY, LEAST, CELLS = 5, (1 << 18) - 1, 8, 512
#: Widest signature that the rows of a tile carry; pairs that pass are held against the full ones.
TILE_CELLS = 2048
#: Least prefix shingles of a set that its rows in tiles know: a pair that shares a lesser one of them isn't made again.
FIRST = 32
#: Sets drawn of each group that shares a least hash, and how many of them a set of the group is tested with, the likeliest ones.
HUBS, TRIES = 6, 4
#: Share of the hashes that are sampled; sets up to ``SMALL`` are judged by all their shingles, and any that could link with those gives all.
SAMPLE, SMALL = 0.4, 64
#: Sampled shingles that one partition of step 3 holds, on average.
HELD = 1_500_000
U = np.uint64
BOUND = U(int(SAMPLE * (1 << 63)))
_ODD = np.random.default_rng(77).integers(1, 1 << 63, LEAST, dtype=np.uint64) * U(2) + U(1)
TOP = U(1 << 63)
BITS = [f"b{i}" for i in range(CELLS // 64)]


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle, by text, repeats included."""
    words = Words(data, offsets, lower=True)
    hashes, _, of = words.windows(SHINGLE)
    per, sizes = np.diff(of), np.diff(words.of)
    doc = np.repeat(np.arange(len(per)), per)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        from threadloom.llm.words import _Q, spans

        whole = spans(words.hash, _Q, words.of[short], words.of[short + 1])
        doc, hashes = np.concatenate((doc, short)), np.concatenate((hashes, whole))
        order = np.argsort(doc, kind="stable")
        doc, hashes = doc[order], hashes[order]
    return doc, hashes >> U(1)


def _all_shingles(batch: pa.RecordBatch):
    for _, _, data, offsets in blocks(batch.column("text")):
        yield shingles(data, offsets)[1].view(np.int64)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct shingles of one text."""
    return np.unique(shingles(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[1])


def _describe(heavy):
    def describe(batches):
        held(None)
        often = heavy.value
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column("text")):
                doc, h = shingles(data, offsets)
                if len(often) and len(h):
                    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                    h = np.where(often[at] == h, h | TOP, h)  # frequent ones last
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
                doc, h = doc[new], h[new]
                n = np.bincount(doc, minlength=b - a)
                of = np.concatenate(([0], np.cumsum(n)))
                some = np.flatnonzero(n)
                plain = h & ~TOP

                def each(values, how, some=some, of=of, rows=b - a):
                    out = np.zeros(rows, np.uint64)
                    if len(some):
                        out[some] = how.reduceat(values, of[some])
                    return out.view(np.int64)

                # wide signatures for large sets: parity in two or more cells a shingle
                cells = np.where(n > CELLS // 2, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64).clip(9, 16), 0)
                base = np.concatenate(([0], np.cumsum(cells)))
                large = cells[doc] > 0
                parity = np.bincount((plain[large] & (cells[doc[large]] - 1).astype(np.uint64)).astype(np.int64) + base[doc[large]], minlength=base[-1]) & 1
                packed = np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()
                wide = [packed[x // 8 : y // 8] for x, y in zip(base, base[1:], strict=False)]
                spread = mix(plain)
                bit, cell = U(1) << (plain & U(63)), (plain >> U(6)) & U(len(BITS) - 1)
                first = n - (3 * n + 3) // 4 + 1
                low = np.bincount(doc[(h < BOUND) | ((h < TOP) & (n[doc] <= SMALL * 4 // 3 + 1))], minlength=b - a)
                judged = np.bincount(doc[(h < BOUND) | ((h < TOP) & (n[doc] <= SMALL))], minlength=b - a)
                raw = h.tobytes()
                least = np.stack([each(plain * m, np.minimum) for m in _ODD], axis=1).ravel()
                columns = [
                    *(batch.column(c).slice(a, b - a) for c in ("uid", "doc_id", "g")), pa.array(n), pa.array(each(spread, np.add)), pa.array(each(mix(spread ^ U(0x5851F42D4C957F2D)), np.add)),
                    *(pa.array(each(np.where(cell == i, bit, U(0)), np.bitwise_xor)) for i in range(len(BITS))),
                    pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * LEAST), pa.array(least)),
                    pa.array([raw[x * 8 : (x + max(k, m)) * 8] if c else b"" for x, k, m, c in zip(of, first, low, n, strict=False)], pa.binary()),
                    pa.array(wide, pa.binary()), pa.array(judged),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "g", "n", "k1", "k2", *BITS, "least", "keys", "wide", "judged"])

    return describe


DESCRIBED = "uid long, doc_id long, g binary, n long, k1 long, k2 long, " + ", ".join(f"{b} long" for b in BITS) + ", least array<long>, keys binary, wide binary, judged long"


def _six(x: np.ndarray) -> np.ndarray:
    """The low 48 bits of each number, as bytes."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6])


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _deal(parts: int):
    """Samples packed by partition of the hash: 48 bits a shingle, and of each set its place in a block of ids, number of shingles and 48 bits of identity."""

    def deal(batches):
        for batch in batches:
            lists, n, uid = batch.column("keys").to_pylist(), batch.column("n").to_numpy(), batch.column("uid").to_numpy()
            who = batch.column("k1").to_numpy().view(np.uint64)
            sizes = np.array([len(x) // 8 for x in lists], np.int64)
            keys, owner = np.frombuffer(b"".join(lists), np.uint64), np.repeat(np.arange(len(lists)), sizes)
            only = (keys >= BOUND) & (n[owner] > SMALL)  # sent as an answer, not judged by it
            sent = (keys < BOUND) | ((keys < TOP) & (n[owner] <= SMALL * 4 // 3 + 1))
            keys, owner, only = keys[sent], owner[sent], only[sent]
            part, block = (mix(keys) % U(parts)).astype(np.int64), uid[owner] >> 15
            order = np.lexsort((only, owner, part, block))
            keys, owner, only, part, block = keys[order], owner[order], only[order], part[order], block[order]
            run = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (only[1:] != only[:-1]) | (part[1:] != part[:-1]))) if len(keys) else np.empty(0, np.int64)
            many = np.diff(np.append(run, len(keys))).astype("<u4")
            name = ((uid[owner[run]] & 0x7FFF) | (only[run].astype(np.int64) << 15)).astype("<u2")
            cut = np.flatnonzero(np.append(True, (part[run][1:] != part[run][:-1]) | (block[run][1:] != block[run][:-1]))) if len(run) else run
            at, ends = np.append(run, len(keys)), np.append(cut, len(run))
            packed, marks = _six(keys), _six(who[owner[run]])
            rows = [
                (int(part[run[x]]), int(block[run[x]]), packed[at[x] : at[y]].tobytes(), name[x:y].tobytes(), many[x:y].tobytes(), marks[x:y].tobytes())
                for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
            ]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "block", "keys", "names", "many", "marks"])

    return deal


def _meet(batches):
    """For each set of a packed row, how many of its sampled shingles some other set has too; a partition's shingles are whole here."""

    def settle(rows):
        keys = _from_six(b"".join(r[1] for r in rows))
        names, many = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in ((2, "<u2"), (3, "<u4")))
        mark = np.repeat(_from_six(b"".join(r[4] for r in rows)), many)
        order = np.argsort(keys, kind="stable")
        ranked, mark = keys[order], mark[order]
        edge = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        mixed = np.minimum.reduceat(mark, edge) != np.maximum.reduceat(mark, edge)
        met = np.empty(len(keys), np.int64)
        met[order] = np.repeat(mixed, np.diff(np.append(edge, len(keys))))
        met = np.add.reduceat(met, np.concatenate(([0], np.cumsum(many)[:-1].astype(np.int64))))
        sizes, at, out = [len(r[2]) // 2 for r in rows], 0, []
        for (block, *_), size in zip(rows, sizes, strict=True):
            pick = at + np.flatnonzero((met[at : at + size] > 0) & (names[at : at + size] < 1 << 15))
            if len(pick):
                out.append((block, names[pick].tobytes(), met[pick].astype("<u4").tobytes()))
            at += size
        columns = zip(*out, strict=True) if out else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "names", "met"])

    yield from _by_first(batches, settle)


def _by_first(batches, settle):
    """``settle`` for the rows of each value of the first column, by which they come sorted."""
    held, current = [], None
    for batch in batches:
        for first, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and first != current:
                yield settle(held)
                held = []
            current = first
            held.append(row)
    if held:
        yield settle(held)


def _sum_blocks(batches):
    """(uid, met) from the answers of all partitions, a block of ids at a time."""

    def settle(rows):
        total = np.zeros(1 << 15, np.int64)
        for _, names, met in rows:
            np.add.at(total, np.frombuffer(names, "<u2"), np.frombuffer(met, "<u4"))
        pick = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array((rows[0][0] << 15) | pick), pa.array(total[pick])], names=["uid", "met"])

    yield from _by_first(batches, settle)


def _entries(batches):
    """A row for each prefix shingle of each set."""
    for batch in batches:
        n, lists = batch.column("n").to_numpy(), batch.column("keys").to_pylist()
        sizes = n - (3 * n + 3) // 4 + 1
        for x in range(0, len(lists), 512):
            y = min(x + 512, len(lists))
            own = sizes[x:y]
            keys = np.frombuffer(b"".join(k[: 8 * m] for k, m in zip(lists[x:y], own.tolist(), strict=True)), np.uint64)
            owner = np.repeat(np.arange(x, y), own)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(own) - own, own)
            indexed = place < (n - (6 * n + 6) // 7 + 1)[owner]
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array((keys & ~TOP).view(np.int64)), batch.column("uid").take(at), batch.column("label").take(at), pa.array(indexed)], names=["key", "uid", "label", "indexed"])


def _cells(tile: np.ndarray) -> np.ndarray:
    """Width of the signatures of a tile, 0 where 512 cells are enough; its rows all have that width or more."""
    least = np.ceil((4 / 3) ** np.maximum(tile - 1.0, 0) - 1e-6)
    return np.where(least > CELLS // 2, 1 << np.ceil(np.log2(2 * least)).astype(np.int64).clip(9, int(np.log2(TILE_CELLS))), 0)


def _tiles(batches):
    """A row for each tile of a row: (key, tile) for its own band, and the next for indexed ones; signatures folded to the tile's width."""
    for batch in batches:
        band, indexed = batch.column("band").to_numpy(), batch.column("indexed").to_numpy(zero_copy_only=False)
        for shift, first in ((0, np.ones(len(band), bool)), (1, indexed)):
            pick = np.flatnonzero(first)
            tile = band[pick] + shift
            wide, sig = batch.column("wide").take(pa.array(pick)).to_pylist(), []
            narrow = np.stack([batch.column(b).to_numpy() for b in BITS], axis=1)[pick]
            for w, cells, own in zip(wide, _cells(tile).tolist(), narrow, strict=True):
                x = np.frombuffer(w, np.int64) if cells else own
                while cells and len(x) * 64 > cells:
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                sig.append(x)
            out = batch.take(pa.array(pick)).drop_columns(["wide", "band", *BITS])
            out = out.set_column(out.schema.get_field_index("indexed"), "indexed", pa.array(indexed[pick]))
            yield out.append_column("shift", pa.array(np.full(len(pick), shift, np.int32))).append_column("tile", pa.array(tile.astype(np.int32))).append_column("sig", pa.array(sig, pa.list_(pa.int64())))


def _near(batches):
    """Pairs whose wide signatures allow a link; a wider one folds to the width of the other."""
    for batch in batches:
        keep = []
        for n, a, b in zip(batch.column("sum").to_pylist(), batch.column("ua").to_pylist(), batch.column("va").to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            if not len(x) or not len(y):
                keep.append(True)
                continue
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            keep.append(7 * int(np.bitwise_count(x ^ y).sum()) <= n)
        yield batch.filter(pa.array(keep, pa.bool_())).drop_columns(["sum", "ua", "va"])


def _verify(batches):
    """Exact test of each pair; sets of the shared side are kept while they repeat."""
    last, kept = None, None
    for batch in batches:
        out = []
        for u, v, a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("ut").cast(pa.large_binary()), batch.column("vt").cast(pa.large_binary()), strict=True):
            if u != last:
                last, kept = u, shingle_set(a.as_py())
            other = shingle_set(b.as_py())
            shared = len(np.intersect1d(kept, other, assume_unique=True))
            if 100 * shared >= 75 * (len(kept) + len(other) - shared):
                out.append((u, v))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["u", "v"])


class _Join:
    """State of one join; the steps of the module's description."""

    def __init__(self, docs: DataFrame, heavy: int):
        self.spark = docs.sparkSession
        small_batches(self.spark)
        text = F.coalesce("text", F.lit(""))
        self.texts = docs.select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("g"), text.alias("text"))
        often = heavy_keys(docs.select(text.alias("text")), _all_shingles, heavy, floor=2).view(np.uint64)
        shared = self.spark.sparkContext.broadcast(np.sort(often))  # at most heavy + 1 numbers
        rows = self.texts.withColumn("uid", F.monotonically_increasing_id()).select("uid", "doc_id", "g", "text")
        sets = materialize(rows.mapInArrow(_describe(shared), DESCRIBED), "sets")
        self.all = materialize(sets.select("uid", "doc_id", "g", "n", "k1", "k2"), "rows")
        self.classes = materialize(self.all.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("uid").alias("uid"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "g")).alias("best")), "classes")
        left = materialize(self.not_alone(sets), "left")
        release(self.spark)
        columns = ["uid", "n", *BITS, "wide", "least", "keys", "g", F.coalesce("doc_id", F.lit(-1)).alias("id")]
        self.nodes = materialize(sets.join(left.join(self.classes.select("uid"), "uid"), "uid").select(*columns), "nodes")
        discard(sets)

    def not_alone(self, sets: DataFrame) -> DataFrame:
        """uid of the sets that could link with any other, by their lone shingles."""
        sent = sets.where("n > 0").agg(F.sum(F.octet_length("keys")) / 8).first()[0] or 0
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), int(sent / HELD) + 1)
        packed = sets.where("n > 0").select("uid", "n", "k1", "keys").mapInArrow(_deal(parts), "part int, block long, keys binary, names binary, many binary, marks binary")
        answers = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_meet, "block long, names binary, met binary")
        answers = answers.select("block", F.col("block").alias("of"), "names", "met").repartition("block").sortWithinPartitions("block")
        met = materialize(answers.mapInArrow(_sum_blocks, "uid long, met long"), "met")
        alone = F.col("judged") - F.coalesce("met", F.lit(0))
        return sets.where("n > 0").select("uid", "n", "judged").join(met, "uid", "left").where(alone <= F.floor(F.col("n") / 4)).select("uid")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs (u, v, ...) that the wide signatures allow."""
        side = lambda x: self.nodes.select(F.col("uid").alias(x), F.col("n").alias(f"{x}n"), F.col("wide").alias(f"{x}a"))
        both = pairs.join(side("u"), "u").join(side("v"), "v").select(*pairs.columns, (F.col("un") + F.col("vn")).alias("sum"), "ua", "va")
        return both.mapInArrow(_near, pairs.schema)

    def may_link(self, a: str, b: str):
        """Sizes within 3/4, and the signatures' difference within what a link allows."""
        apart = sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in BITS), F.lit(0))
        small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
        return (small * 4 >= large * 3) & (apart * 7 <= small + large), apart

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that link; u is the side that many pairs may share."""
        wanted = pairs.select("u").union(pairs.select(F.col("v"))).distinct().withColumnRenamed("u", "uid")
        where = materialize(wanted.join(self.nodes.select("uid", "id", "g"), "uid"), "wanted")
        own = self.texts.select("id", "g", "text")
        maybe = sieve(own, F.xxhash64("id", "g"), where.select(F.xxhash64("id", "g").alias("h")))[0]
        texts = materialize(maybe.dropDuplicates(["id", "g"]).join(where, ["id", "g"]).select("uid", "text"), "texts")  # equal texts are one class, so one uid
        with_v = pairs.join(texts.select(F.col("uid").alias("v"), F.col("text").alias("vt")), "v")
        both = with_v.join(texts.select(F.col("uid").alias("u"), F.col("text").alias("ut")), "u")
        return both.select("u", "v", "ut", "vt").mapInArrow(_verify, "u long, v long")

    def by_least_hash(self) -> DataFrame:
        each = self.nodes.select("uid", F.posexplode("least").alias("i", "h"))
        drawn = [F.min_by("uid", F.xxhash64(F.lit(k), "i", "uid")) for k in range(HUBS)]
        hubs = each.groupBy("i", "h").agg(F.count("*").alias("size"), F.array_distinct(F.array(*drawn)).alias("hubs")).where("size > 1")
        pairs = each.join(hubs.select("i", "h", F.explode("hubs").alias("u")), ["i", "h"]).where("uid != u").select("u", F.col("uid").alias("v")).distinct()
        a, b = self.nodes.select("uid", "n", *BITS).alias("a"), self.nodes.select("uid", "n", *BITS).alias("b")
        fits, apart = self.may_link("a", "b")
        near = pairs.join(a, F.col("u") == F.col("a.uid")).join(b, F.col("v") == F.col("b.uid")).where(fits).select("u", "v", apart.alias("apart"))
        near = materialize(near, "hubs")
        ranked = self.near(near).withColumn("i", F.row_number().over(Window.partitionBy("v").orderBy("apart", "u"))).where(F.col("i") <= TRIES)
        return materialize(self.verify(materialize(ranked.select("u", "v"), "pairs")), "links")

    def live(self, labels: DataFrame) -> DataFrame:
        """Prefix shingles (key, uid, label, indexed) of more than one component; of those that the same sets have, the least one."""
        rows = self.nodes.select("uid", "n", "keys").join(labels.select(F.col("node").alias("uid"), "label"), "uid", "left")
        rows = materialize(rows.select("uid", "n", "keys", F.coalesce("label", "uid").alias("label")).mapInArrow(_entries, "key long, uid long, label long, indexed boolean"), "entries")
        owners = [F.bit_xor(F.xxhash64(F.lit(i), "uid")).alias(f"h{i}") for i in (1, 2)]
        keys = rows.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.bool_or("indexed").alias("i"), F.count("*").alias("owners"), *owners)
        keys = materialize(keys.where("a != b and i").select("key", "owners", "h1", "h2"), "keys")
        same = keys.join(keys.groupBy("owners", "h1", "h2").agg(F.min("key").alias("first")), ["owners", "h1", "h2"]).select("key", "first")
        live = rows.join(same, "key").groupBy(F.col("first").alias("key"), "uid", "label").agg(F.bool_or("indexed").alias("indexed"))
        live = materialize(live, "tiles")
        discard(rows)
        return live

    def met(self, labels: DataFrame) -> DataFrame:
        """Pairs (u, v, x, y, apart) that meet in tiles, at their least shared shingle if it is among the ``FIRST`` of both."""
        live = self.live(labels)
        least = lambda keys: F.slice(F.array_sort(keys), 1, FIRST)
        first = live.groupBy("uid").agg(least(F.collect_list("key")).alias("all"), least(F.collect_list(F.when(F.col("indexed"), F.col("key")))).alias("own"))
        full = live.join(first, "uid").join(self.nodes.select("uid", "n", *BITS, "wide"), "uid").withColumn("band", F.floor(F.log("n") / F.log(F.lit(4 / 3)) + 1e-9).cast("int"))
        before = [F.filter(c, lambda x: x < F.col("key")).alias(c) for c in ("all", "own")]
        tiled = full.select("key", "uid", "label", "indexed", "n", *before, *BITS, "band", "wide").mapInArrow(
            _tiles, "key long, uid long, label long, indexed boolean, n long, all array<long>, own array<long>, shift int, tile int, sig array<long>"
        )
        a, b = tiled.where("indexed").alias("a"), tiled.where("shift = 0").alias("b")
        order = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.uid") < F.col("b.uid")))
        apart = F.aggregate(F.zip_with("a.sig", "b.sig", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        fits = (F.col("a.n") * 4 >= F.col("b.n") * 3) & (apart * 7 <= F.col("a.n") + F.col("b.n"))
        again = F.arrays_overlap("a.own", "b.all")  # the pair is a row of the tile of that shingle, or of a lesser one
        found = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.tile") == F.col("b.tile")) & (F.col("a.label") != F.col("b.label")) & order & fits & ~again)
        return found.select(F.col("a.uid").alias("u"), F.col("b.uid").alias("v"), F.col("a.label").alias("x"), F.col("b.label").alias("y"), apart.alias("apart"))

    def tiles(self, labels: DataFrame) -> DataFrame:
        """Candidates (u, v, x, y, apart) from different components x, y."""
        return self.near(materialize(self.met(labels).distinct(), "pairs"))

    def labels(self) -> DataFrame:
        """(node, label) of every set that links with another."""
        labels = materialize(components(self.by_least_hash()), "labels")
        release(self.spark)
        left = materialize(self.tiles(labels), "candidates")
        sets, tries, count = self.nodes.count(), TRIES, left.count()
        while count:
            # a few for each set at once, else the likeliest of each set first: most others lie in one component then
            if count > TRIES * sets and tries < 256:
                of_u, of_v = Window.partitionBy("u").orderBy("apart", "v"), Window.partitionBy("v").orderBy("apart", "u")
                ranked = left.withColumn("i", F.row_number().over(of_u)).withColumn("j", F.row_number().over(of_v))
                left = materialize(ranked.withColumn("now", (F.col("i") <= tries) | (F.col("j") <= tries)), "ranked")
                release(self.spark)
                tried, rest = left.where("now"), left.where("not now")
                waiting = rest.count()
            else:
                tried, waiting = left, 0
            links = materialize(self.verify(tried.select("u", "v")), "links")
            labels = materialize(components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(links)), "labels")
            if not waiting:
                break
            of = lambda side, to: labels.select(F.col("node").alias(side), F.col("label").alias(to))  # noqa: B023, E731
            rest = rest.select("u", "v", "apart").join(of("u", "x"), "u", "left").join(of("v", "y"), "v", "left")
            rest = rest.select("u", "v", F.coalesce("x", "u").alias("x"), F.coalesce("y", "v").alias("y"), "apart").where("x != y")
            left = materialize(rest, "candidates")
            count = left.count()
            tries *= 8 if 2 * count > waiting else 1
        return labels


def near_duplicates(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_shingles, component_id, the text's md5, and whether the row is the one of its component that stays.

    That is the one with the smallest id (null last), then md5; rows that agree in both all say so.
    """
    join = _Join(docs, heavy)
    labels = join.labels()
    classes = join.classes.join(labels.select(F.col("node").alias("uid"), "label"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    classes = classes.join(classes.groupBy("label").agg(F.min("best").alias("first")), "label").select("k1", "k2", "n", "first")
    rows = join.all.select("doc_id", "g", "n", "k1", "k2")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("g") == F.col("first.g"))
    found = rows.where("n > 0").join(classes, ["k1", "k2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), "g", stays.alias("stays"))
    return found.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "g", F.lit(True).alias("stays")))


def keep_one(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The documents that stay: of each component one, with all its columns."""
    stay = F.when(F.max("n_shingles") == 0, F.count("*")).otherwise(F.max(F.col("stays").cast("int"))).alias("times")
    found = near_duplicates(docs, heavy).groupBy(F.col("g").alias("digest"), "doc_id").agg(F.count("*").alias("rows"), stay)
    return keep_rows(docs, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))), found, [F.lit(1)])


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
