"""Merkle manifest of a dataset: a tree of digests for each language, and one of their roots.

Leaves are sorted into runs by (tree, key); a leaf's place in its tree is its place in the run plus the
sizes of the runs before.  The store of nodes is Parquet, a folder for each level.  A pass reads
the topmost level written so far in order of place, a block of 2**HEIGHT neighbours at a time, and streams the
levels above them out, up to one node a block; the next pass reads these.  So a tree of N leaves takes
log(N) / HEIGHT passes, and a task holds one block, whatever the size of a tree.  Proofs are a merge-scan: leaves and
stored nodes of a block arrive sorted by their coordinates, along with the path above the block, and the
siblings of a leaf are those at (place >> level) ^ 1.

Digests are SHA-256 over texts; a node hashes its children's lowercase hexes.  A run at the end of a
level that holds one node is hashed alone; a tree of one leaf has it as root.

Defined results: a null doc_id sorts first, and as ``-`` in its leaf; it is never tampered with.  Rows
of one id and language are ordered by their leaves; rows alike in everything are leaves of their own with the same
digest.  The null language is a tree of its own, before the others.  Empty and long texts are texts
like others; an empty table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from threadloom.workspace import materialize, small_batches

#: Levels of a pass; a block has two to this number of nodes at most.
HEIGHT = 10

_NODE = {"tree": "string", "level": "int", "pos": "long", "size": "long", "digest": "binary"}
_PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A value with its length in bytes before it, ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column) -> Column:
    """SHA-256 of the row's fields, as binary."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))]).cast("binary"), 256))


def tampered(rows: DataFrame) -> Column:
    """Where 7 divides the CRC-32 of the id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, item (the id), digest, changed: the one scan that reads texts.

    ``changed`` is the leaf of a row that was tampered with, null for others.
    """
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").alias("item"),
        leaf(F.col("n_chars")).alias("digest"),
        F.when(tampered(docs), leaf(more)).alias("changed"),
    )


def place(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with pos and size: the place in the tree by ``order``, and the tree's number of leaves.

    Runs are ranges of (tree, order) sorted in their tasks; ``uid`` lets runs divide rows that are alike.
    """
    columns = [F.col(c).asc_nulls_first() for c in ("tree", *order, "uid")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    runs = materialize(runs.drop("uid").withColumn("at", F.monotonically_increasing_id()), "runs")
    runs = runs.withColumn("run", F.shiftright("at", 33))
    starts = runs.groupBy("run", "tree").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    starts = starts.select("run", "tree", "first", (F.sum("n").over(tree.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(tree).alias("size"))
    return runs.join(starts, ["run", "tree"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "run", "first", "before")


def digest_of(*hexes: str) -> str:
    return sha256("".join(hexes).encode()).hexdigest()


def climb(nodes: list[str], levels: int) -> Iterator[list[str]]:
    """The ``levels`` levels above ``nodes``, lowest first."""
    for _ in range(levels):
        nodes = [digest_of(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        yield nodes


def levels_above(size: int, height: int = HEIGHT) -> int:
    """Levels that a pass adds to a tree that now has ``size`` nodes."""
    return min(height, (size - 1).bit_length())


def build(leaves_: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The store: tree, level, pos, size (of the level), digest of all nodes, a folder for each level; level 0 is ``leaves_`` itself.

    Every pass reads the topmost level in order of place and streams those above it out.
    """
    schema = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("pos", pa.int64()), ("size", pa.int64()), ("digest", pa.binary())])

    def grow(batches):
        key, nodes = None, []

        def block():
            tree, level, size, at = key
            for k, up in enumerate(climb(nodes, levels_above(size, height)), 1):
                first, n = at << (height - k), len(up)
                columns = [[tree] * n, [level + k] * n, range(first, first + n), [-(-size >> k)] * n, map(bytes.fromhex, up)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for tree, level, pos, size, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = (tree, level, size, pos >> height)
                if now != key:
                    if nodes:
                        yield from block()
                    key, nodes = now, []
                nodes.append(digest.hex())
        if nodes:
            yield from block()

    store = top = leaves_.select("tree", F.lit(0).alias("level"), "pos", "size", "digest")
    while True:
        block_ = F.shiftright("pos", height)
        ordered = top.where("size > 1").repartition("tree", block_).sortWithinPartitions("tree", "pos").select(*_NODE)
        made = materialize(ordered.mapInArrow(grow, ", ".join(f"{k} {v}" for k, v in _NODE.items())), "nodes", by=("level",))
        highest = made.agg(F.max("level")).first()[0]
        if highest is None:
            return store
        store = store.unionByName(made)
        top = made.where(F.col("level") == highest)  # trees that ended below it are done


def siblings(known: dict[tuple[int, int], str], pos: int, levels: int) -> list[tuple[str, str]]:
    """(before, after) a node at each level; both empty where it is hashed alone."""
    out = []
    for k in range(levels):
        at = pos >> k
        other = known.get((k, at ^ 1), "")
        out.append((other, "") if at % 2 else ("", other))
    return out


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that ``digest`` and its path give."""
    for before, after in path:
        digest = digest_of(before, digest, after)
    return digest


def scan(nodes: DataFrame, store: DataFrame, above: DataFrame, level: int, finish: Callable[..., tuple], made: dict[str, str], height: int) -> DataFrame:
    """What ``finish`` (tree, pos, item, digest, changed, path, subroot, root) makes of each of ``nodes``, which are of ``level``.

    A merge-scan by coordinates: of each block come the path above it, its part of the store level by level,
    and its nodes, which are streamed past what came before.  ``above`` has tree, pos (the block), path,
    subroot and root; ``nodes`` has tree, pos, size, item, digest, changed.
    """
    item = dict(nodes.dtypes)["item"]
    kinds = {"pos": "long", "size": "long", "digest": "binary", "changed": "binary", "item": item, "path": _PATH, "subroot": "string", "root": "string"}

    def part(rows: DataFrame, block: str, kind: str) -> DataFrame:
        return rows.select("tree", F.expr(f"cast({block} as long)").alias("block"), F.expr(f"cast({kind} as int)").alias("kind"), *[(F.col(c) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()])

    stored = store.where(F.col("level").between(level, level + height - 1))
    every = part(above, "pos", "-1")
    every = every.unionByName(part(stored, f"shiftright(pos, {height} - (level - {level}))", f"level - {level}"))
    every = every.unionByName(part(nodes, f"shiftright(pos, {height})", f"{height}"))

    def merge(batches):
        now, known, path, subroot, root = None, {}, [], "", ""
        for batch in batches:
            out = []
            for tree, block, kind, pos, size, digest, changed, item_, path_, subroot_, root_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tree, block) != now:
                    now, known, path, subroot, root = (tree, block), {}, [], "", ""
                if kind < 0:
                    path, subroot, root = [(p["before"], p["after"]) for p in path_], subroot_, root_
                elif kind < height:
                    known[kind, pos] = digest.hex()
                else:
                    out.append(finish(tree, pos, item_, digest.hex(), changed and changed.hex(), siblings(known, pos, levels_above(size, height)) + path, subroot, root))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=list(made))

    types = [to_arrow_type(_parse_datatype_string(t)) for t in made.values()]
    ordered = every.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "pos")
    return ordered.mapInArrow(merge, ", ".join(f"`{k}` {v}" for k, v in made.items()))


def _upper(tree, pos, item, digest, changed, path, subroot, root):
    return tree, pos, [{"before": a, "after": b} for a, b in path], subroot, root


_ABOVE = {"tree": "string", "pos": "long", "path": _PATH, "subroot": "string", "root": "string"}


def extract(leaves_: DataFrame, store: DataFrame, tops: DataFrame, finish: Callable[..., tuple], made: dict[str, str], height: int = HEIGHT) -> DataFrame:
    """``finish`` for every leaf; ``tops`` has tree, path, subroot, root, the path above each tree's root.

    From the highest pass down: the paths of its nodes are those above the blocks of the pass below.
    """
    # the pass in which a tree of this size ends
    last = F.greatest(F.ceil(F.length(F.bin(F.col("size") - 1)) / height) - 1, F.lit(0))
    ends = leaves_.where("pos = 0").select("tree", last.alias("last"))
    highest = ends.agg(F.max("last")).first()[0] or 0
    tops = materialize(tops.join(ends, "tree").select("tree", F.lit(0).cast("long").alias("pos"), "path", "subroot", "root", "last"), "tops")
    paths = None
    for i in range(highest, -1, -1):
        above = tops.where(F.col("last") == i).drop("last")
        above = above if paths is None else above.unionByName(paths)
        if i == 0:
            return scan(leaves_, store, above, 0, finish, made, height)
        nodes = store.where((F.col("level") == i * height) & (F.col("size") > 1)).withColumns({"item": F.lit(None).cast("long"), "changed": F.lit(None).cast("binary")})
        paths = materialize(scan(nodes, store, above, i * height, _upper, _ABOVE, height), "paths")
    raise AssertionError


@dataclass(frozen=True)
class Manifest:
    """Frames of a manifest: leaves (tree, pos, size, item, digest, changed), stores of nodes, and tops (tree, path, subroot, root)."""

    leaves: DataFrame
    store: DataFrame
    roots: DataFrame
    tops: DataFrame

    @classmethod
    def of(cls, docs: DataFrame, height: int = HEIGHT) -> Manifest:
        small_batches(docs.sparkSession)
        placed = materialize(place(materialize(leaves(docs), "digests"), ["item", "digest"]), "leaves")  # texts are read once, ranges sample
        store = build(placed, height)
        top = lambda nodes: nodes.where("size = 1")  # noqa: E731  (one node of each tree)
        ranked = top(store).select(F.lit("").alias("tree"), F.col("tree").alias("item"), "digest", F.lit(None).cast("binary").alias("changed"))
        ranked = materialize(place(ranked, ["item"]), "subroots")
        roots = build(ranked, height)
        above = top(roots).select("tree", F.array().cast(_PATH).alias("path"), F.lower(F.hex("digest")).alias("subroot"), F.lower(F.hex("digest")).alias("root"))

        def of_tree(tree, pos, item, digest, changed, path, subroot, root):
            return item, [{"before": a, "after": b} for a, b in path], digest, root

        tops = extract(ranked, roots, above, of_tree, {"tree": "string", "path": _PATH, "subroot": "string", "root": "string"}, height)
        return cls(placed, store, roots, materialize(tops, "tops"))

    def proofs(self, height: int = HEIGHT) -> DataFrame:
        """item, leaf, subroot, root, path of every leaf."""

        def whole(tree, pos, item, digest, changed, path, subroot, root):
            return item, digest, subroot, root, [{"before": a, "after": b} for a, b in path]

        made = {"item": dict(self.leaves.dtypes)["item"], "leaf": "string", "subroot": "string", "root": "string", "path": _PATH}
        return extract(self.leaves, self.store, self.tops, whole, made, height)

    def audit(self, height: int = HEIGHT) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""

        def check(tree, pos, item, digest, changed, path, subroot, root):
            folded = fold(changed or digest, path)
            return item, digest, subroot, root, digest_of(*(x for pair in path for x in pair)), folded, folded == root

        made = {"doc_id": dict(self.leaves.dtypes)["item"]} | dict.fromkeys(("leaf", "subroot", "root", "proof_sha256", "folded_root"), "string") | {"verified": "boolean"}
        return extract(self.leaves, self.store, self.tops, check, made, height)


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    return Manifest.of(spark.read.parquet(f"{sf_dir}/documents.parquet")).audit()


OP11_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, coalesce('+' || lang, '') AS tree, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS n1, coalesce(strlen(text) || ':' || text, '-') AS b,
    -- CRC-32 of the decimal id: a byte goes in, then eight shifts
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda x, v: CASE WHEN v >= 0 THEN xor(x, v) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295) % 7 = 0 AS hit FROM documents),
l AS (
  SELECT doc_id, tree, leaf, CASE WHEN hit THEN changed ELSE leaf END AS start, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size
  FROM (SELECT *, sha256(a || n || b) AS leaf, sha256(a || n1 || b) AS changed FROM f) g WINDOW w AS (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf)),
nodes AS (
  SELECT tree, 0 AS level, pos, size, leaf AS h FROM l
  UNION ALL SELECT tree, level + 1, pos // 2, (min(size) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE size > 1 GROUP BY tree, level, pos // 2),
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1),
tops AS (
  SELECT 0 AS level, pos, size, h FROM subroots
  UNION ALL SELECT level + 1, pos // 2, (min(size) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE size > 1 GROUP BY level, pos // 2),
steps AS (
  SELECT l.tree, l.pos, a.level, CASE WHEN (l.pos >> a.level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.h, '') AS step
  FROM l JOIN nodes a ON a.tree = l.tree AND a.size > 1 AND a.pos = l.pos >> a.level LEFT JOIN nodes s ON s.tree = a.tree AND s.level = a.level AND s.pos = xor(a.pos, 1)
  UNION ALL SELECT l.tree, l.pos, 1000 + a.level, CASE WHEN (r.pos >> a.level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.h, '')
  FROM l JOIN subroots r ON r.tree = l.tree JOIN tops a ON a.size > 1 AND a.pos = r.pos >> a.level LEFT JOIN tops s ON s.level = a.level AND s.pos = xor(a.pos, 1)),
p AS (SELECT tree, pos, list(step ORDER BY level) AS path FROM steps GROUP BY tree, pos),
q AS (
  SELECT doc_id, leaf, r.h AS subroot, (SELECT h FROM tops WHERE size = 1) AS root, sha256(array_to_string(list_transform(coalesce(path, []), lambda x: x[2:]), '')) AS proof_sha256,
    list_reduce(list_prepend(start, coalesce(path, [])), lambda h, x: CASE WHEN x[1] = 'L' THEN sha256(x[2:] || h) ELSE sha256(h || x[2:]) END) AS folded_root
  FROM l JOIN subroots r ON r.tree = l.tree LEFT JOIN p ON p.tree = l.tree AND p.pos = l.pos)
SELECT *, folded_root = root AS verified FROM q
"""
