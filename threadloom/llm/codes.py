"""Product codes of vectors: each of 16 parts of a vector becomes the number of its nearest codebook entry.

One scan turns the vectors into blocks of NumPy data, whole numbers laid out by component, in the
shared folder.  Each round of Lloyd's rule is one ``treeAggregate`` over the RDD of the blocks:
a task adds up squared differences component by component, takes the nearest entry of each
part, and adds its vectors into int64 tensors of sums and counts by ``np.add.at``; the tensors, a few
hundred kilobytes whatever the table's size, merge through a reduction tree.  Everything is whole numbers,
so the result depends neither on partitions nor on the order in which tensors meet.

Defined results: a vector that is null, or holds a null or non-finite component, is dropped, whatever
its label.  A null id is an id like others, after all of them; repeated rows each count, and
of rows with one id the smaller vector is first among the entries.  Fewer than 64 vectors give as
many entries; an empty table gives no rows.  Components too large for 64-bit sums are handled as Python
integers, exactly; an error or a sum of errors beyond a long is null then.  Vectors of
another length than the first entry, or of a length that 16 does not divide, raise an error.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.workspace import materialize, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block, and of a step within it, whose distances to all entries are held at once.
BLOCK, STEP = 4096, 1024
#: Depth of the reduction tree.
DEPTH = 3
_WIDE = 1 << 62


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite doubles: int64, or Python integers if one of them needs more."""
    if not len(values) or np.abs(values).max() < float(_WIDE // SCALE):
        return np.floor(values * SCALE).astype(np.int64)
    exact = [v.as_integer_ratio() for v in values.tolist()]
    return np.array([SCALE * n // d for n, d in exact], object)


def pack(q: np.ndarray) -> tuple[str, bytes]:
    """A block's numbers in the narrowest type that holds them."""
    if q.dtype == object:
        return "O", "\n".join(map(str, q.ravel().tolist())).encode()
    kind = next(k for k in ("i2", "i4", "i8") if not q.size or (np.iinfo(k).min <= q.min() and q.max() <= np.iinfo(k).max))
    return kind, q.astype(f"<{kind}").tobytes()


def unpack(kind: str, data: bytes, dim: int) -> np.ndarray:
    """The block again, components first: ``dim`` x vectors."""
    if kind == "O":
        q = np.array([int(x) for x in bytes(data).split(b"\n")] if dim else [], object)
    else:
        q = np.frombuffer(data, f"<{kind}")
    return q.reshape(dim, -1)


@dataclass(frozen=True)
class Arithmetic:
    """Types in which no sum can overflow, from the largest magnitude and the number of vectors."""

    distance: type
    total: type

    @classmethod
    def of(cls, most: int, width: int, vectors: int) -> Arithmetic:
        square = (2 * most) ** 2 * max(width, 1)
        return cls(np.int32 if square < 1 << 31 else np.int64 if square < _WIDE else object, np.int64 if most * max(vectors, 1) < _WIDE else object)


def nearest(block: np.ndarray, codebooks: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Of each part (rows) and vector: the nearest entry, ties to the lower index, and its squared distance."""
    parts, entries, width = codebooks.shape
    n = block.shape[1]
    code, error = np.zeros((parts, n), np.int64), np.zeros((parts, n), np.int64 if kind is not object else object)
    books = codebooks.astype(kind)
    for at in range(0, n, STEP):
        x = block[:, at : at + STEP].astype(kind)
        for p in range(parts):
            distance = np.zeros((entries, x.shape[1]), kind)
            for d in range(width):
                away = x[p * width + d][None, :] - books[p, :, d][:, None]
                distance += away * away
            best = distance.argmin(0)
            code[p, at : at + STEP] = best
            error[p, at : at + STEP] = distance[best, np.arange(x.shape[1])]
    return code, error


def _vectors(rows: DataFrame) -> DataFrame:
    """Rows whose vector is kept, as doubles."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.withColumn("embedding", x).where(F.col("embedding").isNotNull() & fine)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Components first, whole numbers."""
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != dim).any():
        raise ValueError(f"vectors of {sorted(set(lengths.tolist()) - {dim})[:3]} components among those of {dim}")
    q = whole(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return np.ascontiguousarray(q.reshape(-1, dim).T) if dim else q.reshape(0, len(column))


def _blocks(rows: DataFrame, dim: int) -> DataFrame:
    """(n, most, kind, data): the vectors in blocks, and the largest magnitude of each."""

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                q = _matrix(batch.column(0).slice(at, BLOCK), dim)
                kind, data = pack(q)
                most = max((abs(int(x)) for x in (q.min(), q.max())), default=0) if q.size else 0
                yield pa.RecordBatch.from_pydict({"n": [min(BLOCK, batch.num_rows - at)], "most": [str(most)], "kind": [kind], "data": [data]}, schema=schema)

    schema = pa.schema([("n", pa.int64()), ("most", pa.string()), ("kind", pa.string()), ("data", pa.binary())])
    return rows.select("embedding").mapInArrow(cut, "n long, most string, kind string, data binary")


def refine(blocks: DataFrame, codebooks: np.ndarray, kinds: Arithmetic) -> np.ndarray:
    """One round: each entry becomes the floor of the mean of its parts; unused entries stay."""
    parts, entries, width = codebooks.shape
    known = blocks.sparkSession.sparkContext.broadcast(codebooks)
    zero = (np.zeros((parts, entries, width), kinds.total), np.zeros((parts, entries), np.int64))

    def add(state, row):
        sums, counts = state
        block = unpack(row.kind, row.data, parts * width)
        code, _ = nearest(block, known.value, kinds.distance)
        wide = block.astype(kinds.total)
        for p in range(parts):
            np.add.at(counts[p], code[p], 1)
            for d in range(width):
                np.add.at(sums[p, :, d], code[p], wide[p * width + d])
        return sums, counts

    def merge(a, b):
        return a[0] + b[0], a[1] + b[1]

    sums, counts = blocks.select("kind", "data").rdd.treeAggregate(zero, add, merge, DEPTH)
    used = counts > 0
    out = codebooks.copy()
    out[used] = (sums // np.maximum(counts, 1)[:, :, None])[used]
    known.unpersist()
    return out


def text_of(codebooks: np.ndarray) -> str:
    return ",".join(str(int(x)) for x in codebooks.ravel())


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, Arithmetic] | None:
    """The codebooks (parts x entries x width) of the vectors of ``rows`` (vec_id, embedding), kept ones only."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(entries).collect()  # at most ``entries`` vectors
    if not first:
        return None
    dim = len(first[0].embedding)
    if dim % parts:
        raise ValueError(f"{dim} components can't be cut into {parts} equal parts")
    small_batches(rows.sparkSession)
    blocks = materialize(_blocks(rows, dim), "blocks")
    # the magnitude is text, since it may exceed a long; longer texts are larger numbers
    most, n = blocks.agg(F.max(F.struct(F.length("most"), "most"))["most"], F.sum("n")).first()
    start = np.array([whole(np.array(r.embedding, float)).tolist() for r in first if len(r.embedding) == dim], np.int64 if int(most) < _WIDE else object)
    kinds = Arithmetic.of(int(most), dim // parts, n)
    codebooks = np.ascontiguousarray(start.reshape(len(start), parts, dim // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        codebooks = refine(blocks, codebooks, kinds)
    return codebooks, kinds


def encode(rows: DataFrame, codebooks: np.ndarray, kinds: Arithmetic) -> DataFrame:
    """vec_id, label, code, error of every row of kept vectors."""
    dim = codebooks.shape[0] * codebooks.shape[2]
    book = rows.sparkSession.sparkContext.broadcast(codebooks)
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def assign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                code, error = nearest(_matrix(part.column("embedding"), dim), book.value, kinds.distance)
                sums = [int(x) for x in error.astype(object).sum(0)] if kinds.distance is object else error.sum(0).tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), pa.array(list(map("".join, hexes[code.T].tolist())), pa.string()), pa.array([x if x < 1 << 63 else None for x in sums], pa.int64())],
                    names=["vec_id", "label", "code", "error"],
                )

    types = dict(rows.dtypes)
    return rows.select("vec_id", "label", "embedding").mapInArrow(assign, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector kept.

    ``vectors`` has vec_id, embedding and label.  Errors are added up by label before the join that
    gives them back; when labels are many, Spark splits a frequent one's partition.
    """
    rows = _vectors(vectors.select("vec_id", "label", "embedding"))
    trained = train(rows, parts, entries, rounds)
    if trained is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    codebooks, kinds = trained
    coded = materialize(encode(rows, codebooks, kinds), "codes")
    total = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count_if(F.col("error").isNull()).alias("lost"))
    total = total.select("of", F.when(F.col("lost") == 0, F.expr("try_cast(sum as bigint)")).alias("label_error"))
    digest = hashlib.sha256(text_of(codebooks).encode()).hexdigest()
    return coded.join(total, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def decode(codes: pd.Series, codebooks: np.ndarray) -> np.ndarray:
    """Vectors that ``codes`` stand for, in the units of the table."""
    index = np.array([[int(c[i : i + 2], 16) for i in range(0, len(c), 2)] for c in codes], int).reshape(len(codes), codebooks.shape[0])
    return codebooks[np.arange(codebooks.shape[0])[None, :], index].reshape(len(codes), codebooks.shape[0] * codebooks.shape[2]) / SCALE


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _op13_sql() -> str:
    near = "SELECT q.rid, q.part, b.entry, sum((q.v - b.v) * (q.v - b.v)) AS d FROM q JOIN {b} b ON b.part = q.part AND b.j = q.j GROUP BY q.rid, q.part, b.entry"
    best = f"SELECT rid, part, min({{{{'d': d, 'entry': entry}}}}) AS m FROM ({near}) GROUP BY rid, part"
    text = f"""
WITH k AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT len(embedding) // {PARTS} AS width FROM k LIMIT 1),
q AS (SELECT rid, i // width AS part, i % width AS j, floor(embedding[i + 1]::DOUBLE * {SCALE})::BIGINT AS v FROM (SELECT rid, embedding, unnest(range(len(embedding))) AS i FROM k), w),
b0 AS (SELECT part, rid - 1 AS entry, j, v FROM q WHERE rid <= {ENTRIES})"""
    for i in range(ROUNDS):
        text += f""",
a{i} AS MATERIALIZED ({best.format(b=f"b{i}")}),
c{i} AS (SELECT q.part, m.entry AS entry, q.j, floor(sum(q.v)::DOUBLE / count(*))::BIGINT AS v FROM q JOIN a{i} ON a{i}.rid = q.rid AND a{i}.part = q.part GROUP BY q.part, m.entry, q.j),
b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.j, coalesce(c.v, b.v) AS v FROM b{i} b LEFT JOIN c{i} c ON c.part = b.part AND c.entry = b.entry AND c.j = b.j)"""
    return f"""{text},
f AS ({best.format(b=f"b{ROUNDS}")}),
g AS (SELECT rid, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM f GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, j)) FROM b{ROUNDS}) AS codebooks_sha256
FROM k JOIN g ON g.rid = k.rid"""


OP13_SQL = _op13_sql()
