"""Mixing sources to target weights, by hierarchical budgets.

The leaves of a tree domain - language - source hold documents.  A token budget starts at the
root and is split among children by weight; a child can take no more than it holds times
``epochs``.  What it can't take goes to its siblings, by their weights again, until none has
room; only what all of them can't take goes back to the ancestors, to be shared among the
parent's siblings.  Since a node's room is known beforehand, one pass from the root does that.
Budgets are whole tokens, and what rounding leaves over goes to the largest fractions.

Each leaf takes the shortest prefix of its seeded order that reaches its budget: whole epochs,
then part of the next, each epoch in an order of its own.  Orders come from hashes of seed,
epoch and document, so nothing is sorted as a whole: tokens are summed by leaf, epoch and
``CELLS`` ranges of the hash, the range in which a leaf's budget runs out is found among these
sums, and only rows of that range are put in order.

Defined results: a token is a word (run without white space); null and empty texts have none
and are taken where the prefix passes them; null languages or sources are children like
others, named '' ; rows that agree in everything share a hash and are taken in
any order; weights that are missing are 0 if their siblings have weights, else all are equal;
a budget over what there is takes everything ``epochs`` times.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.llm.keep import keep_rows
from threadloom.workspace import fresh, materialize, small_table

CELLS = 4096
#: Most leaves whose sums the driver handles; sources are labels, not data, and beyond this they must be grouped.
LEAVES = 100_000


@dataclass(frozen=True)
class Targets:
    """Weights by path: (domain,), (domain, language), (domain, language, source)."""

    weights: dict[tuple[str, ...], float] = field(default_factory=dict)
    share: float = 0.8  # of all tokens, unless ``budget`` is given
    budget: int | None = None
    epochs: int = 1
    seed: int = 17


def split(amount: int, rooms: list[int], weights: list[float]) -> list[int]:
    """``amount`` among children by weight, none over its room; shortages go to the siblings.

    Children without weight take only what those with weight can't.
    """
    amount = min(amount, sum(rooms))
    given = [0] * len(rooms)
    for group in (True, False):
        open_ = [i for i, w in enumerate(weights) if (w > 0) == group and rooms[i] > 0]
        while open_ and amount > 0:
            total = sum(weights[i] for i in open_) if group else float(len(open_))
            part = {i: amount * (weights[i] if group else 1.0) / total for i in open_}
            full = [i for i in open_ if part[i] >= rooms[i]]
            if full:
                for i in full:
                    given[i] = rooms[i]
                    amount -= rooms[i]
                open_ = [i for i in open_ if i not in full]
                continue
            for i in open_:
                given[i] = int(part[i])
            rest = amount - sum(given[i] for i in open_)
            order = sorted(open_, key=lambda i: (int(part[i]) - part[i], i))
            while rest > 0:
                for i in order:
                    if rest > 0 and given[i] < rooms[i]:
                        given[i] += 1
                        rest -= 1
            amount = 0
    return given


def budgets(leaves: dict[tuple[str, ...], int], targets: Targets) -> dict[tuple[str, ...], int]:
    """Tokens for each leaf; ``leaves`` has how many each holds."""
    rooms: dict[tuple[str, ...], int] = {}
    children: dict[tuple[str, ...], set] = {}
    for path, tokens in leaves.items():
        for k in range(len(path) + 1):
            rooms[path[:k]] = rooms.get(path[:k], 0) + tokens * targets.epochs
            if k:
                children.setdefault(path[: k - 1], set()).add(path[:k])
    total = targets.budget if targets.budget is not None else int(sum(leaves.values()) * targets.share)
    given = {(): min(total, rooms.get((), 0))}
    for k in range(3):
        for parent in sorted(p for p in list(given) if len(p) == k):
            kids = sorted(children.get(parent, ()))
            weights = [targets.weights.get(c, 0.0) for c in kids]
            weights = weights if any(weights) else [1.0] * len(kids)
            given.update(zip(kids, split(given[parent], [rooms[c] for c in kids], weights), strict=True))
    return {p: given.get(p, 0) for p in leaves}


def by_number(source: Column) -> Column:
    """Domains of the generated sources: src0 ... src19 in four domains; others, and null, are in domain0."""
    number = F.coalesce(F.regexp_extract(source, r"(\d{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.concat(F.lit("domain"), F.pmod(number, F.lit(4)).cast("string"))


#: Production weights of the query: of domains, and of languages in each.
WEIGHTS = {(f"domain{d}",): w for d, w in enumerate((0.4, 0.3, 0.2, 0.1))} | {
    (f"domain{d}", x): w for d in range(4) for x, w in (("en", 0.5), ("de", 0.2), ("fr", 0.2), ("es", 0.1))
}


def order_hash(seed: Column, epoch: Column, *what) -> Column:
    """63 bits from md5, which other engines have too."""
    text = F.concat_ws("|", seed.cast("string"), epoch.cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in what])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def choose(docs: DataFrame, targets: Targets, domain=by_number) -> DataFrame:
    """domain, language, source, epoch, doc_id, n_tokens, and the text's md5, of every row taken."""
    return _choose(docs, targets, domain)[1]


def _choose(docs: DataFrame, targets: Targets, domain) -> tuple[DataFrame, DataFrame]:
    """All rows, and those taken."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        domain(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("language"), F.coalesce("source", F.lit("")).alias("source"), "doc_id",
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"), F.md5(text.cast("binary")).alias("g"),
    ).withColumn("domain", F.coalesce("domain", F.lit("")))
    rows = materialize(rows, "tokens")
    path = ["domain", "language", "source"]
    sums = rows.groupBy(*path).agg(F.sum("n_tokens").alias("n")).limit(LEAVES + 1).collect()
    if len(sums) > LEAVES:
        raise ValueError(f"more than {LEAVES} leaves: group sources first")
    leaves = {(r.domain, r.language, r.source): r.n for r in sums}
    plan = [(*p, b // leaves[p] if leaves[p] else 0, b % leaves[p] if leaves[p] else 0) for p, b in budgets(leaves, targets).items()]
    plan = small_table(spark, plan, "domain string, language string, source string, whole int, part long")  # at most LEAVES rows
    leaf = rows.join(F.broadcast(plan), path)
    whole = leaf.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    last = leaf.where("part > 0").withColumn("epoch", F.col("whole")).withColumn("h", order_hash(F.lit(targets.seed), F.col("epoch"), "doc_id", "g"))
    last = last.withColumn("cell", F.shiftright("h", 60 - 12).cast("int"))
    cells = last.groupBy(*path, "cell").agg(F.sum("n_tokens").alias("n"), F.first("part").alias("part"))
    before = F.sum("n").over(Window.partitionBy(*path).orderBy("cell")) - F.col("n")  # at most CELLS rows a leaf
    cells = cells.withColumn("before", before).where("before < part").select(*path, "cell", "before", (F.col("before") + F.col("n") > F.col("part")).alias("cut"))
    near = last.join(cells, [*path, "cell"])
    running = Window.partitionBy(*path).orderBy("h", "doc_id", "g").rowsBetween(Window.unboundedPreceding, -1)
    cut = near.where("cut").withColumn("sum", F.col("before") + F.coalesce(F.sum("n_tokens").over(running), F.lit(0))).where("sum < part")
    columns = [*path, "epoch", "doc_id", "n_tokens", "g"]
    return rows, whole.select(*columns).unionByName(near.where("not cut").select(*columns)).unionByName(cut.select(*columns))


def mix(docs: DataFrame, targets: Targets, domain=by_number) -> DataFrame:
    """The documents taken, with all their columns; more than once over several epochs."""
    rows, taken = _choose(docs, targets, domain)
    taken = taken.groupBy("doc_id", "g").agg(F.count("*").alias("times"))
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    if targets.epochs == 1:
        every = rows.groupBy("doc_id", "g").agg(F.count("*").alias("rows")).alias("every")
        same = (F.col("every.g") == F.col("taken.g")) & F.col("every.doc_id").eqNullSafe(F.col("taken.doc_id"))
        found = every.join(taken.alias("taken"), same, "left").select(F.col("every.g").alias("digest"), "every.doc_id", "rows", F.coalesce("times", F.lit(0)).alias("times"))
        return keep_rows(docs, text, found, [F.lit(1)])
    key, mine, nth, times = (fresh(docs, x) for x in ("g", "id", "nth", "times"))
    taken = taken.withColumnsRenamed({"doc_id": mine, "g": key, "times": times})
    found = docs.withColumn(nth, text).join(taken, (F.col(nth) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(mine)))
    # repeated rows have been counted together: deal their sum out again
    same = Window.partitionBy(nth, "doc_id")
    rank, size = F.row_number().over(same.orderBy(F.lit(1))), F.count("*").over(same)
    share = F.floor((F.col(times) + size - rank) / size).cast("int")
    found = found.withColumn(nth + "r", share).withColumn(nth + "e", F.explode(F.array_repeat(F.lit(1), F.col(nth + "r"))))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return choose(docs, Targets(WEIGHTS, share=0.8, epochs=2)).drop("g")
