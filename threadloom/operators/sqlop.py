"""SQL operators: a body over canonical tables, run on Spark and given as a twin for checks."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.operators import registry
from threadloom.operators.dialect import expand
from threadloom.plans.canonical import CANONICAL

BODIES: dict[str, str] = {}
#: Operators that frames make in steps, where one body would work the same out again and again.
STEPS: dict[str, Callable[..., DataFrame]] = {}
_number = itertools.count()


def _tables(body: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", body)))


def apply(name: str, **frames: DataFrame) -> DataFrame:
    """Run operator ``name`` on the given canonical frames (messages=..., results=..., ...)."""
    return STEPS[name](**frames) if name in STEPS else run(BODIES[name], frames)


def run(body: str, frames: dict[str, DataFrame]) -> DataFrame:
    spark, text = next(iter(frames.values())).sparkSession, expand(body, spark=True)
    for table, frame in frames.items():
        view = f"tl_{table}_{next(_number)}"
        frame.createOrReplaceTempView(view)
        text = text.replace("{" + table + "}", view)
    return spark.sql(text)


def canonical(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A canonical table of a folder of driver tables, or one of these themselves."""
    if table not in CANONICAL:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet")
    sources, body = CANONICAL[table]
    return run(body, {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in sources})


def twin(body: str) -> str:
    """The same query as one SQL text over the driver's tables."""
    parts = []
    for table in _tables(body):
        if table in CANONICAL:
            parts.append(f"{table}_c AS ({expand(CANONICAL[table][1], spark=False)})")
            body = body.replace("{" + table + "}", f"{table}_c")
    text = (f"WITH {', '.join(parts)} SELECT * FROM ({expand(body, spark=False)}) AS q") if parts else expand(body, spark=False)
    return re.sub(r"\{([a-z]\w*)\}", r"\1", text)


def operator(name: str, body: str, oracle: bool = True, check: str | None = None, steps: Callable[..., DataFrame] | None = None) -> None:
    """Register a body under ``name``; ``check`` is a twin written on its own, from the definition; ``steps`` makes the same on Spark."""
    BODIES[name] = body
    if steps:
        STEPS[name] = steps
    registry.register(name, lambda spark, sf_dir: apply(name, **{t: canonical(spark, sf_dir, t) for t in _tables(body)}), twin(check or body) if oracle else None)
