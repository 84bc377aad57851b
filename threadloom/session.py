"""Sessions, and making this package importable for Python workers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Put the folder that holds this package on the workers' path; it must be there on every machine."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    path = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in path:
        env["PYTHONPATH"] = ":".join([*path, root])
    return spark


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
