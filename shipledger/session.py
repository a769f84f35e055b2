"""Session and checkpoint helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "shipledger", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint.

    Used where a later step reads values that a recomputation could change, such as
    partition numbers. The folder comes from the session; only a local session without
    one gets a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            folder = tempfile.mkdtemp(prefix="shipledger-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def constant_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of rows written in code.

    It is an inline table, whose size the optimizer knows, so a join with it is a broadcast;
    a DataFrame made from a Python list has no known size and would shuffle the other side.
    """
    columns = [part.strip().split(" ", 1) for part in schema.split(",")]
    names = ", ".join(name for name, _ in columns)
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in columns)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")
