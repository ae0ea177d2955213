"""Session helpers: reading tables, cutting lineage, numbering rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names.

    Where none is named, a session within one process, as in tests, gets a
    folder of its own; on a cluster that would be lost with its machine, so it
    is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a reliable checkpoint.

    The files lie in the shared checkpoint folder, so a lost executor costs
    only its running tasks.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def number_rows(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds ``out``, 1..n in the order of the columns, which must tell all rows apart.

    Rows are sorted in ranges and numbered within them; only the sizes of the
    ranges, as many as there are partitions, reach the driver.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")
    sizes = {r[0]: r[1] for r in placed.groupBy(part).count().collect()}
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    start = F.create_map(*[x for p, s in starts.items() for x in (F.lit(p), F.lit(s))])[part] if starts else F.lit(0)
    return placed.withColumn(out, start + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the plan; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
