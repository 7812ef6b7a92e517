"""Session helpers shared by every operator: table reading, lineage cuts, bounded broadcasts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Rows that a dimension may have and still be broadcast by name (about 20 MB of bank patterns or mailboxes).
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; a temporary one only for a local master."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="bankspark-checkpoint-")
    sc.setCheckpointDir(named)


def checkpoint_path(spark: SparkSession) -> str:
    """A folder all executors share, for written tables and stream state."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that the side has at most `rows` rows; else leave the join to Catalyst."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: an input of fewer partitions than the cluster has cores (one row group, one small file) is dealt
    out once before work that costs far more than moving it; any other input stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ranked(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """df with its rank (from 1) in the order of the columns, which tell all rows apart. No task holds all rows: they are
    spread by ranges, ranked within a range, and the sizes of the ranges (one row a partition) are summed up."""
    spread = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = spread.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return spread.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once an application, so that workers can import it wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="bankspark-")) / "bankspark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))  # the driver serves the file to executors
    _SHIPPED.add(sc.applicationId)
