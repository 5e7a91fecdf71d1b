"""Joins with a side of checked size, top-k per group, and folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NumericType, StringType, StructType

#: Rows and bytes up to which a side is broadcast after it was measured.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 128 << 20


def _bytes(c: Column, kind: DataType) -> Column:
    if isinstance(kind, StringType):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, NumericType):
        return F.greatest(F.size(c), F.lit(0)) * 8
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return F.lit(8)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most `rows` rows and about `size` bytes; computes it once."""
    each = sum((_bytes(F.col(f"`{f.name}`"), f.dataType).cast("long") for f in df.schema.fields), F.lit(0).cast("long"))
    n, held = df.select(each.alias("b")).limit(rows + 1).agg(F.count("*"), F.sum("b")).first()
    return n <= rows and (held or 0) <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it fits(), else as it is: Spark then shuffles both sides."""
    return F.broadcast(df) if fits(df, rows, size) else df


def over_cores(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if it is scanned in fewer tasks, as small tables in one file are; larger ones are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints, set for this session: spark.checkpoint.dir, or on a local master a new one.

    On a cluster a folder of its own would be another on each machine, so there it must be named.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="evigrain-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in that folder."""
    return f"{checkpoint_dir(spark)}/evigrain-{tag}-{uuid.uuid4().hex}"


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1. Spark cuts each task's rows to k a group before the shuffle."""
    if k <= 0:
        raise ValueError("k must be positive")
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first by order."""
    return top_k(df, key, order, 1, "_first").drop("_first")


def require_none(df: DataFrame, message: str) -> None:
    """Raise if df has a row; used for validations, which look for one offender only."""
    found = df.limit(1).collect()
    if found:
        raise ValueError(f"{message}: {found[0].asDict(recursive=True)}")
