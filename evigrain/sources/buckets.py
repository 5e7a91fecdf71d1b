"""A catalog in hash buckets: an upsert rewrites the buckets it touches and no others, and a batch applied twice counts once.

Under the path: settings/ (one row) and rows/bucket=B. Rows carry the batch that brought them first and the batch that
changed them last. Writes are Spark's dynamic partition overwrite: each bucket is replaced as a whole, so after a failure
some buckets hold the batch and some don't; the same batch again changes only the latter. Batches are numbered upwards.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.shared import require_none
from .files import exists

_OWN = "first_batch long, last_batch long, bucket int"


@dataclass(frozen=True)
class Catalog:
    spark: SparkSession
    path: str
    key: str
    buckets: int
    schema: StructType

    def rows(self) -> DataFrame:
        """All rows, with first_batch, last_batch and bucket; none before the first upsert."""
        return self.spark.read.schema(StructType([*self.schema.fields, *StructType.fromDDL(_OWN).fields])).parquet(f"{self.path}/rows")

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, new: DataFrame) -> list[int]:
        """The buckets of the keys of new; `buckets` numbers at most."""
        return sorted(r[0] for r in new.select(self.bucket_of(F.col(self.key))).distinct().collect())

    def fresh(self, new: DataFrame, batch: int) -> DataFrame:
        """The rows of new whose key no earlier batch has brought, whether or not this one was begun before."""
        known = self.rows().where(F.col("bucket").isin(self.touched(new)) & (F.col("first_batch") < batch)).select(self.key)
        return new.join(known, self.key, "left_anti").select(*new.columns)

    def upsert(self, new: DataFrame, batch: int, combine: dict[str, Callable[[Column, Column], Column]] | None = None) -> list[int]:
        """Put the rows of new, one a key, into their buckets; the buckets that were rewritten.

        For a key that is there, `combine` gives a column's value from the old and the new one; columns that it doesn't
        name stay as they are. A key that this batch or a later one has changed already stays as it is.
        """
        combine = combine or {}
        rows = new.select(*self.schema.names)
        require_none(rows.groupBy(self.key).count().where(f"count > 1 or {self.key} is null"), "a batch has a key twice, or none")
        at = self.touched(rows)
        if not at:
            return at
        old = self.rows().where(F.col("bucket").isin(at)).drop("bucket")
        named = rows.select(F.col(self.key), F.lit(True).alias("_is"), *[F.col(c).alias(f"_new_{c}") for c in self.schema.names if c != self.key])
        both = old.join(named, self.key, "full_outer")
        there, due = F.col("first_batch").isNotNull(), F.col("_is") & (F.coalesce(F.col("last_batch"), F.lit(-1)) < batch)

        def value(c: str) -> Column:
            was, now = F.col(c), F.col(f"_new_{c}")
            return F.when(~there, now).when(due, combine[c](was, now)).otherwise(was) if c in combine else F.when(there, was).otherwise(now)

        out = both.select(
            F.col(self.key), *[value(c).cast(self.schema[c].dataType).alias(c) for c in self.schema.names if c != self.key],
            F.coalesce("first_batch", F.lit(batch)).cast("long").alias("first_batch"), F.when(due, F.lit(batch)).otherwise(F.col("last_batch")).cast("long").alias("last_batch"),
        ).withColumn("bucket", self.bucket_of(F.col(self.key)))
        # the old rows are read before the buckets' new files take their place at the end of the job
        out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")
        return at


def catalog(spark: SparkSession, path: str, schema: StructType | str, key: str, buckets: int = 64) -> Catalog:
    """The catalog at a path, new or made before with these settings."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if buckets <= 0 or key not in schema.names:
        raise ValueError("a catalog has a key column and at least one bucket")
    if exists(spark, f"{path}/settings"):
        found = spark.read.schema("key string, buckets int").json(f"{path}/settings").first()
        if (found["key"], found["buckets"]) != (key, buckets):
            raise ValueError(f"the catalog at {path} has other settings")
    else:
        spark.range(1).select(F.lit(key).alias("key"), F.lit(buckets).alias("buckets")).write.mode("overwrite").json(f"{path}/settings")
    made = Catalog(spark, path, key, buckets, schema)
    if not exists(spark, f"{path}/rows"):
        empty = spark.createDataFrame([], made.schema).withColumns({"first_batch": F.lit(0).cast("long"), "last_batch": F.lit(0).cast("long"), "bucket": F.lit(0)})
        empty.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
    return made


__all__ = ["Catalog", "catalog"]
