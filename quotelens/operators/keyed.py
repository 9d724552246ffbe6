"""Keyed tables in hash buckets: a batch rewrites only the buckets that its keys fall into.

A bucket is a partition folder, replaced as a whole by a dynamic partition overwrite. Every row carries the number of the
last batch its bucket took in. A batch that is replayed after a lost driver skips the buckets that already have it, so a
fold that adds up counts is exact as well.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import cut

Fold = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class KeyedTable:
    """``schema`` under ``root``; rows equal in the columns ``by`` share one of ``buckets`` buckets.

    The number of buckets is part of the path: choose it so that a bucket is some hundred megabytes.
    """

    spark: SparkSession
    root: str
    schema: StructType
    by: tuple[str, ...]
    buckets: int = 64

    @property
    def path(self) -> str:
        return f"{self.root}/de={self.buckets}"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        whole = StructType([*self.schema, StructField("lote", LongType()), StructField("cubo", IntegerType())])
        return self.spark.read.schema(whole).parquet(self.path) if self._exists() else self.spark.createDataFrame([], whole)

    def _exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame:
        return self._stored().drop("lote", "cubo")

    def of(self, delta: DataFrame) -> DataFrame:
        """The rows of the buckets that the keys of ``delta`` fall into."""
        touched = [r[0] for r in delta.select(self.bucket()).distinct().collect()]  # at most `buckets` numbers
        return self._stored().filter(F.col("cubo").isin(touched)).drop("lote", "cubo")

    def merge(self, delta: DataFrame, fold: Fold, lote: int) -> list[int]:
        """Take batch number ``lote`` in; the buckets that were rewritten.

        ``fold(old, delta)`` gives all rows of the buckets it gets. It sees whole buckets, so it may join and group by any key
        that begins with ``by``. It must not remove the last row of a bucket.
        """
        d = cut(delta.withColumn("cubo", self.bucket()))
        touched = [r[0] for r in d.select("cubo").distinct().collect()]  # at most `buckets` numbers
        old = self._stored().filter(F.col("cubo").isin(touched))
        done = {r[0] for r in old.groupBy("cubo").agg(F.max("lote").alias("l")).filter(F.col("l") >= lote).collect()}
        todo = sorted(set(touched) - done)
        if todo:
            mine = F.col("cubo").isin(todo)
            new = fold(old.filter(mine).drop("lote", "cubo"), d.filter(mine).drop("cubo")).select(*self.schema.names)
            rows = new.withColumns({"lote": F.lit(lote).cast("long"), "cubo": self.bucket()}).repartition(min(len(todo), self._parts()), "cubo")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cubo").parquet(self.path)
        return todo

    def _parts(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))


def latest(keys: tuple[str, ...], seq: str) -> Fold:
    """Of old and new rows of a key the one with the greatest ``seq`` stays: late and repeated rows change nothing."""
    def fold(old: DataFrame, delta: DataFrame) -> DataFrame:
        both = old.unionByName(delta.select(*old.columns))
        # `seq` leads the row, so it is shuffled once and not beside the row as well
        row = F.struct(seq, *[c for c in old.columns if c not in (*keys, seq)])
        return both.groupBy(*keys).agg(F.max(row).alias("v")).select(*keys, "v.*")

    return fold


def replacing(keys: tuple[str, ...]) -> Fold:
    """New rows take the place of all old rows of their key."""
    return lambda old, delta: old.join(delta.select(*keys).distinct(), list(keys), "left_anti").unionByName(delta.select(*old.columns))
