"""Keys ever seen, in segments that merge geometrically.

Every batch adds one segment. Whenever `fan_out` segments of a level are full they become one of the next
level, so after n batches the keys lie in fewer than fan_out * log(n) segments and each key has
been rewritten log(n) times. Which segments there are follows from the number of batches alone, so a
retried batch or merge writes the same folders again. Merged segments are split by a hash of the key
and a look-up opens only the buckets it asks for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyTable:
    """Batches are numbered 0, 1, 2 ..., each adding keys that are not known yet."""
    path: str
    column: str
    fan_out: int = 8
    buckets: int = 16
    # Columns kept with a key, which then has a row per value.
    payload: tuple[tuple[str, str], ...] = ()

    @property
    def columns(self) -> list[str]:
        return [self.column, *(name for name, _ in self.payload)]

    @property
    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.column), F.lit(self.buckets)).cast("int")

    def segments(self, batches: int) -> list[tuple[int, int]]:
        """(level, first batch) of the segments that hold the keys of the first `batches` batches."""
        out, first, size, level = [], 0, 1, 0
        while size * self.fan_out <= batches:
            size, level = size * self.fan_out, level + 1
        while size:
            while first + size <= batches:
                out.append((level, first))
                first += size
            size, level = size // self.fan_out, level - 1
        return out

    def folder(self, level: int, first: int) -> str:
        return f"{self.path}/level-{level}/from-{first}"

    def _read(self, spark: SparkSession, level: int, first: int, only: list[int] | None = None) -> DataFrame | None:
        try:
            ddl = ", ".join([f"{self.column} string", *(f"{n} {t}" for n, t in self.payload), *(["bucket int"] if level else [])])
            df = spark.read.schema(ddl).parquet(self.folder(level, first))
        except AnalysisException as ex:
            if ex.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        if only is not None:
            df = df.where((F.col("bucket") if level else self.bucket).isin(only))
        return df.select(*self.columns)

    def add(self, keys: DataFrame, batch_id: int) -> None:
        """Keep the new keys of a batch and merge what has become full."""
        spark = keys.sparkSession
        keys.select(*self.columns).write.mode("overwrite").parquet(self.folder(0, batch_id))
        size, level = self.fan_out, 1
        while (batch_id + 1) % size == 0:
            first, part = batch_id + 1 - size, size // self.fan_out
            parts = [p for k in range(self.fan_out) if (p := self._read(spark, level - 1, first + k * part)) is not None]
            merged = reduce(DataFrame.unionByName, parts).distinct().withColumn("bucket", self.bucket)
            merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.folder(level, first))
            size, level = size * self.fan_out, level + 1

    def known(self, spark: SparkSession, batches: int, only: list[int] | None = None) -> DataFrame:
        """Keys of the first `batches` batches, those of some buckets if asked."""
        parts = [p for level, first in self.segments(batches) if (p := self._read(spark, level, first, only)) is not None]
        ddl = ", ".join([f"{self.column} string", *(f"{n} {t}" for n, t in self.payload)])
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ddl)

    def _asked(self, asked: DataFrame) -> list[int]:
        return [r[0] for r in asked.select(self.bucket.alias("b")).distinct().collect()]

    def new(self, asked: DataFrame, batches: int) -> DataFrame:
        """Those of `asked` that the first `batches` batches did not have. `asked` is read twice, so store it."""
        return asked.join(self.known(asked.sparkSession, batches, self._asked(asked)), self.column, "left_anti")

    def find(self, asked: DataFrame, batches: int) -> DataFrame:
        """What the first `batches` batches kept of the keys in `asked`, which is read twice."""
        return self.known(asked.sparkSession, batches, self._asked(asked)).join(asked.select(self.column), self.column, "left_semi").distinct()
