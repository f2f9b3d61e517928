"""Tables kept in buckets of a key, of which a change rewrites only those it touches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table, and versions among its live buckets before it is written anew as one.
BUCKETS, VERSIONS = 64, 16


class Buckets:
    """A table in a folder that all executors share: ``version=v/bucket=b`` holds what bucket b had after change v.

    A manifest says of each change which buckets it replaced, and is written last, so a change that fails is none.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: tuple[str, ...], number: int = BUCKETS):
        self.spark, self.folder, self.schema, self.key, self.number = spark, folder, schema, key, number

    def bucket(self, *columns: str) -> Column:
        """The bucket of a key that stands in these columns, or in its own."""
        return F.pmod(F.xxhash64(*(columns or self.key)), F.lit(self.number)).cast("int")

    def touched(self, rows: DataFrame, *columns: str) -> list[int]:
        return sorted(r.bucket for r in rows.select(self.bucket(*columns).alias("bucket")).distinct().collect())  # BUCKETS at most

    def live(self) -> dict[int, int]:
        """The version of each bucket."""
        try:
            rows = self.spark.read.schema("bucket int, version int").parquet(f"{self.folder}/manifest")
            return {r.bucket: r.version for r in rows.groupBy("bucket").agg(F.max("version").alias("version")).collect()}  # BUCKETS at most
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return {}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of some buckets, or all; no other bucket's files are read."""
        by_version: dict[int, list[int]] = {}
        for bucket, version in self.live().items():
            if buckets is None or bucket in buckets:
                by_version.setdefault(version, []).append(bucket)
        parts = [self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.folder}/version={v}").where(F.col("bucket").isin(own)).drop("bucket") for v, own in sorted(by_version.items())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame, buckets: list[int]) -> None:
        """rows are from now on all that these buckets hold."""
        if not buckets:
            return
        live = self.live()
        version = max(live.values(), default=0) + 1
        self._write(rows, buckets, version)
        if len(set(live.values())) > VERSIONS:
            self._write(self.read(), list(range(self.number)), version + 1)

    def _write(self, rows: DataFrame, buckets: list[int], version: int) -> None:
        names = [c.strip().split()[0] for c in self.schema.split(",")]
        # a file a bucket, and more of one that is large; in order of the key, in which files are smaller
        ordered = rows.select(*names).withColumn("bucket", self.bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", *self.key)
        ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/version={version}")
        self.spark.createDataFrame([(b, version) for b in buckets], "bucket int, version int").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
