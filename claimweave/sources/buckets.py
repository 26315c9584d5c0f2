"""Stored tables in buckets of keys, of which a batch rewrites only those that it touches.

A batch writes each bucket that changes, whole, to ``table/batch=n/bucket=b``, and last of all a marker that says for every
table in which batch each of its buckets was written. Readers follow the last marker, so nothing of a batch is seen
before all of it is there, a batch that broke off is written over when it is replayed, and the files of
other buckets stay. The marker has a number for each table and bucket.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """``schemas``: the columns of each table; ``keys``: the column that its rows are dealt by, none for tables that are only added to."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], keys: dict[str, str], buckets: int = 16):
        self.spark, self.folder, self.schemas, self.keys, self.buckets = spark, folder, schemas, keys, buckets
        self.last, self.where = self._marker()
        self.next: dict[str, dict[str, int]] = {name: dict(of) for name, of in self.where.items()}

    def _files(self, pattern: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return [f.getPath().toString() for f in found or []]

    def _marker(self) -> tuple[int, dict[str, dict[str, int]]]:
        done = [int(p.split("/")[-2].removeprefix("batch=")) for p in self._files("_markers/batch=*/_SUCCESS")]
        if not done:
            return -1, {name: {} for name in self.schemas}
        return max(done), json.loads(self.spark.read.text(f"{self.folder}/_markers/batch={max(done)}").first()[0])

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """The buckets that the keys of ``rows`` are in."""
        return sorted(r[0] for r in rows.select(self.bucket(F.col(key))).distinct().collect())

    def read(self, name: str, only: list[int] | None = None) -> DataFrame:
        """The table as of the last marker; of some buckets, if given."""
        paths = [f"{self.folder}/{name}/batch={n}" + (f"/bucket={b}" if self.keys.get(name) else "") for b, n in self.where[name].items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schemas[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[name])

    def put(self, batch: int, name: str, rows: DataFrame, only: list[int]) -> None:
        """The whole new content of the buckets ``only``; of a table without a key, rows that are added."""
        path, rows = f"{self.folder}/{name}/batch={batch}", rows.select(*self.spark.createDataFrame([], self.schemas[name]).columns)
        key = self.keys.get(name)
        if not key:
            rows.write.mode("overwrite").parquet(path)
            self.next[name][str(batch)] = batch
            return
        dealt = rows.withColumn("bucket", self.bucket(F.col(key)))
        dealt.repartition(max(1, len(only)), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)
        written = {int(p.rsplit("=", 1)[1]) for p in self._files(f"{name}/batch={batch}/bucket=*")}
        for b in only:
            if b in written:
                self.next[name][str(b)] = batch
            else:
                self.next[name].pop(str(b), None)  # no row is left in it

    def commit(self, batch: int) -> None:
        rows = self.spark.createDataFrame([(json.dumps(self.next),)], "value string")
        rows.coalesce(1).write.mode("overwrite").text(f"{self.folder}/_markers/batch={batch}")
        self.last, self.where = batch, {name: dict(of) for name, of in self.next.items()}

    def vacuum(self) -> int:
        """Delete batches of tables that the last marker doesn't name; for a time without readers of older markers."""
        jvm, gone = self.spark._jvm, 0
        for name, of in self.where.items():
            for path in self._files(f"{name}/batch=*"):
                if int(path.rsplit("=", 1)[1]) not in of.values():
                    where = jvm.org.apache.hadoop.fs.Path(path)
                    where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
                    gone += 1
        return gone
