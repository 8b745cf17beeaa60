"""An append-only log and the latest state of each key, written exactly once from a stream.

Spark may play a batch again after a failure. Both tables take that without change: the log keeps each batch in a
folder of its own, which a repeated batch replaces; the latest states are kept by bucket of the key, and a batch writes
a new version of the buckets that it touches, numbered by the batch. It reads the versions before its own, so that
a repeated batch gives the same files. Readers take each bucket's last whole version and never the older ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the folders below a path that are named prefix=number."""
    system, where = _files(spark, path)
    if not system.exists(where):
        return []
    return sorted(int(s.getPath().getName().removeprefix(prefix)) for s in system.listStatus(where) if s.getPath().getName().startswith(prefix))


class LatestTable:
    """Log and latest states below a folder; key is a column, order the columns that say which row is the later one."""

    def __init__(self, spark: SparkSession, folder: str, key: str, order: list[str], schema: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.order, self.schema, self.buckets = spark, folder.rstrip("/"), key, order, schema, buckets

    def versions(self, below: int | None = None) -> dict[int, int]:
        """The last version of each bucket among whole batches, of those before a batch if that is named."""
        whole = [b for b in _names(self.spark, f"{self.folder}/latest", "batch=") if (below is None or b < below) and _files(self.spark, f"{self.folder}/latest/batch={b}/_SUCCESS")[0].exists(_files(self.spark, f"{self.folder}/latest/batch={b}/_SUCCESS")[1])]
        return {k: b for b in whole for k in _names(self.spark, f"{self.folder}/latest/batch={b}", "bucket=")}

    def _read(self, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/latest/batch={b}/bucket={k}" for k, b in sorted(versions.items())))

    def latest(self) -> DataFrame:
        """One row per key: its last."""
        return self._read(self.versions())

    def log(self) -> DataFrame:
        """All rows of whole batches."""
        found = _names(self.spark, f"{self.folder}/log", "batch=")
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/log/batch={b}" for b in found)) if found else self.spark.createDataFrame([], self.schema)

    def batch(self, number: int) -> DataFrame:
        """The rows of one batch, copied, so that they can be played again."""
        copy = f"{self.folder}/copy={number}"
        self.spark.read.schema(self.schema).parquet(f"{self.folder}/log/batch={number}").write.mode("overwrite").parquet(copy)
        return self.spark.read.schema(self.schema).parquet(copy)

    def write(self, batch: DataFrame, number: int) -> None:
        """Takes one batch in; the same number again replaces what it wrote. For use with foreachBatch."""
        names = [f.strip().split(" ")[0] for f in self.schema.split(",")]
        batch.select(*names).write.mode("overwrite").parquet(f"{self.folder}/log/batch={number}")
        rows = self.spark.read.schema(self.schema).parquet(f"{self.folder}/log/batch={number}")
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        # at most one row per bucket comes to the driver
        touched = {r.bucket for r in rows.select(bucket.alias("bucket")).distinct().collect()}
        old = {k: b for k, b in self.versions(number).items() if k in touched}
        both = self._read(old).unionByName(rows) if old else rows
        # of rows equal in order the greatest counts, so that the result does not depend on how they came
        rest = [n for n in names if n != self.key]
        last = both.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(*self.order, *[n for n in rest if n not in self.order])).alias("x")).select(self.key, "x.*")
        last.select(*names).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/latest/batch={number}")

    def tidy(self) -> None:
        """Deletes buckets that a later whole batch has written anew, and batches left without any; the last batch's inputs stay, so that it can be played again."""
        found = _names(self.spark, f"{self.folder}/latest", "batch=")
        keep = {(k, b) for below in (found[-1] if found else None, None) for k, b in self.versions(below).items()}
        for b in found[:-1]:
            for k in _names(self.spark, f"{self.folder}/latest/batch={b}", "bucket="):
                if (k, b) not in keep:
                    system, where = _files(self.spark, f"{self.folder}/latest/batch={b}/bucket={k}")
                    system.delete(where, True)


def run(stream: DataFrame, table: LatestTable, checkpoint: str) -> None:
    """Takes all there is of a stream into the table; a restart with the same checkpoint goes on."""
    query = stream.writeStream.foreachBatch(table.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
