"""Cutting lineage: an intermediate result as a table in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir (or set in the context); a temporary one only for a local master without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dirs:
        own = tempfile.TemporaryDirectory(prefix="arborfold-")
        atexit.register(own.cleanup)
        _own_dirs.append(own.name)
    return _own_dirs[0]


class Cut:
    """Tables written by one operator call; drop() removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/arborfold-{uuid.uuid4().hex}"
        self._n = 0
        _written.append(self.base)
        self._paths: dict[int, tuple[DataFrame, str]] = {}  # holds the tables, so that no other one gets the id of one

    def write(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """df as a written table; it survives the loss of any executor."""
        self._n += 1
        path = f"{self.base}/{self._n}"
        df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if id(t) in self._paths:
                _delete(self.spark, self._paths.pop(id(t))[1])


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Deletes every table that operators of this process have written; results that read them are no longer valid."""
    while _written:
        _delete(spark, _written.pop())
