"""The folder that driver and executors share, and files in it.

Every write of a task goes to a name of its own; which files count is said by a manifest that Spark commits, so a task that
runs twice, or an executor that is lost, leaves no half file in a result.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: The largest side that is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Bytes of a batch of texts, on the JVM's side and in Python.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; one of our own only in local mode where it is unset, as in tests."""
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SETTING} is not set: executors need a folder that all share")
    base = base or "file:///tmp/checkpoints/airgrid"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def as_uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


#: What Hadoop calls a scheme, and what pyarrow does.
_SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "wasbs://": "abfss://"}


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's filesystem for a path, on a driver or an executor alike; a scheme that it lacks is an error that says so."""
    for hadoop, ours in _SCHEMES.items():
        path = ours + path.removeprefix(hadoop) if path.startswith(hadoop) else path
    if path.startswith("hdfs:/") and not path.startswith("hdfs://"):
        path = "hdfs://default" + path.removeprefix("hdfs:")
    if path.startswith("dbfs:/"):  # mounted on every machine
        path = "/dbfs" + path.removeprefix("dbfs:")
    return pafs.FileSystem.from_uri(as_uri(path).replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else as_uri(path))


def text_batches(spark: SparkSession) -> None:
    """From now on, batches of rows that this session hands to Python hold about BATCH_BYTES, not 64 MB; another setting stays."""
    if spark.conf.get(_BATCH) in ("67108864b", "64m"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def inner(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with the inner names c0, c1, ..., which none of ours equals, and its own names, to be given back by toDF."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), df.columns


def place(names: list[str], want: str) -> str:
    """The inner name of a column: the one so written, else the only one so written but for case."""
    same = [k for k, c in enumerate(names) if c == want] or [k for k, c in enumerate(names) if c.lower() == want]
    if len(same) != 1:
        raise ValueError(f"one column {want} is needed, there are {len(same)}")
    return f"c{same[0]}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage cut, whole if executors are lost."""
    path = fresh(df.sparkSession, what)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


class Scratch:
    """The tables and broadcasts of one call: broadcasts are destroyed as soon as the table that needs them is written, tables when
    they are dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sent, self.tables = spark, [], []

    def send(self, value):
        self.sent.append(self.spark.sparkContext.broadcast(value))
        return self.sent[-1]

    def written(self, df: DataFrame, what: str) -> DataFrame:
        """df as a table; what has been sent so far is for it or tables before it."""
        path, schema = fresh(self.spark, what), df.schema
        df.write.parquet(path)
        while self.sent:
            self.sent.pop().destroy()
        table = self.spark.read.schema(schema).parquet(path)
        self.tables.append((table, path))
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables of this call that nothing reads any more; others are left alone."""
        for table, path in [x for x in self.tables if any(x[0] is t for t in tables)]:
            self.tables = [x for x in self.tables if x[0] is not table]
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def size_of(table: DataFrame) -> int:
    """Bytes of a stored table's rows as Spark estimates them from its files, for which a factor of 8 allows: they are compressed."""
    return 8 * int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(table: DataFrame) -> bool:
    """Whether a stored table may be broadcast."""
    return size_of(table) <= BROADCAST_BYTES and table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def bounded_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left joined with a stored right side: broadcast while it is small, else by shuffles on the key."""
    return left.join(F.broadcast(right) if small(right) else right, on, how)
