"""What several operators need: shared storage, bounded Arrow batches, names that don't clash, fitted linear models."""

from __future__ import annotations

import atexit
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of the Arrow batches that go to Python, unless the session sets its own: texts may be long, and both sides hold a batch whole.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20
#: Bytes of input that one partition of a shuffle is meant for, at most.
SLOT_BYTES = 32 << 20
#: Folders that stored() has written, by the scratch() they belong to; the first list is the session's.
_WRITTEN: list[list[str]] = [[]]


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors of a cluster share.

    Where that setting is empty, as in tests, a temporary folder takes its place, if all runs on one machine; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidegrid-")
        spark.sparkContext.setCheckpointDir(base)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def deleted(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared storage; one that is gone already is no error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What stored() writes inside is deleted at the end; results that read it must be written before."""
    mine: list[str] = []
    _WRITTEN.append(mine)
    try:
        yield
    finally:
        _WRITTEN.remove(mine)
        for path in mine:
            deleted(spark, path)


@atexit.register
def _leave() -> None:
    """Results are lazy, so what they read can go for certain only when the program ends."""
    spark = SparkSession.getActiveSession()
    for path in _WRITTEN[0] if spark else []:
        with suppress(Exception):  # the JVM may have gone before
            deleted(spark, path)


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow in batches of bounded rows and bytes, so that neither Spark nor the workers hold many long texts at once."""
    conf = df.sparkSession.conf
    for key, usual, own in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if conf.get(f"spark.sql.execution.arrow.{key}", usual) == usual:
            conf.set(f"spark.sql.execution.arrow.{key}", str(own))
    return df.mapInArrow(run, schema)


class Sent:
    """A broadcast of a value whose class goes along, so that executors needn't be able to import it."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.raw = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.held: object = None

    def __getstate__(self) -> dict:
        return {"raw": self.raw, "held": None}

    @property
    def value(self):
        if self.held is None:
            self.held = pickle.loads(self.raw.value)
        return self.held


def owned(spark: SparkSession, path: str, schema) -> DataFrame:
    """What has been written to a shared folder, which goes when the scratch() around it ends, or the program."""
    _WRITTEN[-1].append(path)
    return spark.read.schema(schema).parquet(path)


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder; it survives the loss of executors."""
    path = shared_folder(spark)
    df.write.parquet(path)
    return owned(spark, path, df.schema)


def swept(spark: SparkSession) -> None:
    """Lets go of the shuffle files of all but the last run, after steps that leave many: they go with the driver's garbage, which may not be collected for long."""
    spark.sparkContext._jvm.System.gc()


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df, with "_input" added to the name of each column that an output column would clash with."""
    taken = {n.lower() for n in names}
    used = {c.lower() for c in df.columns} | taken
    out = df
    for c in df.columns:
        if c.lower() in taken:
            new = c + "_input"
            while new.lower() in used:
                new += "_"
            used.add(new.lower())
            out = out.withColumnRenamed(c, new)
    return out


def column_at(df: DataFrame, name: str) -> int:
    """The place of a column, whatever the case of its name, as Spark takes names."""
    return [c.lower() for c in df.columns].index(name.lower())


def shuffle_key(seed: int, column: str) -> Column:
    """A pseudo-random string by value; a null has one of its own. DuckDB's md5 gives the same."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("null"))))


def slots(spark: SparkSession, df: DataFrame) -> int:
    """Partitions for a shuffle that carries about as much as the files that df reads have: one for each SLOT_BYTES, and those of the session at least."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    total = sum(x for x in sizes if x < 1 << 60)  # Spark gives the largest number to what it knows nothing of
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-total // SLOT_BYTES))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, ridge: float = 1.0, steps: int = 150) -> np.ndarray:
    """Weights (the bias last) of a ridge logistic regression over sparse features in coordinate form, by Adam over all rows."""
    n = len(y)
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4) if n else 0.5
    w[-1] = np.log(rate / (1 - rate))
    if not n or y.min() == y.max():
        return w
    for k in range(1, steps + 1):
        z = np.bincount(rows, weights=values * w[cols], minlength=n) + w[-1]
        e = (sigmoid(z) - y) / n
        g = np.append(np.bincount(cols, weights=values * e[rows], minlength=width) + ridge * w[:-1] / n, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9) * min(1, 3 * (1 - k / (steps + 1)))
    return w
