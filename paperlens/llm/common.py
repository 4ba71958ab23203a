"""Small helpers that several operators share: input columns, tables in the cluster's shared folder, cached worker state."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A folder of this machine only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="paperlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_PATHS: WeakKeyDictionary = WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    return back


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table_ in tables:
        if path := _PATHS.pop(table_, None):
            delete(table_.sparkSession, path)


#: Rows of a few numbers up to which a stored table is broadcast (a few MB); beyond, the join shuffles.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """A stored table of narrow rows, to be broadcast if it has few of them."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Bytes of an Arrow batch where the session sets no bound: buffers and Python workers stay small, however long the texts are.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, once Arrow batches to Python are bounded in bytes; a bound that the session already sets stays."""
    setting, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(setting, None) is None:
        conf.set(setting, str(BATCH_BYTES))
    return df


_HELD: dict[str, object] = {}


def held(name: str, make):
    """State that a Python worker keeps from task to task. One at a time: what another operator left there goes, so that the
    workers of a long job stay as small as those of its largest step."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def ascii_lower(col):
    """Lower-case A-Z alone. lower() does the same on pure ASCII and is much faster there."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
