"""What the operators share: the staging folder, row limits of Arrow batches, word patterns."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of bytes other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch sent to Python; texts are long, so far fewer than Spark's 10,000.
ARROW_ROWS = 512

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured a local session gets a temporary
    one; a cluster is refused, as its executors would write to their own disks."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="epistle-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, so that a Python worker's memory is bounded. The session keeps the
    setting, since plans run later; a smaller one of the caller's stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for what runs inside: narrow rows may come in larger batches than texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def own_prefix(df: DataFrame, start: str = "_own") -> str:
    """A beginning that no column of df has, for columns of an operator's own."""
    while any(c.lower().startswith(start) for c in df.columns):
        start += "_"
    return start


def stage(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and a
    lost executor costs only a re-read. The files go when the driver process ends or
    `release` is called."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/epistle/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    df.write.option("compression", codec).parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.staged_path = path
    return read


def discard(staged: DataFrame) -> None:
    """Delete what `stage` wrote for this table; nothing that is still to run may read it."""
    spark, path = staged.sparkSession, staged.staged_path
    _staged.remove((spark, path))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete everything that `stage` has written in this process."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop()[1])
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _release_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None and _staged:
        release(spark)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of a column as text, modulo; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
