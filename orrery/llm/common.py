"""What the operators of this subpackage share: the cluster's shared folder, staged tables and table reads."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The code points of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors share.

    Where the session names none, one is made for a local master (as in tests) and an error raised for a cluster.
    """
    if base := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return base.rstrip("/")
    if base := spark.sparkContext.getCheckpointDir():
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-shared-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/orrery/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df``, written once as Parquet in the shared folder and read back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._orrery_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes what ``staged`` wrote, once nothing reads it any more."""
    path = getattr(df, "_orrery_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs inside sends whole texts to Python in batches of ``rows``, so that long ones fit in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, at most ``rows`` at a time and without copying them: what a task makes of whole texts and sends back stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """``c`` with A-Z lower-cased and everything else as it is; ``lower`` does the same, and faster, where all is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


#: A side of a join is broadcast up to so many bytes, as counted; beyond, the other side's rows of a key are dealt over so many tasks.
BROADCAST_BYTES, SALTS = 32 << 20, 64


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def joined(big: DataFrame, small: DataFrame, on: list[str], how: str, spread: Column) -> DataFrame:
    """``big`` joined with ``small``, which is staged and has one row for each key.

    ``small`` is broadcast if its values, counted first, come to no more than ``BROADCAST_BYTES``. Otherwise ``spread``, a
    column of ``big``, salts the join, so that a key with many of the rows is not one task's.
    """
    sizes = [F.octet_length(f.name) if f.dataType.typeName() in ("string", "binary") else F.lit(16) if f.dataType.typeName() != "array" else F.octet_length(F.to_json(f.name)) for f in small.schema]
    n_bytes = small.agg(F.sum(sum((F.coalesce(x, F.lit(0)) for x in sizes), F.lit(32)).cast("long"))).first()[0] or 0
    if n_bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    (salt,) = fresh(big, "__salt")
    left = big.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, salt], how).drop(salt)
