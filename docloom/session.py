"""Session helpers: table reading, lineage cutting, and checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows and bytes that go into a broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a directory of files) of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    A cluster names it in ``spark.checkpoint.dir``. A temporary folder is set up only for a local
    master with the setting absent (tests); on a cluster without it this raises, since a folder of
    one machine does not survive there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="docloom-checkpoint-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_out(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as a shuffle has: for work that takes long for its few bytes, where partitions were merged by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _size(dtype: T.DataType, value: Column) -> Column:
    """About the bytes of a value in a broadcast; strings and nested values by what they hold."""
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(dtype, T.ArrayType):
        each = F.aggregate(value, F.lit(0), lambda total, x: total + _size(dtype.elementType, x).cast("int"))
        return F.coalesce(each, F.lit(0)) + 16
    if isinstance(dtype, T.StructType):
        return sum((_size(f.dataType, value.getField(f.name)) for f in dtype.fields), F.lit(8))
    if isinstance(dtype, T.MapType):
        return _size(T.ArrayType(dtype.keyType), F.map_keys(value)) + _size(T.ArrayType(dtype.valueType), F.map_values(value))
    return F.lit(8)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows of at most ``size`` bytes together.

    Counting stops after ``rows + 1`` rows, so pass a ``df`` that is cheap to compute.
    """
    total = sum((_size(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(8)).cast("long")
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(total), F.lit(0))).first()
    return n <= rows and held <= size


def broadcast_checked(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` hinted for broadcast if it is small enough by :func:`fits_broadcast`, else unhinted (a shuffle join)."""
    return F.broadcast(df) if fits_broadcast(df, rows, size) else df
