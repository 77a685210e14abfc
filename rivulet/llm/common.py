"""Session helpers of the llm operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most about 50 bytes that a join may broadcast (15 MB).
BROADCAST_ROWS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` is read from the session; where nothing is set a
    local session (tests, a laptop) uses a temporary folder, and any other is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(named)
    return f"{named.rstrip('/')}/{sc.applicationId}"


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder: it survives lost executors.

    Other than a checkpoint, a table has its real size, so size estimates don't
    pile up, and its columns are pruned when it is read.  Tables go when the driver ends, or by
    discard().
    """
    name = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    return keep_until_end(df, name)


def keep_until_end(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as the Parquet table ``name`` and read back; it is removed when the driver ends."""
    spark = df.sparkSession
    fs, path = _path(spark, name)
    fs.deleteOnExit(path)
    df.write.parquet(name)
    out = spark.read.schema(df.schema).parquet(name)
    out._written_to = name
    return out


def discard(*tables: DataFrame) -> None:
    """Removes what materialize() wrote, when no plan reads it any more."""
    for df in tables:
        fs, path = _path(df.sparkSession, df._written_to)
        fs.delete(path, True)


def quoted(name: str) -> str:
    """A column name as an expression, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def fresh(names: Iterable[str], wanted: str) -> str:
    """A column name that is not yet taken (case-insensitively)."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def remainder(id_col: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")), F.lit(mod)), F.lit(0)).cast("int")


def counted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, fixed, and marked for broadcast if it has at most ``rows`` rows; beyond that joins shuffle."""
    df = materialize(df)
    return F.broadcast(df) if df.count() <= rows else df
