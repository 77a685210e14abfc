"""Named results of a flow: lazy DataFrames, fixed on demand."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names (spark.checkpoint.dir) and driver and executors share.

    Without one a local session uses a temporary folder; any other is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fixed(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, removed when the driver ends: unlike a checkpoint's, its columns are read one by one."""
    spark = df.sparkSession
    name = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(name)
    return spark.read.schema(df.schema).parquet(name)


class State:
    """Results by name.  Lazy ones are plans; ``materialize`` fixes one; copies share nothing mutable."""

    def __init__(self, lazy: dict[str, DataFrame] | None = None, fixed: dict[str, DataFrame] | None = None):
        self._lazy = dict(lazy or {})
        self._fixed = dict(fixed or {})

    def keys(self) -> list[str]:
        return [*self._fixed, *(k for k in self._lazy if k not in self._fixed)]

    def __contains__(self, key: str) -> bool:
        return key in self._fixed or key in self._lazy

    def __getitem__(self, key: str) -> DataFrame:
        return self.stream(key)

    def stream(self, key: str) -> DataFrame:
        """The result, as a plan if it was not fixed."""
        if key in self._fixed:
            return self._fixed[key]
        if key in self._lazy:
            return self._lazy[key]
        raise KeyError(f"no result named {key!r}; there are: {', '.join(self.keys()) or 'none'}")

    def materialize(self, key: str) -> DataFrame:
        if key not in self._fixed:
            self._fixed[key] = cut_lineage(self.stream(key))
            self._lazy.pop(key, None)
        return self._fixed[key]

    def has_snapshot(self, key: str) -> bool:
        return key in self._fixed

    def add_snapshot(self, key: str, df: DataFrame) -> None:
        self._fixed[key] = df

    def add_lazy(self, key: str, df: DataFrame) -> None:
        self._lazy[key] = df

    @property
    def accumulated(self) -> dict[str, DataFrame]:
        return dict(self._fixed)

    def clone(self) -> State:
        return State(self._lazy, self._fixed)

    def with_key(self, key: str, df: DataFrame) -> State:
        other = self.clone()
        other.add_lazy(key, df)
        return other

    def with_checkpoint(self, key: str, df: DataFrame) -> State:
        other = self.clone()
        other.add_snapshot(key, cut_lineage(df))
        return other
