"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as make it none of the columns, in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode.

    On a cluster a machine's own folder would lose rows, so there the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="framewright-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Workspace:
    """Tables written to the shared folder, so that lineage ends there and a lost executor loses nothing.

    drop() deletes what is no longer read; the last tables stay, as the lazily read result needs them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/framewright-{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._framewright_path = path
        self.tables.append(out)
        return out

    def keep_only(self, *tables: DataFrame) -> None:
        """Drops all tables but those given."""
        self.drop(*[x for x in self.tables if not any(x is y for y in tables)])

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._framewright_path)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        self.tables = [x for x in self.tables if not any(x is y for y in tables)]

