"""Written tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The folder above this package; workers that share it import the package from there.
CODE = str(Path(__file__).resolve().parents[1])


#: Most bytes of an Arrow batch that a Python worker is handed, unless the session asks for less: with long texts, a
#: limit on rows alone doesn't bound a worker's memory.
ARROW_BYTES = 4 << 20


def _bytes(value: str) -> int:
    value = value.lower().removesuffix("b")
    power = "kmgt".find(value[-1:]) + 1 if value[-1:].isalpha() else 0
    return int(value[:-1] if power else value) * 1024**power


def ship_code(spark: SparkSession) -> None:
    """Let Python workers that see the repository import this package (on a cluster, pass it with --py-files), in small batches:
    the session's limit stays lowered, as plans run after the call that made them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(key, "64m")) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))
    env = spark.sparkContext.environment
    if CODE not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), CODE) if x)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the session names it; where it is unset, a temporary folder, but only in a session of one machine.

    What is written there stays: the operators drop the tables they no longer need, and whoever runs a query drops its result.
    """
    ship_code(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API, so that any store works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one run. An executor may be lost at any time: every table is on shared storage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: list[DataFrame] = []

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.tables.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Forget tables that no later plan reads."""
        for t in tables:
            drop_path(self.spark, t._scratch_path)
        self.tables = [t for t in self.tables if t not in tables]

    def drop_all(self, but: DataFrame) -> None:
        """Forget all tables but the one that a run returns; that one belongs to the caller, who drops it with drop_path."""
        self.drop(*(t for t in self.tables if t is not but))
