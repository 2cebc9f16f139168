"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cairn", **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application, wherever it was started from."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        package = Path(__file__).resolve().parent
        folder = Path(tempfile.mkdtemp(prefix="spark-cairn-"))
        copy = folder / "root" / package.name
        shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
        _SHIPPED[application] = shutil.make_archive(str(folder / f"cairn-{uuid.uuid4().hex[:8]}"), "zip", folder / "root")
        spark.sparkContext.addPyFile(_SHIPPED[application])


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that makes sure the workers have the package before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return query(spark, folder)

    return run


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests on one machine) is a local folder made and kept for the session.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.cairn.scratch", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-cairn-", dir="/tmp")
        spark.conf.set("spark.cairn.scratch", named)
    return named.rstrip("/")


_ROOTS: list[str] = []


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that operators of this session wrote to the shared folder; results read from them are gone then."""
    jvm = spark._jvm
    while _ROOTS:
        path = jvm.org.apache.hadoop.fs.Path(_ROOTS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables written to the shared folder by one run of an operator.

    ``save`` writes a frame as Parquet and gives it back read from there, so that neither a lost executor nor a
    long loop makes Spark recompute what came before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._count = 0
        _ROOTS.append(self.root)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count:04d}-{name}"
        df.write.mode("overwrite").parquet(path)
        # the schema is known, so no job has to read the footers again
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cairn_path = path
        return out

    def together(self, frames: list[DataFrame]) -> DataFrame:
        """The rows of several tables of one schema made by ``save``, as one scan."""
        return self.spark.read.schema(frames[0].schema).parquet(*[df._cairn_path for df in frames])
