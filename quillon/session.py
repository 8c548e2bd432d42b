"""Session factory and the shared folder that iterative jobs write to."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "quillon", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` entries use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset, as in local tests, a
    temporary folder is made; on a cluster without the setting that is refused, because a folder of
    one machine would not be seen by the others.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    place = tempfile.mkdtemp(prefix="quillon-")
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", place)
    return place


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Workspace:
    """Tables written to the shared folder to cut lineage; they survive the loss of executors.

    ``keep`` writes a DataFrame once and returns a reader of what was written, so that generated ids
    stay what they are and later steps do not repeat earlier ones. ``drop`` removes a table that no
    later step reads. What is left when the process ends is removed then.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._count = 0
        atexit.register(self._close)

    def keep(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count:04d}"
        df.write.mode("overwrite").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(kept)] = path
        return kept

    def drop(self, kept: DataFrame) -> None:
        path = self._paths.pop(id(kept), None)
        if path:
            _delete(self.spark, path)

    def _close(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session may be gone already
            pass


def observed(seen: Observation, kept: DataFrame, name: str = "n") -> int:
    """The observed count behind a table just written. Where Spark found the plan empty it observes
    nothing: then 0 if the table is empty, and otherwise 1, so that a loop goes on rather than ends."""
    try:
        return seen.get[name] or 0
    except (Py4JError, KeyError, TypeError):
        return 0 if kept.isEmpty() else 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
