"""Written intermediate tables.

A result that several later steps read is written once, as Parquet, to the folder that the
cluster names in `spark.checkpoint.dir`. That cuts lineage, keeps the columns prunable, and
survives the loss of any executor.
"""

import atexit
import functools
import itertools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def checkpoint_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", None) or ""
    if not re.match(r"local(\[|$)", master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    """A folder of this process, for local sessions that name none."""
    folder = tempfile.mkdtemp(prefix="placeweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


class Stage:
    """The intermediate tables of one run, in a folder of their own."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark)}/placeweave-{uuid.uuid4().hex}"
        self._numbers = itertools.count(1)

    def path(self, name: str) -> str:
        return f"{self.folder}/{next(self._numbers):03d}-{name}"

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        """Write `rows` and return the written table."""
        path = self.path(name)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def keep_measured(
        self, rows: DataFrame, name: str, **measures: Column
    ) -> tuple[DataFrame, dict[str, int]]:
        """Keep `rows` and take measures of them in the same pass.

        A task that runs again can raise a count but never a maximum, so use these only as upper
        bounds, to choose a plan.
        """
        seen = Observation()
        columns = [m.alias(c) for c, m in measures.items()]
        table = self.keep(rows.observe(seen, *columns), name)
        found = seen.get
        return table, {c: found.get(c) or 0 for c in measures}

    def release(self) -> None:
        """Delete the run's tables, once nothing that reads them is needed any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
