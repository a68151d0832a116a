"""Tables that cut lineage: written to the shared folder, read back.

A cut table is Parquet below ``spark.checkpoint.dir``.  It survives the loss of
any executor, is computed once, and gives the planner exact sizes.  Operators
drop cut tables once no later step reads them; those that a result still
reads are deleted when the program ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folders: set[str] = set()
#: Rows and bytes of the Arrow batches that a cut exchanges with Python: at Spark's own 10,000 rows, batches of texts
#: or sets take tens of MB in the virtual machine and again in every worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

#: Exchanges of a cut go with it, not when the driver happens to collect its garbage.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def _with(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with these settings, and with its own again afterwards."""
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder below the system's
    temporary one, which is removed when the program ends; a cluster gets an
    error, since its machines share no local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    if own not in _own_folders:
        _own_folders.add(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file:{own}"


def _delete(jvm, conf, path: str) -> None:
    """Delete a folder at the program's end; the virtual machine may be gone by then."""
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # noqa: BLE001  nothing is left to be told
        pass


class Scratch:
    """A folder of cut tables for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._cuts = 0
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration(), self.folder)

    def cut(self, df: DataFrame, name: str = "t", tidy: bool = False) -> DataFrame:
        """Write ``df`` and return the table read back; tidy: its exchanges are deleted at once."""
        self._cuts += 1
        path = f"{self.folder}/{self._cuts:03d}-{name}"
        with _with(self.spark, BATCH | (TIDY if tidy else {})):
            df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._tessella_path = path  # for drop()
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete cut tables that no later step reads."""
        for table in tables:
            self.delete(table._tessella_path)

    def delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
