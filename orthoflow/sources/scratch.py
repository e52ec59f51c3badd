"""Tables that cut lineage.

Executors can be lost at any time, so what is used more than once is written
once as Parquet below ``spark.checkpoint.dir``, the folder that driver and
executors share. Only where that setting is empty and the session is local
(tests, a laptop) a local folder takes its place.
"""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_current: ContextVar[Tables | None] = ContextVar("tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local session without one gets a local one, a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="orthoflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Tables:
    """Stored tables that one run owns, below a folder of its own.

    Within `with Tables(spark):` whatever stored() writes in this thread belongs to
    the block and is deleted at its end; what still reads these tables fails then.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/orthoflow/{uuid.uuid4().hex}"

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df to the folder and reads it back, with no lineage before it."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> bool:
        """Deletes the folder; whether there was any."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Tables:
        self._token = _current.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _current.reset(self._token)
        self.release()


def stored(df: DataFrame, name: str) -> DataFrame:
    """A stored table of the Tables block that this runs in; outside of one it stays until its folder is deleted."""
    return (_current.get() or Tables(df.sparkSession)).stored(df, name)
