"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.buckets import read_buckets, write_buckets
from loomgraph.sources.files import Files


#: Temporary folders of local sessions, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder under ``spark.checkpoint.dir``: one folder to drop when the application is done. Where the setting
    is missing, a local session gets a temporary folder; on a cluster that would be a folder of each machine's own, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        if application not in _LOCAL:
            _LOCAL[application] = tempfile.mkdtemp(prefix="spark-shared-")
        found = _LOCAL[application]
    return f"{found.rstrip('/')}/loomgraph-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in that folder that nothing has been written to."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: What was written, in order: paths by application and thread.
_STAGES: dict[tuple[str, int], list[str]] = {}


def _stages(spark: SparkSession) -> list[str]:
    return _STAGES.setdefault((spark.sparkContext.applicationId, threading.get_ident()), [])


def mark(spark: SparkSession) -> int:
    """The place in this thread's list of stages, for :func:`drop_stages`."""
    return len(_stages(spark))


def drop_stages(spark: SparkSession, since: int | None = None, keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes what this application has written there: all, or what this thread has written since a mark, but for the stages that some
    frames read. Other frames that read it can't be used any more."""
    files, stages = Files(spark), _stages(spark)
    if since is None:
        files.delete(shared_dir(spark))
        stages.clear()
        return
    read = {f for df in keep for f in df.inputFiles()}
    stay = [p for p in stages[since:] if any(f"/{p.rpartition('/')[2]}/" in f for f in read)]
    for path in stages[since:]:
        if path not in stay:
            files.delete(path)
    stages[since:] = stay


def _new_stage(spark: SparkSession, name: str) -> str:
    path = new_path(spark, name)
    _stages(spark).append(path)
    return path


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """The frame, written to the shared folder and read back: it is computed once, and what follows is planned by its real size."""
    path = _new_stage(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a frame that are sent to every task, at most.
MOST_SENT = 100_000


def sent(df: DataFrame, name: str = "sent") -> DataFrame:
    """As :func:`written`, to be joined by equal keys: to all tasks if there are few rows, else sorted with the other side. How small a file is
    doesn't tell that: rows that are alike take a hundred times as much in memory."""
    rows = written(df, name)
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows.hint("merge")


def bucketed(df: DataFrame, keys: list[str], name: str = "buckets", buckets: int | None = None, distinct: bool = False, lies: bool = False) -> DataFrame:
    """As :func:`written`, in buckets by some keys and sorted within them: a join by these keys moves the other side only. There are as many
    buckets as shuffle partitions, if nothing else is said. Rows that lie by the keys already (``lies``) aren't moved."""
    spark = df.sparkSession
    path = _new_stage(spark, name)
    write_buckets(df, path, keys, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), distinct, lies)
    return read_buckets(spark, path, df.schema)
