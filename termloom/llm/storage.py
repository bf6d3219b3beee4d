"""Written tables and files in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode, where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage is cut, nothing is computed twice."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, name)
    with shuffles_dropped(spark):
        df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "written_to", None)
        if path:
            session = table.sparkSession
            at = session._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(session._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when each write is done, not when the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a URI (file, hdfs, s3, gs) and the path in it."""
    return fs.FileSystem.from_uri(uri)


def publish(store: fs.FileSystem, temporary: str, final: str) -> None:
    """Give a finished file its name. A retried task has made the same bytes, so replacing is harmless.

    Some stores do not move over a file that is there; it is deleted then. The manifest, written last, is what counts.
    """
    try:
        store.move(temporary, final)
    except OSError:
        if store.get_file_info(final).type == fs.FileType.NotFound:
            raise
        store.delete_file(final)
        store.move(temporary, final)
