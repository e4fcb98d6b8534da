"""Session settings and the shared folder for checkpoints and written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "postsieve", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; `conf` overrides (dots as `__`)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        # timestamps in the tables carry no zone; scans compare them as UTC
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # links seen by the stream are kept on disk, not on the heap
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # a pushed list of ids (see sources.fetch) is compared with row groups id by id, not by its bounds
        "spark.sql.parquet.pushdown.inFilterThreshold": "2000",
        # postings are wide rows: keep Arrow batches for the two Python hooks small
        "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Point the session at the shared checkpoint folder and return it.

    The cluster names the folder in `spark.checkpoint.dir`. A temporary folder is made only
    where that is unset and Spark runs in one local process.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None or not current.startswith(_with_scheme(sc, configured)):
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        current = sc.getCheckpointDir()
    return current


_FOLDER: ContextVar[str | None] = ContextVar("postsieve_run_folder", default=None)
_OWNER = "_owner"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written intermediate: in the folder of the run that is being made, else in the application's.

    All lie below the shared checkpoint folder.
    """
    folder = _FOLDER.get() or f"{_scratch_root(spark)}/{spark.sparkContext.applicationId}"
    return f"{folder}/{uuid.uuid4()}/{name}"


def open_folder(spark: SparkSession) -> str:
    """A folder for what one run settles, with the application that owns it written beside."""
    folder = f"{_scratch_root(spark)}/run-{uuid.uuid4()}"
    fs, path = _file_system(spark, f"{folder}/{_OWNER}")
    out = fs.create(path)
    out.writeUTF(spark.sparkContext.applicationId)
    out.close()
    return folder


@contextmanager
def settling_in(spark: SparkSession, folder: str):
    """Intermediates settled inside go to `folder`; if that fails, it is removed with all it holds."""
    token = _FOLDER.set(folder)
    try:
        yield
    except BaseException:
        remove_folder(spark, folder)
        raise
    finally:
        _FOLDER.reset(token)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder that `open_folder` made; a second call finds nothing."""
    if not folder.startswith(f"{_scratch_root(spark)}/"):
        raise ValueError(f"{folder} is no folder of a run")
    fs, path = _file_system(spark, folder)
    fs.delete(path, True)


def remove_scratch(spark: SparkSession, abandoned_for: timedelta | None = None) -> list[str]:
    """Remove what this application has settled outside of runs; call it after the last read.

    With `abandoned_for`, also folders of runs that other applications made so long ago and never closed.
    Returns what was removed.
    """
    root, own = _scratch_root(spark), spark.sparkContext.applicationId
    fs, path = _file_system(spark, root)
    removed = []
    for entry in fs.listStatus(path) if fs.exists(path) else ():
        at = entry.getPath()
        old = abandoned_for is not None and entry.getModificationTime() < (datetime.now() - abandoned_for).timestamp() * 1000
        if at.getName() == own or old and not _owned_by(fs, at, own):
            fs.delete(at, True)
            removed.append(at.getName())
    return removed


def _owned_by(fs, folder, application: str) -> bool:
    owner = folder.suffix(f"/{_OWNER}")
    if not fs.exists(owner):
        return False
    text = fs.open(owner)
    try:
        return text.readUTF() == application
    finally:
        text.close()


def _scratch_root(spark: SparkSession) -> str:
    return f"{use_checkpoint_dir(spark).rstrip('/')}/postsieve"


def _file_system(spark: SparkSession, path: str):
    sc = spark.sparkContext
    hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration()), hadoop_path


def settled_table(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate as parquet below the shared folder and read it back.

    For results that several parts of a plan start from: computed once, read by column, with a
    known size, and still there when executors are lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _with_scheme(sc, path: str) -> str:
    hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(hadoop_path).toString()
