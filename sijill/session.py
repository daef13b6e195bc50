"""Session defaults, table access and the shared scratch folder."""

from __future__ import annotations

import atexit
import gc
import pickle
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "sijill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow and UTC; keyword names use `__` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have it on their path, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sijill-code-")) / "sijill_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent).as_posix())
    sc.addPyFile(str(archive))  # served by the driver to every executor
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the parquet tables in a folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows dealt over all cores where it has fewer partitions than those; else as they are.

    Queries call this on the tables they read, for work that costs much a row; operators
    never do, so what they get is what they run on. Only for scans (and projections or
    filters of one): their partitions are known from the files, nothing is run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def texts(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a table, dealt over all cores."""
    return spread(table(spark, folder, name).select(*columns))


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by all executors, as the cluster names it in spark.checkpoint.dir.

    Only on a local master (one machine, as in tests) a temporary folder is made and set
    where none is named; on a cluster that is an error, for executors share no local disk.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sijill-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


_CLEARED: set[str] = set()
_PASSING: list[list[str]] = []  # paths of the tables that the running waves write


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path for one intermediate table; the application's tables are removed when it ends."""
    folder = f"{scratch_root(spark)}/sijill/run-{spark.sparkContext.applicationId}"
    if folder not in _CLEARED:
        _CLEARED.add(folder)
        atexit.register(clear_scratch, spark, folder)
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    if _PASSING:
        _PASSING[-1].append(path)
    return path


def kept_path(spark: SparkSession, tag: str) -> str:
    """A stable path in the shared folder, for what later runs go on using."""
    return f"{scratch_root(spark)}/sijill/kept/{tag}"


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def clear_scratch(spark: SparkSession, folder: str | None = None) -> None:
    """Remove the application's intermediate tables; results read from them must be written by then."""
    try:
        files, at = _file_system(spark, folder or f"{scratch_root(spark)}/sijill/run-{spark.sparkContext.applicationId}")
        files.delete(at, True)
    except Exception:  # the JVM may be gone at exit
        pass


def stored(spark: SparkSession, tag: str, build: Callable[[], object]) -> object:
    """A small object (a trained model) from the shared folder; built and put there where it is absent.

    It is written beside its place and moved there in one step, so a reader never sees
    half of it; of two writers one wins, with equal content.
    """
    path = kept_path(spark, tag)
    if exists(spark, path):
        return pickle.loads(bytes(spark.read.parquet(path).first()[0]))
    made = build()
    beside = scratch_path(spark, tag)
    spark.createDataFrame([(bytearray(pickle.dumps(made)),)], "content binary").coalesce(1).write.parquet(beside)
    files, at = _file_system(spark, path)
    files.mkdirs(at.getParent())
    if not files.exists(at):
        files.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), at)
    return made


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write once into the shared folder and read back.

    Cuts the lineage and survives the loss of any executor, unlike a cached or
    locally checkpointed frame.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffles of frames that nothing refers to any more, which it does when the driver's memory is collected."""
    gc.collect()
    time.sleep(1.5)  # references from here are given back within a second
    spark._jvm.System.gc()


def in_waves(rows: DataFrame, key: str, size: int, work: Callable[[DataFrame], DataFrame], tag: str) -> DataFrame:
    """work of all rows, for about `size` of them at a time: each part's result is written, and what it wrote on the way is removed. Rows of a key stay together."""
    spark = rows.sparkSession
    waves = -(-rows.count() // size)
    if waves < 2:
        return work(rows)
    out = None
    for wave in range(waves):
        _PASSING.append([])
        try:
            part = work(rows.where(F.pmod(F.xxhash64(key), F.lit(waves)) == wave))
        finally:
            made = _PASSING.pop()
        kept = materialize(part, tag)
        del part
        for path in made:
            files, at = _file_system(spark, path)
            files.delete(at, True)
        release(spark)
        out = kept if out is None else out.unionByName(kept)
    return out
