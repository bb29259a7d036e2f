"""Tables in the shared folder, when they are deleted again, and paths of the provided tables."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait
from contextlib import contextmanager
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "/tmp/goldleaf-checkpoints"

_scopes = threading.local()

#: Writes that run beside each other; many are too small to keep the cluster busy by themselves.
TOGETHER = 4
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return LOCAL_CHECKPOINTS


def stored(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    ``narrow`` is for tables of ids and digests behind a shuffle: they get at most eight files for each
    core of the cluster, so that many shuffle partitions don't become many tiny files. Inside a
    :class:`Scratch` the table goes when that ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if scopes := getattr(_scopes, "open", None):
        scopes[-1].paths.append(path)
    out = df.coalesce(max(32, 8 * spark.sparkContext.defaultParallelism)) if narrow else df
    out.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*tasks: Callable[[], Any]) -> list:
    """The results of independent jobs, run beside each other; all have ended when this returns or raises."""
    scopes = getattr(_scopes, "open", None)

    def scoped(task: Callable[[], Any]) -> Any:
        _scopes.open = list(scopes or ())
        try:
            return task()
        finally:
            del _scopes.open

    session = SparkSession.getActiveSession()
    target = inheritable_thread_target(session)(scoped) if session is not None else scoped
    with ThreadPoolExecutor(TOGETHER) as pool:
        running = [pool.submit(target, task) for task in tasks]
        wait(running)
    return [r.result() for r in running]


@contextmanager
def small_methods(spark: SparkSession):
    """Run the plans inside without generated methods that the JVM never compiles.

    It leaves methods of more than 8,000 bytes of bytecode interpreted; Spark's own limit is 65,535. Beyond
    the limit a stage falls back to projections that are split into small methods.
    """
    before = spark.conf.get(HUGE_METHOD)
    spark.conf.set(HUGE_METHOD, "8000")
    try:
        yield
    finally:
        spark.conf.set(HUGE_METHOD, before)


class Scratch:
    """Deletes at its end what was stored inside it, but for its results, which are the outer scope's::

        with Scratch(spark) as scratch:
            ...
            return scratch.result(df, "result")
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    @contextmanager
    def held(self):
        """Collect what is stored inside, to be deleted by :meth:`clear`."""
        if not hasattr(_scopes, "open"):
            _scopes.open = []
        _scopes.open.append(self)
        try:
            yield self
        finally:
            _scopes.open.remove(self)

    def __enter__(self) -> Scratch:
        self._holding = self.held()
        return self._holding.__enter__()

    def __exit__(self, *error) -> None:
        self._holding.__exit__(*error)
        self.clear()

    def result(self, df: DataFrame, label: str, narrow: bool = True) -> DataFrame:
        """``df`` stored for whoever opened the scope around this one."""
        inner = _scopes.open.pop()
        try:
            return stored(df, label, narrow)
        finally:
            _scopes.open.append(inner)

    def clear(self) -> None:
        for path in self.paths:
            _delete(self.spark, path)
        self.paths = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Delete a table that :func:`stored` wrote and that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rsplit("/", 1)[0])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
