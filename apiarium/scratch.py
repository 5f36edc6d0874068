"""Cut points: intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_SEEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is missing: in local mode, where executors share the driver's disk, a
    temporary folder of our own, deleted at exit; on a cluster the warehouse, never a local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if spark.sparkContext.master.split("[")[0] == "local":
        own = tempfile.mkdtemp(prefix="apiarium-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
    else:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result has a short lineage, true sizes for the planner, and outlives any
    lost executor, since no block of it is kept by one.
    """
    spark = df.sparkSession
    path = f"{_own(spark)}/{name}-{uuid.uuid4().hex}"
    with _short_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


@contextlib.contextmanager
def _short_shuffles(spark: SparkSession) -> Iterator[None]:
    """While the block runs, a query's shuffle files go when the query ends; what it wrote is kept in the table."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _own(spark: SparkSession) -> str:
    """This application's folder, deleted when Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _SEEN:
        _SEEN.add(app)
        atexit.register(_at_exit, spark)
    return f"{shared_dir(spark)}/apiarium/{app}"


def _at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped application's folder is left to its owner
        with contextlib.suppress(Exception):
            release(spark)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t._scratch_path)


def settle(spark: SparkSession) -> None:
    """Give back what an operator of many small queries has left on the driver: plans, generated classes, freed memory.

    Called at the end of an operator and between its rounds, each of which plans dozens of
    queries: a small driver's heap would otherwise grow to its limit and stay there.
    """
    gc.collect()  # plans are held by Python's references to them
    with contextlib.suppress(AttributeError, OSError):  # not the GNU library
        ctypes.CDLL(None).malloc_trim(0)
    spark.sparkContext._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> None:
    """What Java's native allocator holds unused goes back to the system, where the Java machine has the command for it."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    with contextlib.suppress(Py4JError):
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # by reflection on the interface, since the server's own class is not exported
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args[1] = "systemTrimNativeHeap"
        call.invoke(beans, args)


def release(spark: SparkSession) -> None:
    """Delete every table that this application has materialized so far."""
    _delete(spark, _own(spark))
