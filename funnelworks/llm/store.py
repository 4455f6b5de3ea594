"""Intermediate tables in the folder that the whole cluster shares, and other dealings with Spark that operators have in common.

Cutting a lineage by a written table survives the loss of any executor: the
files are in ``spark.checkpoint.dir``, which the cluster names, and a later
read needs nothing from the executors that wrote them.  A table goes (``dropped``)
as soon as the tables made of it are written; what a result still reads stays
until ``clear``.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .words import lean

_CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and Spark is local."""
    where = spark.conf.get(_CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(_CHECKPOINT_DIR)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{_CHECKPOINT_DIR} has to name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="funnelworks-")
        spark.conf.set(_CHECKPOINT_DIR, where)
    return where.rstrip("/")


#: Share of the driver's heap that may be in use before its garbage is collected: a grown heap is not given back by itself.
HEAP_SHARE = 0.25


def trimmed(spark: SparkSession) -> bool:
    """Give back what the driver's JVM has freed beside its heap: its many short-lived threads leave pages behind, for each of them.

    A diagnostic command of the JVM, asked for by its public management interface; False where the JVM has none.
    """
    jvm = spark._jvm
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        call = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, call)
    except (Py4JError, StopIteration):
        return False
    return True


def released(spark: SparkSession) -> None:
    """Collect the driver's garbage: the files of shuffles that no data frame names any more go, the heap shrinks, and free memory goes back to the system.

    A query that has ended is named by its last event until all listeners have had it; so they are waited for, some seconds at most.
    """
    with contextlib.suppress(Py4JJavaError):
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(10_000)
    lean()  # data frames that are gone still name their shuffles to the driver's JVM
    spark._jvm.System.gc()
    trimmed(spark)


def _heap_in_use(spark: SparkSession) -> float:
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    return (heap.totalMemory() - heap.freeMemory()) / heap.maxMemory()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/funnelworks/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _heap_in_use(spark) > HEAP_SHARE:
        released(spark)
    else:
        trimmed(spark)
    # The schema is known: no job that reads footers to infer it, and an empty table keeps its columns.
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame, collect: bool = True) -> None:
    """Delete staged tables (as ``staged`` returned them); nothing may read them any more.

    The files of shuffles that only made them go as well, as soon as the driver has collected its garbage (``collect``).
    """
    for table in tables:
        _delete(table.sparkSession, table._staged_at)
    for table in tables[: int(collect)]:
        released(table.sparkSession)


def reading(result: DataFrame, *tables: DataFrame) -> DataFrame:
    """``result``, with the staged tables that it reads named in ``_reads``: once it is written they can be ``dropped``."""
    result._reads = tables
    return result


def clear(spark: SparkSession) -> None:
    """Delete all that operators have left in the shared folder; results that were not written or collected are lost."""
    _delete(spark, f"{shared_dir(spark)}/funnelworks")


#: Rows (keys with little beside) that are sent to all executors at most; more are joined by a shuffle.
MOST_SENT = 500_000


def sent(keys: DataFrame, weight: Column | None = None) -> DataFrame:
    """``keys``, a written table of narrow rows, as a side of a join: broadcast if it is few, else shuffled.  ``weight`` says how many rows one counts for."""
    few = keys.limit(MOST_SENT + 1).count() if weight is None else keys.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(keys) if few <= MOST_SENT else keys.hint("merge")


def unused(table: DataFrame, name: str) -> str:
    """A column name that ``table`` lacks."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    """How many parts a shuffle has in this session; the cluster sizes it to its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Bytes of files that a part of the key space takes about, at most.
PART_BYTES = 1 << 26
_NO_ESTIMATE = 1 << 60


def parts_for(documents: DataFrame) -> int:
    """Parts of the key space for what ``documents`` sends there: the session's number, or more where the input's size asks for it."""
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(documents.sparkSession), size // PART_BYTES if size < _NO_ESTIMATE else 0)


def dealt(rows: DataFrame, fragments: int) -> DataFrame:
    """``rows`` with each ``fragment`` (from 0, below ``fragments``) in a task of its own: dealt by a hash, several would meet in one task, and in its memory."""
    return rows.repartitionById(fragments, F.col("fragment").cast("int"))


def integer_of(table: DataFrame, name: str) -> Column:
    """A long that stands for the column: integers as they are, else a hash of the value as text; null stays null."""
    if isinstance(table.schema[name].dataType, IntegralType):
        return F.col(name).cast("long")
    return F.when(F.col(name).isNotNull(), F.xxhash64(F.col(name).cast("string")))


#: Rows that one task of a tree adds up.
FAN = 64


def added_by_tree(parts: DataFrame, keys: list[str], add: Callable[[list[bytes]], bytes], fan: int = FAN) -> DataFrame:
    """``parts`` (keys, block, x) with one row for each key: its ``x`` combined by ``add``, ``fan`` blocks at a time.

    ``block`` numbers the tasks that made the rows, each at most one for a key; so no
    task holds more than ``fan`` values of a key at once, however many tasks there were.
    """
    kinds = ", ".join(f"{n} {t}" for n, t in parts.dtypes)

    def run(table: pa.Table) -> pa.Table:
        x = pa.array([add(table.column("x").to_pylist())], pa.binary())
        return pa.table([x if n == "x" else table.column(n).slice(0, 1) for n in table.column_names], names=table.column_names)

    last = parts.agg(F.max("block")).first()[0] or 0
    while True:
        last //= fan
        parts = parts.withColumn("block", (F.col("block") / fan).cast("int")).groupBy(*keys, "block").applyInArrow(run, kinds)
        if not last:
            return parts


#: Bits of ``bit_filter`` by default: a fixed size, whatever is put into it.
FILTER_BITS = 1 << 24


def bit_filter(slots: DataFrame, bits: int = FILTER_BITS):
    """uint8 array with the bits set that ``slots`` (slot) names; what reaches the driver is bounded by ``bits``."""
    import numpy as np

    words = slots.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()
    out[got["word"].to_numpy()] = got["bit"].to_numpy()
    return out.view(np.uint8)
