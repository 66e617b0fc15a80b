"""Keeping Python within its share of an executor."""

from __future__ import annotations

import ctypes
import gc
import pickle

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of an Arrow batch on its way to Python; Spark's own bound suits rows of numbers, not of texts.
BATCH_BYTES = 1 << 20
#: Rows that Spark's parquet reader holds at once; its own number suits rows of numbers, not of texts.
READER_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches and of the reader's rows where they are higher. Plans read them when they run,
    so they stay."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) not in range(1, BATCH_BYTES + 1):
        spark.conf.set(name, str(BATCH_BYTES))
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(name)) > READER_ROWS:
        spark.conf.set(name, str(READER_ROWS))
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> None:
    """Gives memory that the driver's JVM has freed outside its heap, most of it by its compilers, back to the system. Does
    nothing on a JVM without that command."""
    jvm = spark._jvm
    try:
        (invoke,) = (m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        pass


def with_scores(base: DataFrame, keep: list[str], schema: str, scorer) -> DataFrame:
    """The columns ``keep`` of ``base`` and those that ``scorer()``, called once a task, gives for an Arrow batch, named as in
    ``schema``. Goes without pandas, which every Python worker would load."""
    added = T._parse_datatype_string(schema)
    out = T.StructType([T.StructField(f.name, f.dataType) for f in base.select(*keep).schema] + list(added))

    def run(batches):
        score = scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *score(batch)], [*keep, *added.names])
        del score

    return base.mapInArrow(trimmed(run), out)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a DataFrame by way of Arrow; from a plain list Spark would start Python workers of another kind, which then
    stay beside the others."""
    fields = to_arrow_schema(T._parse_datatype_string(schema))
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields))


def ship(spark: SparkSession, value):
    """A broadcast of ``value`` with the code of its classes, for workers that don't have this package; ``unship`` reads it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def unship(shared):
    return pickle.loads(shared.value)


def trim() -> None:
    """Gives freed memory back to the system; Python workers outlive their tasks, and the driver its training."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def collect_garbage(spark: SparkSession) -> None:
    """Has every executor's JVM, and the driver's, collect its garbage and give back what its heap doesn't need, before a step that
    needs memory beside the heap. A heap that earlier steps have filled otherwise keeps its size."""
    n = spark.sparkContext.defaultParallelism
    gone = F.call_function("reflect", F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, n, 1, n).select(gone.alias("gone")).write.format("noop").mode("overwrite").save()
    spark._jvm.System.gc()
    trim_driver(spark)


def trimmed(run):
    """``run``, a function of batches, with its memory given back when a task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped
