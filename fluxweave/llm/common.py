"""Shared plumbing: table access, shared-folder materialisation and fixed contract expressions."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in the contracts (space and \t..\r).
SPACES = " \t\n\x0b\x0c\r"


#: Bytes of a batch that Python workers get at once.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="fluxweave-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one only in local mode (tests), since the executors of a
    cluster share no other folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = _local_dir(context.applicationId)
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fluxweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "written_to", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def side(df: DataFrame, most_rows: int, most_bytes: int = 32 << 20) -> DataFrame:
    """A table to join with: broadcast only after its rows and bytes were counted and found few."""
    rows, held = getattr(df, "counted", (None, None))
    if rows is None:
        wide = [F.sum(F.octet_length(f.name)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
        rows, *lengths = df.agg(F.count("*"), *wide).first()
        held = rows * 8 * len(df.columns) + sum(x or 0 for x in lengths)
        df.counted = rows, held
    return F.broadcast(df) if rows <= most_rows and held <= most_bytes else df


def with_uid(df: DataFrame) -> DataFrame:
    """A unique row id, so that null or repeated ids never merge rows."""
    return df.withColumn("_uid", F.monotonically_increasing_id())


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def _release() -> None:
    """Give freed memory back to the system: workers live on between tasks and share their executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over batches of bounded bytes, whatever the length of the texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(bounded, schema)
