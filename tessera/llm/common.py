"""Shared pieces: the shared work folder, staged tables, table readers and clash-free columns."""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a folder of our own only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per context, so that workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    z.write(at, os.path.relpath(at, os.path.dirname(top)))
    to = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tessera-")), "tessera.zip")
    with open(to, "wb") as f:
        f.write(packed.getvalue())
    sc.addPyFile(to)
    sc._tessera_shipped = True


#: What operators remember in a Python worker beyond their tasks: the modules that use it, and what forgets it.
_remembered: list = []


def remembered(users: tuple[str, ...], forget) -> None:
    """``forget`` runs in a worker as it begins a task of another module than ``users``, named without the package."""
    _remembered.append((users, forget))


def _begin(module: str) -> None:
    for users, forget in _remembered:
        if module.rpartition(".")[2] not in users:
            forget()


def _give_back() -> None:
    """Memory that a task freed, from the allocators to the system: a worker waits for its next task beside the JVM's work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library than glibc
        pass


def _lean(run, module: str):
    def go(batches):
        _begin(module)
        _give_back()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return go


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the workers, which hold no other operator's memory."""
    ship(df.sparkSession)
    return df.mapInArrow(_lean(run, run.__module__), schema)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under our own names, so extra columns of the caller never clash."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in cols.items()])
