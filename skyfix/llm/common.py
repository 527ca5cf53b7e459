"""Shared pieces: table access, lineage cuts in the shared folder, folds."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONG_MIN = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local master may do without one (tests): executors do not share other folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local($|\[)", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="skyfix-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Removes a write's shuffle files once it has ended: what it made is read from the table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: While a table is written, Python workers get batches of this many bytes: what they derive from a batch takes several times as much.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
#: Tables that materialise() wrote in each open scratch(), innermost last.
_SCRATCH: list[list[DataFrame]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    settings = {CLEANUP: "true", BATCH[0]: BATCH[1]}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._skyfix_path = path
    for tables in _SCRATCH:
        tables.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialise() wrote and no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._skyfix_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Removes every table that materialise() writes inside, at the end; take one out of the list to keep it.

    For callers that have written an operator's result before they leave the block.
    """
    tables: list[DataFrame] = []
    _SCRATCH.append(tables)
    try:
        yield tables
    finally:
        _SCRATCH.pop()
        discard(*tables)


def keep(table: DataFrame) -> DataFrame:
    """Take a table out of the innermost scratch()."""
    _SCRATCH[-1][:] = [t for t in _SCRATCH[-1] if t is not table]
    return table


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of some rows: a worker holds what it derives from one of them, not from a whole batch. What one leaves goes back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def as_bytes(text: str = "text") -> Column:
    """A text as bytes for Python workers: Spark strings may hold bytes that are not UTF-8, which Arrow strings must not."""
    return F.col(text).cast("string").cast("binary")


def fold(col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out. A null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, so that df has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
