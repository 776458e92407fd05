"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextvars
import functools
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the corpus contracts: space and the ASCII controls from tab to carriage return.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"
#: The same six characters, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where the session names none, a local one, but only if
    all executors run in this process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"quantloom-{os.getuid()}", spark.sparkContext.applicationId)
    return named.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/quantloom-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_scopes = contextvars.ContextVar("scopes", default=())


def forget(df: DataFrame) -> None:
    """Deletes a materialized table that is no longer needed."""
    _delete(df.sparkSession, df._table_path)


#: Most rows for each file of a table of a few numbers a row.
FILE_ROWS = 1 << 20


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, which cuts its lineage. `rows` is for tables of a
    few numbers a row: where it bounds their rows, they get a file for each FILE_ROWS of these, and as many as there
    are cores at least, instead of one for each shuffle partition."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    if _scopes.get():
        _scopes.get()[-1].append(path)
    return out


def scratch(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions that return a table just materialized, which reads nothing else: the tables that were
    materialized on the way to it are deleted."""

    @functools.wraps(fn)
    def run(*args, **kwargs):
        outer, paths = _scopes.get(), []
        token = _scopes.set((*outer, paths))
        try:
            out = fn(*args, **kwargs)
        finally:
            _scopes.reset(token)
        for path in paths:
            if path != out._table_path:
                _delete(out.sparkSession, path)
        if outer:
            outer[-1].append(out._table_path)
        return out

    return run


def drop_materialized(spark: SparkSession) -> None:
    """Deletes what materialize() left of this application in the shared folder: for when all results are written."""
    _delete(spark, _own_dir(spark))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application, so that its functions can run there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{top.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, step: int = 512) -> DataFrame:
    """mapInArrow over slices of at most `step` rows. make() runs once in each task and returns the
    function from columns (lists) to columns (lists) in the order of `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                got = fn({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns, strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)
