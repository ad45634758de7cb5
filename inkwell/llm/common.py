"""What the operators of this subpackage share: input columns, shared-folder tables, text helpers."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Separators of the contracts' "words" [^\x20\x09-\x0D]+, as a Java and RE2 class.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting that drops a query's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOWER = {c: c + 32 for c in range(65, 91)}


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it.

    On a single machine without one, a folder of that machine serves and is set in the session; a cluster has to name
    its own, as its machines don't see one another's disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{Path(tempfile.gettempdir(), 'inkwell-checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_lock = threading.Lock()
_writers: dict[str, int] = {}
_before: dict[str, str] = {}
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def _shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """While any thread of the session writes a table, a query's shuffle files go at its end; then the setting is as before."""
    key = str(spark._jsparkSession.hashCode())
    with _lock:
        _writers[key] = _writers.get(key, 0) + 1
        if _writers[key] == 1:
            _before[key] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            _writers[key] -= 1
            if not _writers[key]:
                spark.conf.set(_CLEANUP, _before.pop(key))
                del _writers[key]


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.

    Unlike a cached frame, the reread table has real size statistics, so that joins on it are planned by size. The
    shuffle files behind the table go once it is written: nothing reads them again, and they would add up.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (written := _written.get()) is not None:
        written.append(path)
    with _shuffle_files_go(spark):
        df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Tables written inside go at the end, but for those that the given function is called with.

    keep(*frames): the frames' files stay, as what is returned reads them.
    """
    written: list[str] = []
    kept: set[str] = set()
    token = _written.set(written)

    def keep(*frames: DataFrame) -> None:
        files = [f for df in frames for f in df.inputFiles()]
        kept.update(p for p in written if any(f"/{p.rpartition('/')[2]}/" in f for f in files))

    try:
        yield keep
    finally:
        _written.reset(token)
        if (outer := _written.get()) is not None:
            outer.extend(p for p in written if p in kept)
        for path in written:
            if path not in kept:
                drop_table(spark, path)


def reachable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; a cluster has it installed or gets it by --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def columns(df: DataFrame, **names: str | Column) -> DataFrame:
    """Only the wanted columns, under the operator's own names, so that other columns cannot clash."""
    return df.select(*((F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in names.items()))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def arrow_schema(ddl: str):
    """The Arrow schema of rows so described; made on the driver, as workers have no session to read it with."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def map_rows(df: DataFrame, one_batch: Callable, schema: str | StructType, rows: int = 1000) -> DataFrame:
    """Arrow batches through one_batch(dict of lists) -> dict of lists, in schema's order; so many rows at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    reachable(df.sparkSession)
    names = [f.name for f in struct]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = one_batch(batch.slice(at, rows).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, struct)


def crc_bucket(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo parts."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(parts))


def crc_of(key: object) -> int:
    """crc32 of a key's text, as crc_bucket takes it."""
    return zlib.crc32(str(key).encode())
