"""What the operators of this subpackage share: durable scratch tables and column hygiene.

Scratch data never goes to a machine-local folder on a cluster. It is written
below ``spark.checkpoint.dir``, which every executor can read, so that a lost
executor costs a task retry and no recomputed lineage.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import inspect
import math
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: space and U+0009 to U+000D. bytes.split() uses the same six.
WORD_SPACE = r"\x20\x09-\x0D"
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset and all runs in this process (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        root = tempfile.mkdtemp(prefix="lodestar-checkpoints-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_recorders: list[list[str]] = []


class recorded:
    """Gathers the scratch tables that are named while this holds, so that their user can remove them later."""

    def __enter__(self) -> list[str]:
        _recorders.append([])
        return _recorders[-1]

    def __exit__(self, *_):
        _recorders.pop()


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    for found in _recorders:
        found.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def goes_at_exit(spark: SparkSession, path: str) -> None:
    """The scratch table at path goes when the application ends: until then a lazy result may read it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


class setting:
    """While this holds, the session has a value of a setting that queries started meanwhile take up."""

    key: str
    value: str

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        try:
            self.before = self.spark.conf.get(self.key)
            self.spark.conf.set(self.key, self.value)
        except Exception:  # a Spark without the setting does as it always does
            self.before = None

    def __exit__(self, *_):
        if self.before is not None:
            self.spark.conf.set(self.key, self.before)


class freed_shuffles(setting):
    """Spark drops a query's shuffle files as soon as the query ends.

    Only for queries whose result is written out: nothing may read their shuffles later.
    """

    key, value = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"


class joined_in_place(setting):
    """Tables that are dealt by one of the columns of a join are joined without being dealt again by all of them."""

    key, value = "spark.sql.requireAllClusterKeysForCoPartition", "false"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table below the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    with freed_shuffles(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    goes_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


_state: dict = {}


def trim() -> None:
    """Gives memory that a Python worker no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def worker_state(owner: str, key=None, make=None):
    """What an operator (``owner``) keeps in a Python worker from task to task: one object, made anew for another key.

    Another operator's object goes first, so a worker holds one at a time.
    """
    if _state.get("owner") != owner:
        held = "kept" in _state
        _state.clear()
        _state["owner"] = owner
        if held:
            gc.collect()
            trim()
    if make is None:
        return None
    if "kept" not in _state or _state["key"] != key:
        _state.pop("kept", None)
        _state["kept"], _state["key"] = make(), key
    return _state["kept"]


def lean(f, owner: str | None = None):
    """f, a function of a Python worker, with other operators' state cleared before it and free memory given back after it.

    owner: whose state stays, if not that of the module of f.

    f yields batches (mapInArrow) or takes one or two tables (applyInArrow, where Spark counts the parameters).
    """
    owner = owner or f.__module__

    def yielding(batches):
        worker_state(owner)
        yield from f(batches)
        trim()

    def one(table):
        worker_state(owner)
        out = f(table)
        trim()
        return out

    def two(left, right):
        worker_state(owner)
        out = f(left, right)
        trim()
        return out

    if inspect.isgeneratorfunction(f):
        return yielding
    return one if len(inspect.signature(f).parameters) == 1 else two


def place_of(columns: list[str], name: str) -> int:
    """Where a column stands: the first of exactly this name, else the first that is equal but for the case."""
    if name in columns:
        return columns.index(name)
    folded = [c.lower() for c in columns]
    if name.lower() in folded:
        return folded.index(name.lower())
    raise ValueError(f"there is no column {name} among {columns}")


def numbered(docs: DataFrame) -> DataFrame:
    """docs with its columns named by their places (c0, c1, ...), so that no two names are alike."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def pick(docs: DataFrame, **wanted: str) -> DataFrame:
    """The named columns (see place_of) under names of our own, so other columns of the input can't clash."""
    return numbered(docs).select(*[F.col(f"c{place_of(docs.columns, old)}").alias(new) for new, old in wanted.items()])


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of the text column."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def parts(total: float, each: float, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)), F.lit(0)).cast("int")


