"""Shared folder, intermediate tables and byte stores of the operators.

Intermediate results are written as Parquet below ``spark.checkpoint.dir``, the
one folder that the driver and all executors share, and read back.  That cuts
the lineage, survives lost executors, and gives Catalyst file sizes to choose
joins by.
"""

from __future__ import annotations

import functools
import os
import pickle
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in the contracts: space and \t to \r.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, as in
    tests, a folder of this machine, which must then run the executors too."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "lodestone-shared")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Workspace:
    """Intermediate tables of one operator call.

    ``table`` writes a DataFrame and reads it back; ``drop`` removes tables
    that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name = spark, name
        self.paths: dict[str, str] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = new_folder(self.spark, f"{self.name}-{name}")
        df.write.mode("overwrite").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        self.paths[name] = path = new_folder(self.spark, f"{self.name}-{name}")
        return path

    def bytes_of(self, name: str) -> int:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[name])
        fs = jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return int(fs.getContentSummary(jpath).getLength())

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                drop_folder(self.spark, path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, whatever else a table carries."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys with more rows than a share of 1 / HOT_KEYS, and than HOT_ROWS, are broadcast.
HOT_KEYS, HOT_ROWS = 10_000, 1_000


def keyed_join(left: DataFrame, right: DataFrame, on: list[str], count: str, rows: int, outer: bool = False) -> DataFrame:
    """The inner join (with ``outer`` the left one) of ``left``, of about ``rows`` rows, with ``right``, which has one
    row for each key and says in ``count`` how many rows of ``left`` have it.

    No task gets a hot key's rows: keys with more than ``rows / HOT_KEYS`` rows, of
    which there are at most HOT_KEYS, are broadcast, and what they match is dealt by
    a hash of the row where the others are dealt by their key.  The last of ``on``
    is a long."""
    extra = [c for c in right.columns if c not in on]
    least = max(HOT_ROWS, rows // HOT_KEYS)
    hot = right.where(F.col(count) > least).select(*on, F.struct(*extra).alias("_hot"))
    rest = right.where(F.col(count) <= least).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(on)), F.struct(*extra).alias("_rest"))
    marked = left.join(F.broadcast(hot), on, "left").withColumn("_deal", F.when(F.col("_hot").isNull(), F.col(on[-1])).otherwise(F.xxhash64(*left.columns)))
    same = F.col("_deal") == F.col(f"_k{len(on) - 1}")
    for i, k in enumerate(on[:-1]):
        same = (F.col(k) == F.col(f"_k{i}")) & same
    joined = marked.join(rest, same, "left").withColumn("_found", F.coalesce("_hot", "_rest"))
    if not outer:
        joined = joined.where("_found is not null")
    return joined.select(*left.columns, *(F.col(f"_found.{c}").alias(c) for c in extra))


#: Bits for each key of a filter, and the most numbers of 64 bits that it has: 2 ** 20 rows
#: of two numbers, 16 MB, are broadcast at most, however many keys there are.
BITS_A_KEY, FILTER_ROWS = 16, 1 << 20


def sift(df: DataFrame, keys: DataFrame, on: list[str], work: Workspace, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` that may have a key of ``keys`` (all that do are among them),
    and those that certainly haven't.  Nothing of ``df`` moves: what tells them apart is
    a filter of bounded size.  With very many keys more and more rows may have one."""
    rows = min(FILTER_ROWS, 1 << max(4, (keys.count() * BITS_A_KEY // 64).bit_length()))
    at, one, all_ = (fresh(df, x) for x in ("_place", "_bit", "_bits"))
    h = F.xxhash64(*on)
    place, bit = F.pmod(h, F.lit(rows)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))
    bits = work.table(keys.select(place.alias(at), bit.alias(one)).groupBy(at).agg(F.bit_or(one).alias(all_)), name)
    marked = df.withColumns({one: bit, at: place}).join(F.broadcast(bits), at, "left")
    may = F.coalesce(F.col(all_).bitwiseAND(F.col(one)) != 0, F.lit(False))
    own = [F.col(f"`{c}`") for c in df.columns]
    return marked.where(may).select(*own), marked.where(~may).select(*own)


# --- byte stores --------------------------------------------------------------


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or of a plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def open_out(folder: str, name: str):
    """An output stream on a new file of a shared folder.

    Each attempt of a task takes a name of its own; readers go by a manifest
    that holds the names of committed attempts only.
    """
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    return store.open_output_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20)


def open_in(folder: str, name: str):
    store, path = filesystem(folder)
    return store.open_input_file(f"{path}/{name}")


def map_memory(folder: str, name: str):
    """A file's bytes: mapped where the store is a mounted folder, read otherwise."""
    import pyarrow as pa
    from pyarrow import fs

    store, path = filesystem(folder)
    if isinstance(store, fs.LocalFileSystem):
        return pa.memory_map(f"{path}/{name}").read_buffer()
    with store.open_input_file(f"{path}/{name}") as f:
        return f.read_buffer()


def text_bytes(column) -> Iterator[bytes]:
    """The UTF-8 bytes of each value of an Arrow string column (null: empty),
    without making Python strings, some rows at a time.  Lone surrogates can't
    occur: Arrow strings are valid UTF-8."""
    import pyarrow as pa

    column = column.cast(pa.binary())
    for at in range(0, len(column), 256):
        for value in column.slice(at, 256).to_pylist():
            yield value or b""


def frugal(run):
    """A task's function over batches that gives its memory back to the system when it
    ends: a worker outlives its tasks, and allocators keep what they have."""

    @functools.wraps(run)
    def wrapped(rows):
        try:
            yield from run(rows)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def learned(sample: DataFrame, fit):
    """What ``fit`` makes of the rows, as dictionaries, of a sample of bounded size.  One
    task learns and sends the model, so the driver holds no rows and keeps no memory of it."""

    @frugal
    def run(batches):
        import pyarrow as pa

        rows = [row for batch in batches for row in batch.to_pylist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").head()
    return fit([]) if found is None else pickle.loads(found.model)


# --- expressions --------------------------------------------------------------


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row: a lambda variable
    can't be inlined by the optimizer, so lambdas nested in ``body`` may use it
    for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))
