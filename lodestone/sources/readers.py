"""Readers with the checks of uploads: headers, nesting, size, text encodings."""

from __future__ import annotations

import csv
import functools
import io
import json
import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

MAX_SOURCE_BYTES = 100 * 1024 * 1024
BOM = "\ufeff"


def check_size(spark: SparkSession, path: str, most: int = MAX_SOURCE_BYTES) -> int:
    row = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("n")).head()
    if not row.n:
        raise ValueError("The file is empty.")
    if row.n > most:
        raise ValueError(f"The file exceeds {most} bytes.")
    return row.n


def _friendly(read):
    """A reader whose faults are ValueErrors that a person can read."""

    @functools.wraps(read)
    def wrapped(spark: SparkSession, path: str, *args, **options):
        check_size(spark, path)
        try:
            return read(spark, path, *args, **options)
        except (PySparkException, Py4JJavaError) as error:
            raise ValueError(f"The file can't be read: {str(error).splitlines()[0]}") from error

    return wrapped


def _head(spark: SparkSession, path: str, most: int = 1 << 16) -> str:
    """The start of a file as text; bytes that aren't UTF-8 are an error."""
    row = spark.read.format("binaryFile").load(path).orderBy("path").select(F.substring("content", 1, most).alias("head"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid")).head()
    if not row.valid:
        raise ValueError("The file isn't UTF-8.")
    return bytes(row["head"]).decode("utf-8", "ignore").removeprefix(BOM)


@_friendly
def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Types are inferred; repeated column names are an error.  Quoted names and values
    may hold line ends."""
    head = _head(spark, path)
    if not head.strip():
        raise ValueError("The file has no header.")
    names = next(csv.reader(io.StringIO(head)))
    if len(set(names)) != len(names):
        raise ValueError("Duplicate column names.")
    # A quoted line end may stand anywhere, and files are bounded in size.
    return spark.read.csv(path, header=True, inferSchema=True, mode="FAILFAST", multiLine=True, escape='"')


def _flat(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("Duplicate keys in a record.")
    return found


@_friendly
def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Flat records only: an array of objects, or an object on each line.  The first
    records are looked at for repeated keys, which Spark would merge."""
    head = _head(spark, path).lstrip()
    if not lines and not head.startswith("["):
        raise ValueError("Not an array of records.")
    for part in re.findall(r"\{[^{}]*\}", head):
        json.loads(part, object_pairs_hook=_flat)
    df = spark.read.json(path, multiLine=not lines, mode="FAILFAST")
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    if nested:
        raise ValueError(f"Nested values in: {', '.join(nested)}")
    if not df.columns:
        raise ValueError("No records.")
    return df


def _windows_1252(content: Column) -> Column:
    """Spark decodes Latin-1; the two differ in the bytes 80 to 9F only."""
    other = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
    known = {k: v for k, v in other.items() if v}
    return F.translate(F.decode(content, "ISO-8859-1"), "".join(known), "".join(known.values()))


def read_documents(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """source (the path below the folder), text of all text files there, in order: UTF-8
    with or without a byte order mark, UTF-16 with one, else Windows-1252.  Empty files
    go; texts with control characters go too, or are an error if ``strict``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    head = F.hex(F.substring("content", 1, 2))
    read = F.when(head.isin("FFFE", "FEFF"), F.decode("content", "UTF-16")).when(F.is_valid_utf8(F.col("content").cast("string")), F.regexp_replace(F.col("content").cast("string"), f"^{BOM}", "")).otherwise(_windows_1252(F.col("content")))
    root = path.rstrip("/").rsplit("/", 1)[-1]
    rows = files.select(F.substring_index("path", f"/{root}/", -1).alias("source"), read.alias("text")).where(F.trim("text") != "")
    odd = F.col("text").rlike(r"[\x00-\x08\x0b\x0e-\x1f]")
    if strict and not (bad := rows.where(odd).select("source").limit(5)).isEmpty():
        raise ValueError(f"Control characters in: {', '.join(r.source for r in bad.collect())}")
    return rows.where(~odd).orderBy("source")


def load_chunks(spark: SparkSession, *folders: str, strict: bool = False) -> DataFrame:
    """The chunks (of ``text.chunks``) of all text files below the folders; a file's source
    begins with its folder's name where there are several."""
    found = []
    for folder in folders:
        docs = read_documents(spark, folder, strict)
        name = folder.rstrip("/").rsplit("/", 1)[-1]
        found.append(docs if len(folders) == 1 else docs.withColumn("source", F.concat(F.lit(name + "/"), "source")))
    return text.chunks(reduce(DataFrame.unionByName, found))


def fingerprint(spark: SparkSession, folder: str) -> str:
    """Eight digits that change when a file below a folder comes, goes, grows or is written
    again; contents aren't read, and the files' order doesn't matter."""
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    one = F.xxhash64(F.substring_index("path", f"/{root}/", -1), "length", F.unix_micros("modificationTime"))
    row = files.select(one.alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias("s"))
    return row.select(F.left(F.md5(F.concat_ws("|", "n", "x", "s")), F.lit(8))).head()[0]
