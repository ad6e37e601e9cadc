"""Token-id files: fixed-size id blocks as compressed bit or byte planes.

Layout of a file (all numbers little-endian)::

    magic "LDPLANE1" | u8 planes per id (4: byte planes, 32: bit planes) | u32 ids per block
    blocks, one after the other: their planes, each compressed with zstandard
    index, compressed: for each block u64 offset, u32 ids, u32 crc32 of the ids,
        u32 length of each plane (0: a plane of zeros, which takes no bytes)
    documents, compressed: i64 doc_id (least value: null), u64 ids of each document
    u64 offset, u32 length of the index | u64 offset, u32 length of the documents
    | u32 blocks | u64 documents | magic

A reader takes the two tables from the end and then one block at a time, so it
holds one block however long a document is; ``read_block`` reads any one block.

Query ``op2_bitplane_token_ids``: the whole ``documents`` table, encoded, put in
ascending order of doc_id by value ranges, written as such files below the shared
folder, and read back.  Null text: empty, so its only id is the end id.  Null
doc_id sorts first.  Rows with equal doc_ids stand together, repeated rows each.
An empty table gives no files and no rows.  Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, docs_of, frugal, open_in, open_out, read_table
from .words import WordCoder, default_tokenizer

MAGIC = b"LDPLANE1"
END_ID = 2
BLOCK_IDS = 1 << 15
#: A file is closed at the first document end past so many ids.
FILE_IDS = 1 << 25
LEVEL = 1
NULL_ID = -(1 << 63)
TAIL = struct.Struct("<QIQIIQ8s")


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [rows[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes | None], n: int) -> np.ndarray:
    if len(planes) == 4:
        rows = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            if plane is not None:
                rows[:, k] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, plane in enumerate(planes):
            if plane is not None:
                bits[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), bitorder="little")[:n]
        rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").ravel()


class PlaneWriter:
    """Writes documents' ids to one file; holds less than a block and a document."""

    def __init__(self, stream, planes: int = 4, block_ids: int = BLOCK_IDS, level: int = LEVEL) -> None:
        import zstandard

        self.stream, self.planes, self.block_ids = stream, planes, block_ids
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.waiting, self.waiting_ids = [], 0
        self.index, self.docs, self.lengths = [], [], []
        self.at = 0
        self._put(MAGIC + struct.pack("<BI", planes, block_ids))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        parts = [self.pack(p) if p.strip(b"\0") else b"" for p in to_planes(ids, self.planes)]
        self.index.append(struct.pack(f"<QII{self.planes}I", self.at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *map(len, parts)))
        self._put(b"".join(parts))

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        whole = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for at in range(0, whole, self.block_ids):
            self._block(ids[at : min(at + self.block_ids, whole)])
        self.waiting, self.waiting_ids = [ids[whole:].tobytes()], len(ids) - whole

    def add(self, doc_id: int | None, packed: bytes) -> None:
        """packed: the document's ids as little-endian unsigned 32-bit integers."""
        self.waiting.append(packed)
        self.waiting_ids += len(packed) // 4
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.lengths.append(len(packed) // 4)
        if self.waiting_ids >= 16 * self.block_ids:
            self._flush(last=False)

    def close(self) -> None:
        self._flush(last=True)
        index, at = self.pack(b"".join(self.index)), self.at
        self._put(index)
        docs, docs_at = self.pack(np.array(self.docs, "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes()), self.at
        self._put(docs)
        self._put(TAIL.pack(at, len(index), docs_at, len(docs), len(self.index), len(self.docs), MAGIC))
        self.stream.close()


class PlaneReader:
    def __init__(self, file) -> None:
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        head = self._at(0, 13)
        if head[:8] != MAGIC:
            raise ValueError("not a plane file")
        self.planes, self.block_ids = struct.unpack("<BI", head[8:])
        at, length, docs_at, docs_length, blocks, docs, magic = TAIL.unpack(self._at(file.size() - TAIL.size, TAIL.size))
        if magic != MAGIC:
            raise ValueError("the file has no end")
        each = struct.Struct(f"<QII{self.planes}I")
        self.index = list(each.iter_unpack(self.unpack(self._at(at, length)))) if blocks else []
        table = self.unpack(self._at(docs_at, docs_length)) if docs else b""
        self.docs = np.frombuffer(table[: 8 * docs], "<i8")
        self.lengths = np.frombuffer(table[8 * docs :], "<u8")

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def read_block(self, k: int) -> np.ndarray:
        offset, n, crc, *lengths = self.index[k]
        planes: list[bytes | None] = []
        data, at = self._at(offset, sum(lengths)), 0
        for length in lengths:
            planes.append(self.unpack(data[at : at + length]) if length else None)
            at += length
        ids = from_planes(planes, n)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids

    def documents(self) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
        """Each document's id and its ids in runs; the runs must be read in order."""
        block, k, at = np.empty(0, "<u4"), 0, 0

        def runs(left: int) -> Iterator[np.ndarray]:
            nonlocal block, k, at
            while left:
                if at == len(block):
                    block, k, at = self.read_block(k), k + 1, 0
                run = block[at : at + left]
                at, left = at + len(run), left - len(run)
                yield run

        for doc_id, length in zip(self.docs.tolist(), self.lengths.tolist()):
            yield None if doc_id == NULL_ID else doc_id, runs(length)


def by_ranges(df: DataFrame, key: str, *ties: str) -> DataFrame:
    """Deals rows to value ranges of ``key``, each within one partition and in
    order; column ``bucket`` numbers the ranges in ascending order, nulls first.  The
    bounds come from the key column alone, so wide rows are read and moved once.  A
    value with more rows than a range should have, null too, is dealt to several
    ranges of its own by a hash of the rows."""
    spark = df.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = df.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 10_000).alias("bounds"), F.count("*").alias("rows"), F.count(key).alias("keyed")).head()
    bounds = [int(b) for b in row.bounds or []]
    nulls = -(-n * (row.rows - row.keyed) // max(1, row.rows))
    draw = F.xxhash64(*ties, F.monotonically_increasing_id())
    many = [v for v in sorted(set(bounds)) if bounds.count(v) > 1]
    cuts = F.array(*(F.lit(b).cast("long") for b in bounds))
    bucket = F.size(F.filter(cuts, lambda b: b <= F.col(key))) + (nulls or 1)
    for v in many:
        bucket = F.when(F.col(key) == v, F.lit((nulls or 1) + sum(b < v for b in bounds) + 1) + F.pmod(draw, F.lit(bounds.count(v)))).otherwise(bucket)
    bucket = F.when(F.col(key).isNull(), F.pmod(draw, F.lit(nulls or 1))).otherwise(bucket).cast("int")
    return df.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", key, *ties)


def write_ids(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, *, end_id: int | None = END_ID, planes: int = 4, block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes its files; the returned frame
    names them (bucket, part, file, n_docs, n_ids) and is lazy: each time it
    runs, it writes files under new names."""

    @frugal
    def write(rows):
        import pyarrow as pa

        coder = WordCoder(tokenizer)
        end = b"" if end_id is None else struct.pack("<I", end_id)
        open_bucket, part, writer, name, n = None, 0, None, "", 0

        def closed():
            writer.close()
            return pa.RecordBatch.from_pydict({"bucket": [open_bucket], "part": [part], "file": [name], "n_docs": [len(writer.docs)], "n_ids": [n]}, schema=schema)

        schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        for batch in rows:
            doc_ids, buckets = batch.column("doc_id").to_pylist(), batch.column("bucket").to_pylist()
            for first, offsets, ids in coder.batches(batch.column("text")):
                bounds = offsets.tolist()
                for k in range(len(bounds) - 1):
                    at = first + k
                    if writer is not None and (buckets[at] != open_bucket or n >= file_ids):
                        yield closed()
                        part = part + 1 if buckets[at] == open_bucket else 0
                        writer = None
                    if writer is None:
                        open_bucket, n = buckets[at], 0
                        name = f"{open_bucket:06d}-{part:04d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.planes"
                        writer = PlaneWriter(open_out(folder, name), planes, block_ids)
                    writer.add(doc_ids[at], ids[bounds[k] : bounds[k + 1]].tobytes() + end)
                    n += bounds[k + 1] - bounds[k] + len(end) // 4
        if writer is not None:
            yield closed()

    ordered = by_ranges(docs_of(docs, "doc_id", "text"), "doc_id", "text")
    return ordered.mapInArrow(write, "bucket int, part int, file string, n_docs long, n_ids long")


def read_ids(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids, from the files
    that ``files`` names.  The running sum goes over one row per file."""

    @frugal
    def read(rows):
        import pyarrow as pa

        for batch in rows:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                with open_in(folder, name) as file:
                    for doc_id, runs in PlaneReader(file).documents():
                        crc, n = 0, 0
                        for run in runs:
                            crc, n = zlib.crc32(run.tobytes(), crc), n + len(run)
                        for k, v in zip(out, (doc_id, base, n, crc)):
                            out[k].append(v)
                        base += n
                        if len(out["doc_id"]) == 10_000:
                            yield pa.RecordBatch.from_pydict(out, schema=schema)
                            out = {k: [] for k in out}
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    before = Window.orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    based = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    # A number is named, so that the few bytes of the manifest aren't put in one task.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return based.select("file", "base").repartition(tasks, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def bitplane_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    work = Workspace(spark, "planes")
    folder = work.folder("ids")
    files = work.table(write_ids(spark, read_table(spark, sf_dir, "documents"), folder, tokenizer or default_tokenizer()), "files")
    return read_ids(spark, files, folder)
