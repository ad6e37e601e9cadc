"""WARC archives as chunked records.

Writing: a payload is cut on the JVM's side into rows of at most ``CHUNK`` bytes
(record identifier, chunk number, bytes), one at a time, which a task streams into its
archive; beside the payload's row it holds one chunk.  Of records with equal payloads of at least a given size,
the one with the smallest identifier is a ``response``; the others are ``revisit``
records without the payload, with its digest, its length and the identifier they
refer to.  Equality is that of SHA-1 and length; only these move to find it.

Reading: an archive is streamed, one gzip member per record, into rows of record
identifier, chunk number, bytes, and the SHA-1 of the payload up to the chunk's
end; ``assembled`` takes the length and the digest of the last chunk, so records of
any size are summed up without being put together.

Archives are files of the shared folder under names of their task attempt; a
manifest names those of committed attempts.

Query ``op6_warc_chunks``: every row of ``pages`` is one record and one result row.
Null html: an empty payload.  Empty payloads are equal to each other.  A repeated
page_id with an equal payload is a revisit of itself beyond the first row; with
another payload it's a record of its own.  Null page_ids: records without a
number, which come after all others among equals.  An empty table gives no
archives and no rows.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32encode

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, blank_text, frugal, open_in, open_out, read_table

CHUNK = 1 << 18
FILE_BYTES = 256 << 20
NO_ID = "none"


def classified(pages: DataFrame, work: Workspace, least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """All rows (page_id, url, payload, size, sha1 in hex), and the page_ids with
    equal payloads (page_id, sha1, size, refers_to, copies).  Only digests are
    compared here; payloads meet their classes when they are written."""
    payload = F.encode(blank_text(F.col("html")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = base.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    # Equal pairs of page_id and payload are counted: the first row is what the others revisit.
    counted = work.table(keyed.groupBy("page_id", "sha1", "size").agg(F.count("*").alias("copies"), F.min("url").alias("any_url")), "digests")
    order = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id").alias("page_id"))
    first = counted.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.min(order).alias("first"), F.sum("copies").alias("n")).where("n > 1")
    repeated = work.table(counted.join(first, ["sha1", "size"]).select("page_id", "sha1", "size", F.col("first.page_id").alias("refers_to"), "copies"), "repeated")
    return keyed, repeated


def write_archives(pages: DataFrame, folder: str, work: Workspace, least_bytes: int = 0, chunk: int = CHUNK, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes archives of all rows; the manifest: file, records."""
    keyed, repeated = classified(pages, work, least_bytes)
    joined = keyed.alias("k").join(repeated.alias("r"), F.col("k.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("k.sha1") == F.col("r.sha1")) & (F.col("k.size") == F.col("r.size")), "left")
    same = F.col("r.sha1").isNotNull() & F.col("k.page_id").eqNullSafe(F.col("r.refers_to"))
    # Rows that repeat a page_id and payload are numbered: all but a response's first revisit.
    several = joined.select("k.*", "r.refers_to", F.col("r.sha1").isNotNull().alias("equal"), same.alias("own"), F.coalesce("r.copies", F.lit(1)).alias("copies"))
    plain = several.where("copies = 1").withColumn("nth", F.lit(1))
    copies = several.where("copies > 1").withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "sha1").orderBy("url")))
    rows = plain.unionByName(copies).withColumn("revisit", F.col("equal") & (~F.col("own") | (F.col("nth") > 1)))
    number = F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit(NO_ID)), F.left("sha1", F.lit(8)), "nth")
    bare = F.col("revisit") | (F.col("size") == 0)
    last = F.when(bare, 0).otherwise(((F.col("size") - 1) / chunk).cast("int"))
    # Only chunk numbers are listed; a chunk is cut out of the payload when its row is made.
    numbered = rows.withColumn("number", number).select("number", "page_id", "url", "size", "sha1", "refers_to", "revisit", "payload", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    data = F.when(bare, F.lit(b"")).otherwise(F.substring(F.col("payload"), F.col("chunk") * chunk + 1, F.lit(chunk)))
    chunked = numbered.select("number", "page_id", "url", "size", "sha1", "refers_to", "revisit", "chunk", data.alias("data"))

    @frugal
    def write(batches):
        import pyarrow as pa

        out, name, records, packer, written = None, "", 0, None, 0

        def end():
            nonlocal packer, written
            if packer is not None:
                packed = packer.compress(b"\r\n\r\n") + packer.flush()
                out.write(packed)
                written += len(packed)
                packer = None

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": [records]}, schema=pa.schema([("file", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("number", "page_id", "url", "size", "sha1", "refers_to", "revisit", "chunk", "data")]
            for number, page_id, url, size, sha1, refers_to, revisit, k, data in zip(*cols):
                if k == 0:
                    end()
                    if out is not None and written >= file_bytes:
                        yield closed()
                        out = None
                    if out is None:
                        name = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
                        out, records, written = open_out(folder, name), 0, 0
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(packer.compress(_head(number, page_id, url, size, sha1, refers_to, revisit)))
                    records += 1
                if data:
                    packed = packer.compress(data)
                    out.write(packed)
                    written += len(packed)
        end()
        if out is not None:
            yield closed()

    return chunked.mapInArrow(write, "file string, records long")


def _uuid(number: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, number)}>"


def _head(number, page_id, url, size, sha1, refers_to, revisit) -> bytes:
    """A record's header and its HTTP header; the length in the latter is that of
    the whole payload in revisits too."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    digest = b32encode(bytes.fromhex(sha1)).decode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uuid(number)}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join(c for c in url or 'about:blank' if c > ' ')}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {NO_ID if page_id is None else page_id}", f"Content-Length: {len(http) + (0 if revisit else size)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {NO_ID if refers_to is None else refers_to}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


class _Members:
    """The bytes of a gzip file of many members, at most ``step`` at a time."""

    def __init__(self, file, step: int = 1 << 16) -> None:
        self.file, self.step = file, step
        self.packed, self.inflate, self.held = b"", zlib.decompressobj(31), b""

    def more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.packed, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            if not self.packed:
                self.packed = self.inflate.unconsumed_tail or self.file.read(self.step)
                if not self.packed:
                    return False
            got = self.inflate.decompress(self.packed, self.step)
            self.packed = self.inflate.unconsumed_tail
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                return None
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def take(self, most: int) -> bytes:
        if not self.held and not self.more():
            raise ValueError("the archive breaks off")
        found, self.held = self.held[:most], self.held[most:]
        return found


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])


def records(file, chunk: int = CHUNK):
    """header, HTTP header, and an iterator of the payload's pieces of each record."""
    members = _Members(file)
    while (head := members.until(b"\r\n\r\n")) is not None:
        head = _fields(head.lstrip(b"\r\n"))
        http = members.until(b"\r\n\r\n")
        left = int(head["Content-Length"]) - len(http) - 4

        def pieces():
            nonlocal left
            while left:
                parts, want = [], min(chunk, left)
                while want:
                    parts.append(members.take(want))
                    want -= len(parts[-1])
                left -= sum(map(len, parts))
                yield b"".join(parts)

        yield head, _fields(http), pieces()
        if members.until(b"\r\n\r\n") != b"":
            raise ValueError("a record doesn't end where it should")


def read_chunks(files: DataFrame, folder: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """record, page_id, record_type, refers_to, full_bytes and stated_digest (of the
    whole payload by the header), chunk, n_bytes, sha1_so_far, data of all archives."""

    @frugal
    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("record", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("full_bytes", pa.int64()), ("stated_digest", pa.string()), ("chunk", pa.int32()), ("n_bytes", pa.int64()), ("sha1_so_far", pa.string()), ("data", pa.binary())])
        number = lambda s: None if s is None or s == NO_ID else int(s)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with open_in(folder, name) as file:
                    for head, http, pieces in records(file, chunk):
                        fixed = (head["WARC-Record-ID"], number(head["X-Page-Id"]), head["WARC-Type"], number(head.get("X-Refers-To-Page-Id")), int(http["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"))
                        digest, k = hashlib.sha1(), 0
                        for piece in pieces:
                            digest.update(piece)
                            rows.append((*fixed, k, len(piece), b32encode(digest.digest()).decode(), piece if with_data else None))
                            k, held = k + 1, held + len(piece)
                            if held > 8 << 20 or len(rows) >= 5000:
                                yield _batch(rows, schema)
                                rows, held = [], 0
                        if not k:
                            rows.append((*fixed, 0, 0, b32encode(digest.digest()).decode() if fixed[2] == "response" else None, b"" if with_data else None))
                yield _batch(rows, schema)

    kind = "record string, page_id long, record_type string, refers_to long, full_bytes long, stated_digest string, chunk int, n_bytes long, sha1_so_far string, data binary"
    # A number is named, so that the few bytes of the manifest aren't put in one task.
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").repartition(tasks, "file").mapInArrow(read, kind)


def _batch(rows, schema):
    import pyarrow as pa

    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def assembled(chunks: DataFrame) -> DataFrame:
    """One row per record: the length is the sum of its chunks' (of the header in a
    revisit), the digest that of the last chunk."""
    last = F.max_by("sha1_so_far", "chunk")
    found = chunks.groupBy("record", "page_id", "record_type", "refers_to", "full_bytes", "stated_digest").agg(F.sum("n_bytes").alias("n"), last.alias("sha1"))
    response = F.col("record_type") == "response"
    return found.select(
        "page_id", F.when(response, F.col("n")).otherwise(F.col("full_bytes")).alias("payload_bytes"), F.when(response, F.col("sha1")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type", "refers_to",
    )


def warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "warc")
    folder = work.folder("archives")
    files = work.table(write_archives(read_table(spark, sf_dir, "pages"), folder, work), "files")
    work.drop("digests", "repeated")
    return assembled(read_chunks(files, folder, with_data=False))
