"""A catalogue of sources: who they are by content, in which state, and whether files and
entries agree.  Entries and states are Parquet tables that only ever grow.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import kept, new_folder
from . import loaders, normalise

STATES = ("registered", "normalized", "indexed", "failed")
#: Which states may follow a state.
NEXT = {None: ("registered",), "registered": ("normalized", "failed"), "normalized": ("indexed", "failed", "normalized"), "indexed": ("normalized", "failed"), "failed": ("registered", "normalized")}
ENTRY = "resource_id string, source_type string, content_hash string, filename string, path string"
STATE = "resource_id string, seq long, state string"
LOCATION = "resource_id string, source_type string, path string"
ARTIFACT = "resource_id string, artifact_type string, path string, manifest string"
#: Entries that are written at once.
BATCH = 10_000


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def resource_id(source_type: Column, content: Column) -> Column:
    """An identity of what a source is: its type and its bytes."""
    return F.sha2(F.concat(F.encode(source_type, "UTF-8"), F.lit(bytes([0])), content), 256)


def entries_of(spark: SparkSession, folder: str, source_type: str) -> DataFrame:
    """The files below a folder as entries; equal files are one, by the path that sorts first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = files.select(resource_id(F.lit(source_type), F.col("content")).alias("resource_id"), F.lit(source_type).alias("source_type"), content_hash(F.col("content")).alias("content_hash"), "path")
    return rows.groupBy("resource_id", "source_type", "content_hash").agg(F.min("path").alias("path")).withColumn("filename", F.substring_index("path", "/", -1)).select("resource_id", "source_type", "content_hash", "filename", "path")


def duplicates(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` (source_type, content_hash and others) with status and action: new
    (register), known (use_existing), or known under another type only (review)."""
    same = known.select("source_type", "content_hash").distinct().withColumn("_same", F.lit(True))
    any_ = known.groupBy("content_hash").agg(F.lit(True).alias("_any"))
    both = incoming.join(same, ["source_type", "content_hash"], "left").join(any_, "content_hash", "left")
    status = F.when(F.col("_same"), "known").when(F.col("_any"), "type_conflict").otherwise("new")
    action = F.when(F.col("_same"), "use_existing").when(F.col("_any"), "review").otherwise("register")
    return both.select(*incoming.columns, status.alias("status"), action.alias("action"))


def by_content(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """content_hash, first (the smallest key), copies of equal contents."""
    return rows.groupBy(content_hash(content).alias("content_hash")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def reconciled(entries: DataFrame, files: DataFrame) -> DataFrame:
    """path, state: missing (an entry without its file), hash_mismatch, orphan (a file
    without an entry), ok.  Both have path and content_hash."""
    e, f = entries.select("path", F.col("content_hash").alias("wanted")), files.select("path", F.col("content_hash").alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("wanted").isNull(), "orphan").when(F.col("wanted") != F.col("found"), "hash_mismatch").otherwise("ok")
    return e.join(f, "path", "full_outer").select("path", state.alias("state"))


def unreferenced(entries: DataFrame, used: DataFrame) -> DataFrame:
    """The entries that nothing uses.  ``used``: resource_id."""
    return entries.join(used.select("resource_id"), "resource_id", "left_anti").select(*entries.columns)


def latest(states: DataFrame) -> DataFrame:
    """resource_id, state: the last of each resource."""
    return states.groupBy("resource_id").agg(F.max_by("state", "seq").alias("state"))


def allowed(states: DataFrame, wanted: DataFrame) -> DataFrame:
    """resource_id, before, wanted, allowed: whether each may go to the state it wants.
    ``wanted``: resource_id, state."""
    pairs = [(a, b) for a, after in NEXT.items() for b in after]
    both = wanted.select("resource_id", F.col("state").alias("wanted")).join(latest(states).withColumnRenamed("state", "before"), "resource_id", "left")
    fits = F.lit(False)
    for a, b in pairs:
        fits = fits | ((F.col("before").isNull() if a is None else F.coalesce(F.col("before") == a, F.lit(False))) & (F.col("wanted") == b))
    return both.select("resource_id", "before", "wanted", fits.alias("allowed"))


def verified(found: DataFrame, stored: DataFrame) -> DataFrame:
    """``found`` (of ``duplicates``, with resource_class if classes matter) with
    ``existing_id``, ``artifact_verified`` (whether the bytes that are stored are those
    that are known), ``conflict`` and ``advice``.  ``stored``: resource_id, source_type,
    content_hash, resource_class, stored_hash (null where the file is gone)."""
    same = stored.groupBy("content_hash").agg(
        F.min(F.struct("resource_id", "source_type", "resource_class", "stored_hash")).alias("_e"), F.count_distinct("source_type").alias("_types")
    )
    both = found.join(same, "content_hash", "left")
    known = F.col("_e").isNotNull()
    sure = F.coalesce(F.col("_e.stored_hash") == F.col("content_hash"), F.lit(False))
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    asked = F.col("resource_class") if "resource_class" in found.columns else F.col("_e.resource_class")
    by_class = F.when(~F.col("_e.resource_class").eqNullSafe(asked), F.concat(F.lit("Existing source is classified as "), quoted(F.col("_e.resource_class")), F.lit("; the requested classification is "), quoted(asked), F.lit(".")))
    by_type = F.when(F.col("_e.source_type") != F.col("source_type"), F.concat(F.lit("Exact bytes are already registered as "), quoted(F.col("_e.source_type")), F.lit(", not "), quoted(F.col("source_type")), F.lit(".")))
    several = F.when(F.col("_types") > 1, F.lit("These exact bytes are registered under several source types."))
    conflict = F.nullif(F.concat_ws(" ", by_class, by_type, several), F.lit(""))
    clash = known & conflict.isNotNull()
    advice = (
        F.when(~known, "Register the source.").when(clash & ~sure, "Resolve the classification conflict and reconcile the stored original.").when(clash, "Resolve the classification conflict.")
        .when(~sure, "Run catalogue reconciliation; the preserved original is missing or has changed.").otherwise("Reuse the existing source.")
    )
    return both.select(*found.columns, F.col("_e.resource_id").alias("existing_id"), F.when(known, sure).alias("artifact_verified"), F.when(known, conflict).alias("conflict"), advice.alias("advice"))


def claim(spark: SparkSession, path: str, owner: str) -> bool:
    """Creates a file that says who made it; false if it's there.  Of several writers one
    succeeds: a file system creates a file without overwriting in one step."""
    jvm = spark._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jpath.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            with open(jpath.toUri().getPath(), "x", encoding="utf-8") as f:
                f.write(owner)
            return True
        except FileExistsError:
            return False
    try:
        out = fs.create(jpath, False)
    except Py4JJavaError as error:
        if fs.exists(jpath):
            return False
        raise error
    try:
        out.write(bytearray(owner.encode()))
    finally:
        out.close()
    return True


class Catalogue:
    """Entries and states below a folder; registering what is there changes nothing.

    Whoever registers a source or writes the next number of its states claims a file that
    is named after it, so two writers can't both do it.  Rows are written after the claim;
    a claim without rows, left by a writer that ended in between, is taken over with
    ``release``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jpath):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)

    @property
    def entries(self) -> DataFrame:
        return self._table("entries", ENTRY)

    @property
    def states(self) -> DataFrame:
        return self._table("states", STATE)

    @property
    def locations(self) -> DataFrame:
        """Where each source was found: equal files are one source with several places."""
        return self._table("locations", LOCATION).distinct()

    @property
    def artifacts(self) -> DataFrame:
        return self._table("artifacts", ARTIFACT)

    def _append(self, rows: DataFrame, name: str) -> None:
        """Rows in a folder of their own: writers that commit at once don't meet."""
        rows.write.mode("errorifexists").parquet(f"{self.root}/{name}/{uuid.uuid4().hex}")

    def _claimed(self, kind: str, name: str) -> bool:
        return claim(self.spark, f"{self.root}/claims/{kind}/{name}", uuid.uuid4().hex)

    def register(self, folder: str, source_type: str) -> DataFrame:
        """Adds the files below a folder that aren't known yet; all of them with status.
        New ones come to the driver some at a time."""
        checked = kept(duplicates(self.entries, entries_of(self.spark, folder, source_type)), new_folder(self.spark, "register"), "checked")
        names = [f.split()[0] for f in ENTRY.split(", ")]
        batch: list[tuple] = []
        for r in checked.where("status = 'new'").toLocalIterator():
            if self._claimed("sources", r.resource_id):
                batch.append(tuple(r[c] for c in names))
            if len(batch) >= BATCH:
                self._add(batch)
                batch = []
        self._add(batch)
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        found = files.select(resource_id(F.lit(source_type), F.col("content")).alias("resource_id"), F.lit(source_type).alias("source_type"), "path")
        fresh = found.join(self.locations, ["resource_id", "path"], "left_anti").select("resource_id", "source_type", "path")
        self._append(fresh, "locations")
        return checked

    def _add(self, rows: list[tuple]) -> None:
        if rows:
            self._append(self.spark.createDataFrame(rows, ENTRY), "entries")
            self._mark([(r[0], "registered") for r in rows])

    def release(self, resource: str) -> bool:
        """Gives up a claim whose entry was never written; false if there is an entry."""
        if not self.entries.where(F.col("resource_id") == resource).isEmpty():
            return False
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/claims/sources/{resource}")
        return bool(jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, False))

    def mark(self, resource: str, state: str) -> None:
        if state not in STATES:
            raise ValueError(f"Unknown state: {state}")
        row = allowed(self.states, self.spark.createDataFrame([(resource, state)], "resource_id string, state string")).head()
        if not row.allowed:
            raise ValueError(f"A source that is {row.before or 'unknown'} can't become {state}")
        self._mark([(resource, state)])

    def _mark(self, rows: list[tuple[str, str]]) -> None:
        """The next numbers of each resource; a number that another writer claimed in the
        meantime is passed over."""
        asked = self.spark.createDataFrame([(r,) for r, _ in rows], "resource_id string")
        last = {r.resource_id: r.seq for r in self.states.join(F.broadcast(asked), "resource_id", "left_semi").groupBy("resource_id").agg(F.max("seq").alias("seq")).collect()}
        found = []
        for resource, state in rows:
            seq = last.get(resource, 0) + 1
            while not self._claimed("states", f"{resource}-{seq}"):
                seq += 1
            found.append((resource, seq, state))
        self._append(self.spark.createDataFrame(found, STATE), "states")

    def stored(self) -> DataFrame:
        """resource_id, source_type, content_hash, stored_hash: what is at the entries'
        paths now."""
        entries = self.entries
        folders = [r.f for r in entries.select(F.regexp_replace("path", "/[^/]*$", "").alias("f")).distinct().limit(1000).collect()]
        if not folders:
            return entries.select("resource_id", "source_type", "content_hash", F.lit(None).cast("string").alias("stored_hash"))
        files = self.spark.read.format("binaryFile").load(folders).select("path", content_hash(F.col("content")).alias("stored_hash"))
        return entries.join(files, "path", "left").select("resource_id", "source_type", "content_hash", "stored_hash")

    def normalise_table(self, resource: str, df: DataFrame) -> dict:
        """A table as CSV that reads back equal, its manifest row, and the state."""
        if not self._claimed("artifacts", resource):
            raise FileExistsError(f"{resource} has an artifact")
        path = f"{self.root}/normalized/datasets/{resource}"
        manifest = normalise.write_table(df, path)
        return self._artifact(resource, "normalized_dataset", path, manifest)

    def normalise_documents(self, resource: str, documents: DataFrame) -> dict:
        """Documents (source, text) as TOPIC and SECTION texts, likewise."""
        if not self._claimed("artifacts", resource):
            raise FileExistsError(f"{resource} has an artifact")
        path = f"{self.root}/normalized/documents/{resource}"
        manifest = normalise.write_documents(documents, path)
        return self._artifact(resource, "normalized_document", path, manifest)

    def _artifact(self, resource: str, kind: str, path: str, manifest: dict) -> dict:
        row = (resource, kind, path, loaders.to_json(manifest))
        self._append(self.spark.createDataFrame([row], ARTIFACT), "artifacts")
        self.mark(resource, "normalized")
        return manifest

    def register_confirmed(self, folder: str, source_type: str, df: DataFrame) -> dict:
        """An upload that someone confirmed: one file below a folder is registered, if it
        isn't yet, and the table read from it is normalised."""
        checked = self.register(folder, source_type).limit(2).collect()
        if len(checked) != 1:
            raise ValueError("One file is confirmed at a time")
        return self.normalise_table(checked[0].resource_id, df)

    def read_normalised(self, resource: str) -> DataFrame:
        row = self.artifacts.where((F.col("resource_id") == resource) & (F.col("artifact_type") == "normalized_dataset")).head()
        if row is None:
            raise KeyError(f"{resource} has no normalised table")
        return normalise.read_table(self.spark, row.path, json.loads(row.manifest))

    def get(self, resource: str) -> DataFrame:
        return self.listed().where(F.col("resource_id") == resource)

    def listed(self) -> DataFrame:
        return self.entries.join(latest(self.states), "resource_id", "left")

    def reconcile(self, folder: str) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", content_hash(F.col("content")).alias("content_hash"))
        return reconciled(self.entries, files)
