"""Sharding by balanced label propagation.

Documents are linked if their texts are equal.  A group of equal texts is dealt to
blocks of at most a ``BLOCK_SHARE`` of a shard's quota, so no group is larger than
what a shard can take; a block's documents are linked to its head, and the heads
of a group's blocks to each other in a row.  A label is a shard.

1. Every document starts at a shard by a hash of its doc_id (balanced).
2. ``ROUNDS`` times, by joins: a block votes for the shard where most of its
   documents are, or its neighbour block's shard if that has room; documents want
   to move there.  What a shard can take in is its quota, with ``SLACK``, less what
   it holds and keeps; a shard that more want to enter lets in blocks by a hash, in
   the share that fits.
3. Settling makes counts exact, so SLACK costs nothing while a shard has single documents: shards 0 to N mod K - 1 take one document more
   than the others.  A shard's documents beyond its quota, single documents first,
   fill the free places of the others in order.  This and the slots take ranks in
   shards, which ``ranked`` works out by value ranges: no window over a shard.

Law ``rows``: counts are at most one apart.

Query ``op8_balanced_propagation``: one row per row of ``documents``: size (UTF-8
bytes of the text, null: none, plus 8), text_crc32 (null: of the empty text), shard,
slot, and grown_shard null.  Null and empty texts are equal to each other and a
group like others.  Null and repeated doc_ids are placed like others.  Ties are
broken by hashes and doc_ids.  Very long texts are hashed whole where they are read.  An
empty table gives no rows.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, blank_text, docs_of, frugal, keyed_join, read_table

SHARDS = 24
ROUNDS = 4
BLOCK_SHARE = 2
SLACK = 1.25


def ranked(df: DataFrame, group: str, order: list[Column], work: Workspace, name: str) -> DataFrame:
    """``df`` with ``rank``: places from 0 within ``group`` by ``order``.

    Rows are sorted by value ranges of (group, order) and numbered within their
    partition; what a group has in the partitions before comes from one row per
    partition and group.  The partitions are written down first, so both steps see
    the same ones."""
    keys = [F.col(group), *order]

    @frugal
    def number(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            values = batch.column(group).to_numpy(zero_copy_only=False)
            local = np.empty(len(values), np.int64)
            if len(values):
                cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
                for low, high in zip(cuts, cuts[1:]):
                    base = n if values[low] == last else 0
                    local[low:high] = base + np.arange(high - low)
                    last, n = values[low], base + high - low
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(values), part), pa.int32()), pa.array(local)], [*batch.schema.names, "part", "local"])

    schema = df.select("*", F.lit(0).alias("part"), F.lit(0).cast("long").alias("local")).schema
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = work.table(sorted_rows.mapInArrow(number, schema), name)
    counts = numbered.groupBy(group, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(group, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = numbered.join(bases, [group, "part"])
    return joined.withColumn("rank", F.col("base") + F.col("local")).drop("part", "local", "base")


def _quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def _pick(values: list, at: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), at)


def propagated(rows: DataFrame, total: int, shards: int, work: Workspace, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (row, doc_id, text key) with the shard of each after propagation, and
    ``linked``: whether it has equals."""
    block_rows = max(1, total // shards // BLOCK_SHARE)
    sizes = work.table(rows.groupBy("k1", "k2").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    joined = keyed_join(rows, sizes, ["k1", "k2"], "m", total, outer=True)
    blocks = F.ceil(F.col("m") / block_rows)
    # A document's block within its group, by a hash of the document.
    number = F.pmod(F.xxhash64("row", F.lit(1)), blocks)
    start = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    graph = joined.select("row", start.alias("shard"), F.when(F.col("m").isNotNull(), F.xxhash64("k1", "k2")).alias("team"), number.alias("number"))
    now = work.table(graph, "label0")
    quota = [int(q * SLACK) + 1 for q in _quotas(total, shards)]
    for k in range(rounds):
        linked = now.where("team is not null")
        votes = linked.groupBy("team", "number", "shard").agg(F.count("*").alias("n"))
        heads = votes.groupBy("team", "number").agg(F.max_by("shard", F.struct("n", F.xxhash64("team", "shard"))).alias("wish"), F.sum("n").alias("m"))
        # Every second block of a group takes its neighbour's wish: cut edges between blocks go.
        pair = F.floor(F.col("number") / 2)
        lead = heads.groupBy("team", pair.alias("pair")).agg(F.max_by("wish", F.struct("m", "number")).alias("wish"))
        heads = heads.select("team", "number", "m", pair.alias("pair")).join(lead, ["team", "pair"]).drop("pair")
        heads = work.table(heads, f"wish{k}")
        wished = keyed_join(linked, heads, ["team", "number"], "m", total)
        moves = wished.where("shard <> wish")
        flow = {(r.shard, r.wish): r.n for r in moves.groupBy("shard", "wish").agg(F.count("*").alias("n")).collect()}  # shards squared at most
        held = {r.shard: r.n for r in now.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        if not flow:
            break
        into = [sum(n for (_, d), n in flow.items() if d == s) for s in range(shards)]
        out = [sum(n for (o, _), n in flow.items() if o == s) for s in range(shards)]
        share = [min(1.0, max(0.0, (quota[s] - held.get(s, 0) + out[s] * 0.5) / into[s])) if into[s] else 0.0 for s in range(shards)]
        draw = F.pmod(F.xxhash64("team", "number", F.lit(k)), F.lit(1 << 20)) / (1 << 20)
        go = draw < _pick(share, F.col("wish"))
        moved = wished.select("row", F.when(go, F.col("wish")).otherwise(F.col("shard")).alias("shard"), "team", "number")
        now = work.table(moved.unionByName(now.where("team is null")), f"label{k + 1}")
        work.drop(f"label{k}", f"wish{k}")
    return now


def settled(labels: DataFrame, total: int, shards: int, work: Workspace) -> DataFrame:
    """row, shard with exact quotas."""
    quota = _quotas(total, shards)
    order = [F.col("team").isNull(), F.col("team"), F.col("number"), F.col("row")]
    placed = ranked(labels, "shard", order, work, "placed")
    placed = work.table(placed, "ranks")
    held = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    stay = placed.where(F.col("rank") < _pick(quota, F.col("shard"))).select("row", "shard")
    over = [max(0, held.get(s, 0) - quota[s]) for s in range(shards)]
    free = [max(0, quota[s] - held.get(s, 0)) for s in range(shards)]
    first = [sum(over[:s]) for s in range(shards)]
    ends = [sum(free[: s + 1]) for s in range(shards)]
    place = F.col("rank") - _pick(quota, F.col("shard")) + _pick(first, F.col("shard"))
    to = F.size(F.filter(F.array(*(F.lit(e) for e in ends)), lambda e: e <= place))
    return stay.unionByName(placed.where(F.col("rank") >= _pick(quota, F.col("shard"))).select("row", to.cast("int").alias("shard")))


def shard_rows(docs: DataFrame, work: Workspace, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = blank_text(F.col("text"))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(7)).alias("k2"))
    # Numbers of rows, not doc_ids, identify rows from here on: they are written down once.
    keys = work.table(keys.withColumn("row", F.monotonically_increasing_id()), "rows")
    total = keys.count()
    labels = propagated(keys.select("row", "k1", "k2"), total, shards, work, rounds)
    done = work.table(settled(labels, total, shards, work), "settled")
    work.drop("placed", "ranks", "sizes")
    full = keys.select("row", "doc_id", "size", "text_crc32").join(done, "row")
    slots = ranked(full, "shard", [F.col("doc_id"), F.col("row")], work, "slots")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def balanced_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(docs_of(read_table(spark, sf_dir, "documents"), "doc_id", "text"), Workspace(spark, "shards"))
