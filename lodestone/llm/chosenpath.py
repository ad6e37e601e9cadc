"""Near-duplicates by a chosen-path set similarity join.

A document is the set of its word shingles, hashed to 64 bits.  Equal sets form a
class; one representative of each goes on (``classes``).  Then, for each of
``TREES`` independent trees (``nodes``): a node's members are branched by a
selected minwise token of theirs, again and again, until a node holds at most
``SMALL`` members or the path is ``DEPTH`` long.  Two sets of similarity s stay
together with chance s at each branching, so they share a final node of some tree
with chance 1 - (1 - s**depth)**TREES: at 0.85 over 0.99999 for nodes of one or two
branchings, 0.9999 at full depth; at 0.8 over 0.9998 and 0.999.

A final node of at most ``BLOCK`` members is compared exhaustively on sketches: two
bits of each of the 64 minhashes, and the set sizes.  A link can't miss the bound
on sizes and misses that on bits with chance under 1e-6.  What passes, and the
members of any larger final node, make up groups (``candidate_groups``; a spanning
forest of the pairs is enough).  Every link lies within a group, and a group's
links are found on full sets (``verified``): blocks of about ``BLOCK`` documents,
fewer if their sets together exceed ``BLOCK_SHINGLES``, are compared in one task, and
only links that join components come out.  A group of one block takes one task.  A
larger one first compares each block with itself and with block 0, which grows in
proportion to the group; then whatever isn't in the group's main component yet is
compared with everything in the group.  No cap, no sample; pairs inside a component
need no look, as they can't change it.

A row is known by two hashes, of its doc_id and of its text.

Query ``op4_chosen_path_neardup``: one row per row of ``documents``; sets of
3-word shingles and 100 * intersection >= 85 * union.  Null and blank texts: the
empty set, linked with nothing.  Rows with one doc_id are one document, linked by
any of their texts; each row keeps its own n_shingles.  Rows without a doc_id are
documents too: their component_id is the smallest doc_id they reach, null if there is
none, and kept is true only then.  Very long texts are sets of all their shingles.  An
empty table gives no rows.  Other columns, whatever their names, are not read.

Stage ``keep_one_each``: of each group of rows whose texts are linked, the row with
the smallest doc_id stays (null comes last; of equal doc_ids the one with the smaller
hash of its text; of equal rows one of them).  Here a doc_id links nothing, so a
repeated doc_id with another text stays.  Rows with null or blank texts all stay.
Other columns, whatever their names, aren't read or changed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, fresh, frugal, keyed_join, read_table, sift, text_bytes
from .components import connected_components

TREES, DEPTH = 16, 4
SMALL = 24
BLOCK = 256
BLOCK_SHINGLES = 1 << 19
#: Standard deviations by which a link's sketch may miss its expectation.
SCREEN = 5.0

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20240229).integers(1, 2**63, size=(2, TREES * DEPTH), dtype=np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(dict):
    """word -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= 200_000:
                self.clear()
            self[word] = h
        return h


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAPS = bytes(range(9, 14)) + b" "


def shingles(text: bytes, n: int, words: Words) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles (bytes.split cuts at
    exactly space and \\t, \\n, \\v, \\f, \\r)."""
    h = np.fromiter(map(words.__getitem__, text.translate(_LOWER).split()), np.uint64)
    if not len(h):
        return h
    k = min(n, len(h))
    m = len(h) - k + 1
    out = np.full(m, np.uint64(k))
    for j in range(k):
        out = mixed(out * _MIX + h[j : j + m])
    return np.unique(out)


def minhashes(s: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minwise tokens, 32 bits of each."""
    out = np.full(TREES * DEPTH, np.uint64(2**64 - 1))
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096]
        v = part[None, :] * _SEEDS[0][:, None] + _SEEDS[1][:, None]
        v ^= v >> np.uint64(32)
        v *= _SEEDS[1][:, None]
        out = np.minimum(out, v.min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


def screen_tokens(percent: int) -> int:
    """How many of the sketch's two-bit tokens may differ: a link's differ with
    chance (1 - s) * 3 / 4 at most."""
    p, k = (1 - percent / 100) * 0.75, TREES * DEPTH
    return int(k * p + SCREEN * (k * p * (1 - p)) ** 0.5)


def row_keys() -> list:
    """What a row is known by: hashes of its doc_id and of its text."""
    return [F.xxhash64("doc_id").alias("doc_key"), F.xxhash64("text").alias("text_key")]


def signed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, doc_key, text_key, n_shingles, the class key (128 bits of the set), the
    signature and its sketch (two bits of each minhash, in two numbers)."""

    @frugal
    def run(rows):
        import pyarrow as pa
        import xxhash

        words = Words()
        for batch in rows:
            sizes, keys, signatures, ones, twos = [], [], [], [], []
            for text in text_bytes(batch.column("text")):
                s = shingles(text, n, words)
                sizes.append(len(s))
                if len(s):
                    m = minhashes(s)
                    keys.append(xxhash.xxh128_digest(s.tobytes()))
                    signatures.append(m.tobytes())
                    ones.append(int.from_bytes(np.packbits(m & 1).tobytes(), "little", signed=True))
                    twos.append(int.from_bytes(np.packbits(m >> 1 & 1).tobytes(), "little", signed=True))
                else:
                    for column in (keys, signatures, ones, twos):
                        column.append(None)
            found = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "doc_key", "text_key")), *found], ["doc_id", "doc_key", "text_key", "n_shingles", "class_key", "signature", "one", "two"])

    return docs.select("doc_id", *row_keys(), "text").mapInArrow(run, "doc_id long, doc_key long, text_key long, n_shingles long, class_key binary, signature binary, one long, two long")


def nodes(reps: DataFrame, work: Workspace, small: int = SMALL) -> DataFrame:
    """tree, path, members, hub (the node's least member), rep, n_shingles, one, two: the
    final nodes with two members at least.  ``reps``: rep, n_shingles, one, two,
    signature.  A row carries its tree's tokens; what comparing needs is added last."""
    tokens = lambda t: F.substring("signature", 1 + 4 * t * DEPTH, 4 * DEPTH)
    trees = F.explode(F.array(*(F.struct(F.lit(t).cast("byte").alias("tree"), tokens(t).alias("tokens")) for t in range(TREES))))
    token = lambda d: F.substring("tokens", 1 + 4 * d, 4)
    going = reps.select("rep", trees.alias("p")).select("rep", "p.tree", "p.tokens")
    going = going.withColumn("path", F.xxhash64("tree", token(0)))
    final, rows = None, TREES * reps.count()
    for depth in range(DEPTH):
        sized = going.groupBy("tree", "path").agg(F.count("*").alias("members"), F.min("rep").alias("hub")).where("members > 1")
        joined = work.table(keyed_join(going, sized, ["tree", "path"], "members", rows), f"depth{depth}")
        last = depth == DEPTH - 1
        done = joined if last else joined.where(F.col("members") <= small)
        done = done.drop("tokens")
        final = done if final is None else final.unionByName(done)
        large = joined.where(F.col("members") > small)
        if last or large.isEmpty():
            break
        going = large.select("rep", "tree", "tokens", F.xxhash64("tree", "path", token(depth + 1)).alias("path"))
    return final.join(reps.select("rep", "n_shingles", "one", "two"), "rep")


class Forest(dict):
    """Union-find; ``join`` tells whether two nodes were apart."""

    def find(self, x: int) -> int:
        root = x
        while (up := self.get(root, root)) != root:
            root = up
        while x != root:
            self[x], x = root, self.get(x, x)
        return root

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self[max(x, y)] = min(x, y)
        return x != y

    def stars(self) -> list[tuple[int, int]]:
        """Each node with its root: short paths make few rounds of what follows."""
        return [(x, self.find(x)) for x in list(self)]


def _edges(pairs: list[tuple[int, int]]):
    import pyarrow as pa

    u, v = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _groups(rows, keys: tuple[str, ...]):
    """The rows of each group of a partition sorted by ``keys``, as Arrow tables."""
    import pyarrow as pa

    kept = None
    for batch in rows:
        table = pa.Table.from_batches([batch])
        if kept is not None:
            table = pa.concat_tables([kept, table])
        if not table.num_rows:
            continue
        columns = [table.column(k).to_numpy() for k in keys]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist()]
        for low, high in zip(cuts, cuts[1:]):
            yield table.slice(low, high - low)
        kept = table.slice(cuts[-1]).combine_chunks()
    if kept is not None:
        yield kept


def candidate_groups(final: DataFrame, percent: int, work: Workspace, block: int = BLOCK) -> DataFrame:
    """node, component: the groups of documents that may be linked."""
    most = screen_tokens(percent)

    @frugal
    def run(rows):
        forest = Forest()
        kept = None
        for batch in rows:
            cols = [batch.column(c).to_numpy() for c in ("tree", "path", "rep", "n_shingles", "one", "two")]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols)]
            if not len(cols[0]):
                continue
            # Rows of the last node wait for the next batch.
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            kept = [c[last] for c in cols]
            compared([c[~last] for c in cols], forest)
        if kept is not None:
            compared(kept, forest)
        yield _edges(forest.stars())

    def compared(cols, forest):
        tree, path, rep, size, one, two = cols
        one, two = one.view(np.uint64), two.view(np.uint64)
        at = np.arange(len(rep))
        for step in range(1, len(rep)):  # every row with the step-th after it in its node
            at = at[at < len(rep) - step]
            at = at[(path[at] == path[at + step]) & (tree[at] == tree[at + step])]
            if not len(at):
                break
            to = at + step
            ok = 100 * np.minimum(size[at], size[to]) >= percent * np.maximum(size[at], size[to])
            ok &= np.bitwise_count((one[at] ^ one[to]) | (two[at] ^ two[to])) <= most
            for a, b in zip(rep[at[ok]].tolist(), rep[to[ok]].tolist()):
                forest.join(a, b)

    dealt = final.where(F.col("members") <= block).select("tree", "path", "rep", "n_shingles", "one", "two")
    screened = dealt.repartition("tree", "path").sortWithinPartitions("tree", "path").mapInArrow(run, "u long, v long")
    edges = screened.unionByName(final.where(F.col("members") > block).select(F.col("hub").alias("u"), F.col("rep").alias("v")))
    return connected_components(edges, work, "candidates")


def verified(tasks: DataFrame, n: int, percent: int) -> DataFrame:
    """u, v: links on full sets that join components.  ``tasks``: grp, low, high
    (these three name a task), side, rep, component, n_shingles, text; side -1 is
    compared with all of its task, side 0 with side 1."""

    @frugal
    def run(rows):
        words, forest = Words(), Forest()
        for table in _groups(rows, ("grp", "low", "high")):
            rep, comp, side = (table.column(c).to_numpy() for c in ("rep", "component", "side"))
            sets = [shingles(t, n, words) for t in text_bytes(table.column("text").combine_chunks())]
            size = np.array([len(s) for s in sets])
            for r, c in zip(rep.tolist(), comp.tolist()):
                forest.join(r, c)
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            _, flat = np.unique(np.concatenate(sets), return_inverse=True)
            seen = np.zeros(len(flat), bool)
            for i in range(len(rep)):
                if side[i] == 1:
                    continue
                others = np.arange(i + 1, len(rep)) if side[i] == -1 else np.flatnonzero(side == 1)
                others = others[(100 * np.minimum(size[i], size[others]) >= percent * np.maximum(size[i], size[others])) & (rep[others] != rep[i])]
                root = forest.find(int(rep[i]))
                if not len(others) or all(forest.find(r) == root for r in rep[others].tolist()):
                    continue
                own = flat[starts[i] : starts[i] + size[i]]
                seen[own] = True
                both = np.add.reduceat(seen[flat], starts)[others]
                seen[own] = False
                good = others[100 * both >= percent * (size[i] + size[others] - both)]
                for r in rep[good].tolist():
                    forest.join(int(rep[i]), r)
        yield _edges(forest.stars())

    columns = tasks.select("grp", "low", "high", "side", "rep", "component", "text")
    return columns.repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high").mapInArrow(run, "u long, v long")


def grouped(spark: SparkSession, docs: DataFrame, n: int, percent: int, work: Workspace, small: int = SMALL, block: int = BLOCK, by_doc_id: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The signed rows of ``docs`` (doc_id, text), the classes with their group
    (class_key, grp), and the doc_ids with several texts, if there are any.  With
    ``by_doc_id`` the texts of one doc_id are one group."""
    rows = work.table(signed(docs, n), "signed")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "doc_key", "text_key")
    classes = rows.where("class_key is not null").groupBy("class_key").agg(F.min(order).alias("least"), *(F.first(c).alias(c) for c in ("n_shingles", "one", "two", "signature")))
    reps = classes.select("class_key", F.monotonically_increasing_id().alias("rep"), "least.doc_key", "least.text_key", "n_shingles", "one", "two", "signature")
    reps = work.table(reps, "classes")
    final = work.table(nodes(reps.select("rep", "n_shingles", "one", "two", "signature"), work, small), "nodes")
    work.drop(*(f"depth{d}" for d in range(DEPTH)))
    groups = candidate_groups(final, percent, work, block).toDF("rep", "grp")
    weighed = work.table(groups.join(reps.select("rep", "doc_key", "text_key", "n_shingles"), "rep"), "weighed")
    work.drop("nodes")
    sized = weighed.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("weight"))
    blocks = F.ceil(F.greatest(F.col("m") / block, F.col("weight") / BLOCK_SHINGLES)).cast("int")
    members = keyed_join(weighed, sized.select("grp", blocks.alias("blocks"), "m"), ["grp"], "m", weighed.count()).drop("m", "n_shingles")
    members = work.table(members.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "groups")

    # Texts of the groups' representatives only: others are sifted out where they are read.
    by = ["doc_key", "text_key"]
    near, _ = sift(docs.select(*row_keys(), "text"), members, by, work, "member-bits")
    found = near.join(members, by)
    found = found.groupBy("doc_key", "text_key", "rep", "grp", "blocks", "own").agg(F.first("text").alias("text"))
    texts = work.table(found.drop("doc_key", "text_key"), "texts")
    work.drop("weighed")

    own, last = F.col("own"), F.col("blocks") - 1
    cell = lambda low, high, side: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), side.cast("int").alias("side"))
    zero, one, alone = F.lit(0), F.lit(1), F.lit(-1)
    cells = F.when(own == 0, F.transform(F.sequence(zero, last), lambda j: cell(zero, j, F.when(j == 0, alone).otherwise(zero)))).otherwise(F.array(cell(own, own, alone), cell(zero, own, one)))
    tasks = texts.select("grp", F.explode(cells).alias("cell"), "rep", F.col("rep").alias("component"), "text").select("grp", "cell.*", "rep", "component", "text")
    links = work.table(verified(tasks, n, percent), "links1")
    parts = work.table(connected_components(links, work, "cc1").toDF("rep", "component"), "parts1")

    # What a large group's main component doesn't hold yet meets the whole group.
    named = members.where("blocks > 1").join(parts, "rep", "left").select("rep", "blocks", "own", F.coalesce("component", "rep").alias("component"), "grp")
    counted = named.groupBy("grp", "component").agg(F.count("*").alias("k"))
    main = counted.groupBy("grp").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("m"), F.max("k").alias("k"))
    main = work.table(main.where("m > k").select("grp", "main", F.ceil((F.col("m") - F.col("k")) / block).cast("int").alias("rests"), "m"), "main")
    again = not main.isEmpty()
    if again:
        rest = keyed_join(named, main, ["grp"], "m", members.where("blocks > 1").count())
        as_one = F.transform(F.sequence(zero, F.col("rests") - 1), lambda i: cell(i, own, one))
        as_rest = F.transform(F.sequence(zero, last), lambda j: cell(F.pmod(F.xxhash64(F.col("rep"), zero), F.col("rests")), j, zero))
        cells = F.when(F.col("component") == F.col("main"), as_one).otherwise(F.concat(as_one, as_rest))
        tasks = rest.select("rep", "component", cells.alias("cells")).join(texts.where("blocks > 1").select("rep", "grp", "text"), "rep")
        tasks = tasks.select("grp", F.explode("cells").alias("cell"), "rep", "component", "text").select("grp", "cell.*", "rep", "component", "text")
        links = links.unionByName(work.table(verified(tasks, n, percent), "links2"))
    several = work.table(_several(rows), "several") if by_doc_id else None
    if several is not None and several.isEmpty():
        several = None
    if several is not None:
        # The classes of one doc_id are linked to the first of them.
        of = rows.select("doc_key", "class_key").join(several.select("doc_key", "least"), "doc_key").where("class_key <> least").distinct()
        number = reps.select("class_key", "rep")
        links = links.unionByName(of.join(number.toDF("least", "u"), "least").join(number.toDF("class_key", "v"), "class_key").select("u", "v"))
    if again or several is not None:
        parts = work.table(connected_components(links, work, "cc2").toDF("rep", "component"), "parts2")
    work.drop("texts", "groups")
    return rows, reps.select("class_key", "rep").join(parts, "rep", "left").select("class_key", F.coalesce("component", "rep").alias("grp")), several


def _several(rows: DataFrame) -> DataFrame:
    """doc_key, least: doc_ids with different texts, and the least of their classes."""
    by_doc = rows.where("doc_id is not null").groupBy("doc_key").agg(F.min("class_key").alias("least"), F.max("class_key").alias("most"), F.count_if(F.col("class_key").isNull()).alias("blank"))
    return by_doc.where("least <> most or blank > 0 and least is not null").select("doc_key", "least")


def near_duplicates(spark: SparkSession, docs: DataFrame, n: int, percent: int, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    work = Workspace(spark, "neardup")
    rows, classes, several = grouped(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, percent, work, small, block)
    deal = F.xxhash64("class_key").alias("deal")
    # One row for each class: a class with very many rows is summed up first.
    firsts = rows.where("class_key is not null").groupBy("class_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    firsts = work.table(firsts.join(classes, "class_key").withColumn("deal", deal), "firsts")
    least = firsts.groupBy("grp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("m"))
    labels = keyed_join(firsts.select("class_key", "deal", "rows", "grp"), least, ["grp"], "m", firsts.count()).select("class_key", "deal", "rows", "component_id")
    columns = ["doc_id", "doc_key", "n_shingles", "component_id"]
    out = keyed_join(rows.select("doc_id", "doc_key", "n_shingles", "class_key", deal), labels, ["class_key", "deal"], "rows", rows.count()).select(columns)
    out = out.unionByName(rows.where("class_key is null").withColumn("component_id", F.lit(None).cast("long")).select(columns))
    if several is not None:
        through = several.join(labels.select(F.col("class_key").alias("least"), F.col("component_id").alias("through")), "least").select("doc_key", "through")
        out = out.join(through, "doc_key", "left").withColumn("component_id", F.when(F.col("doc_id").isNull(), F.col("component_id")).otherwise(F.coalesce("through", "component_id")))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def chosen_path_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read_table(spark, sf_dir, "documents"), 3, 85)


def keep_one_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (five words, 0.8) one row stays."""
    work = Workspace(spark, "neardup-stage")
    rows, classes, _ = grouped(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), 5, 80, work, by_doc_id=False)
    deal = F.xxhash64("class_key").alias("deal")
    # One entry for each different row, with how often it's there.
    entry = F.struct(F.col("doc_id").isNull(), "doc_id", "doc_key", "text_key")
    pairs = rows.where("class_key is not null").groupBy("class_key", "doc_id", "doc_key", "text_key").agg(F.count("*").alias("copies"))
    firsts = pairs.groupBy("class_key").agg(F.min(entry).alias("first"), F.count("*").alias("entries")).join(classes, "class_key")
    firsts = work.table(firsts, "firsts")
    best = firsts.groupBy("grp").agg(F.min("first").alias("best"), F.count("*").alias("m"))
    chosen = keyed_join(firsts.select("class_key", "entries", "grp"), best, ["grp"], "m", firsts.count()).select("class_key", deal, "entries", F.col("best.doc_key").alias("best_doc"), F.col("best.text_key").alias("best_text"))
    judged = keyed_join(pairs.select("doc_key", "text_key", "copies", "class_key", deal), chosen, ["class_key", "deal"], "entries", rows.count())
    same = (F.col("doc_key") == F.col("best_doc")) & (F.col("text_key") == F.col("best_text"))
    gone = work.table(judged.where(~same).select("doc_key", "text_key"), "gone")
    repeated = work.table(judged.where(same & (F.col("copies") > 1)).select("doc_key", "text_key"), "repeated")
    by = [fresh(docs, "doc_key"), fresh(docs, "text_key")]
    keyed = docs.withColumns(dict(zip(by, (F.xxhash64(F.col("doc_id").cast("long")), F.xxhash64("text")))))
    # Only rows that may have to go move; the others stay where they are read.
    gone, repeated = gone.toDF(*by), repeated.toDF(*by)
    near, left = sift(keyed, gone, by, work, "gone-bits")
    left = left.unionByName(near.join(gone, by, "left_anti"))
    if not repeated.isEmpty():
        near, others = sift(left, repeated, by, work, "repeated-bits")
        left = others.unionByName(near.join(repeated, by, "left_anti")).unionByName(near.join(repeated, by, "left_semi").dropDuplicates(by))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
