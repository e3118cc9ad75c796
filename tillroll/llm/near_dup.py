"""N-gram Jaccard join by a MinHash LSH forest.

1. Each text gives its set of ``words``-word shingles, a key of its whole word
   sequence and ``TREES`` labels of ``LABEL`` min-hashes.  Texts with equal word
   sequences are one class, represented by its smallest ``doc_id``.
2. The forest is one globally sorted table of (tree, label, representative): its
   sorted prefix tries.  Every task reads its sorted run and proposes links:
   from a row to the smallest id under the same prefix (the hub), and to its
   neighbour, which shares the longest prefix.  Prefixes are shortened from the
   whole label to ``depth``, the longest at which a pair at the threshold
   meets in some tree with the target recall.  Rows at the ends of runs are
   linked across tasks, so a prefix shared by very many rows needs no task of its own.
3. Proposed links are verified exactly on the shingle sets.  Hub links come
   first; the links of longer prefixes and of neighbours are verified where
   they join classes still apart.
4. Where a shortest prefix of three rows or more still holds several classes,
   every pair of its members in different classes is compared, in salted blocks.
5. A document's class is its connected component over verified links.
6. In each component every two representatives are compared, in salted blocks
   that add up each one's links and store no pairs.

Results per row: class_id (smallest ``doc_id`` of the component) and n_links
(the other representatives that reach the threshold with its own).

Defined cases: texts without words match nothing, not even each other; 1 to
``words`` - 1 words are one shingle; each row is a document, rows with one
``doc_id`` are one node (linked if any of their texts is); rows with a null
``doc_id`` come back with the class of their exact copies that have an id, else
a null class, and no links of their own.  Other columns are not read by
``classes`` and pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh128_digest

from tillroll.llm.common import chunks, hash_words, shingle_set, stored, words

WORDS, THRESHOLD, RECALL, TREES, LABEL = 5, 0.8, 0.999, 20, 8
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 1_000_000


def depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, label: int = LABEL) -> int:
    """The longest prefix at which a pair at the threshold shares one in some tree with the target recall."""
    for d in range(label, 1, -1):
        if 1 - (1 - threshold ** d) ** trees >= recall:
            return d
    return 1


def _permutations(trees: int, label: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    a = rng.integers(0, 2 ** 32, trees * label, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a[:, None], rng.integers(0, 2 ** 32, trees * label, dtype=np.uint64).astype(np.uint32)[:, None]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 2048) -> bytes:
    """Min-hash under each permutation, 16 bits each, big-endian so that byte order is label order."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), block):
        low = np.minimum(low, (a * x[None, at:at + block] + b).min(axis=1))
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2").tobytes()


def signatures(docs: DataFrame, n: int, trees: int, label: int) -> DataFrame:
    """doc_id, key (of the word sequence), sig (null: a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(trees, label)
        for cols, texts in chunks(batches):
            keys, sigs = [], []
            for text in texts:
                ws = words(text)
                keys.append(xxh128_digest(" ".join(ws)))
                sigs.append(signature(shingle_set(hash_words(ws), n), a, b) if ws else None)
            yield pa.RecordBatch.from_arrays([pa.array(cols["doc_id"], pa.int64()), pa.array(keys, pa.binary()),
                                              pa.array(sigs, pa.binary())], ["doc_id", "key", "sig"])

    return docs.mapInArrow(run, "doc_id long, key binary, sig binary")


def _paths(reps: DataFrame, trees: int, label: int, depth: int) -> DataFrame:
    """path (tree and the first ``depth`` min-hashes of its label), rep."""
    return reps.select("rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring(
        F.col("sig"), t * (2 * label) + 1, F.lit(2 * depth)))).alias("tree", "label")).select(
        F.concat(F.unhex(F.lpad(F.hex("tree"), 4, "0")), "label").alias("path"), "rep")


def _proposals(reps: DataFrame, trees: int, label: int, least: int) -> DataFrame:
    """a > b, hub: proposed links of the sorted tries; hub marks those of the shortest prefix."""
    width = 2 * label
    rows = _paths(reps, trees, label, label)
    spark = reps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tries = rows.repartitionByRange(parts, "path", "rep").sortWithinPartitions("path", "rep")

    def links(paths: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        new = np.ones(len(ids), bool)
        for d in range(label, least - 1, -1):
            new[1:] = (paths[1:, :2 + 2 * d] != paths[:-1, :2 + 2 * d]).any(axis=1)
            run = np.cumsum(new) - 1
            hub = np.minimum.reduceat(ids, np.flatnonzero(new))[run]
            yield ids, hub, d == least
        near = ~new[1:]
        yield ids[1:][near], ids[:-1][near], False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        ids = table.column(1).to_numpy()
        paths = np.frombuffer(b"".join(table.column(0).to_pylist()), np.uint8).reshape(len(ids), 2 + width)
        cut = 2 + 2 * least
        ends = []  # first and last row of the task, with the hub of its prefix
        for at in (0, len(ids) - 1):
            same = (paths[:, :cut] == paths[at, :cut]).all(axis=1)
            ends.append((bytes(paths[at, :cut]), int(ids[at]), int(ids[same].min())))
        found: dict[bool, list[np.ndarray]] = {True: [], False: []}
        for x, y, is_hub in links(paths, ids):
            pair = np.stack([np.maximum(x, y), np.minimum(x, y)], 1)[x != y]
            found[is_hub].append(pair)
        hubs = np.unique(np.concatenate(found[True]), axis=0)
        others = np.unique(np.concatenate(found[False]), axis=0) if found[False] else np.empty((0, 2), np.int64)
        part, n = TaskContext.get().partitionId(), len(hubs) + len(others)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([hubs[:, 0], others[:, 0], [e[1] for e in ends]]).astype(np.int64)),
            pa.array(np.concatenate([hubs[:, 1], others[:, 1], [e[2] for e in ends]]).astype(np.int64)),
            pa.array([True] * len(hubs) + [False] * (len(others) + 2), pa.bool_()),
            pa.array([None] * n + [e[0] for e in ends], pa.binary()),
            pa.array([None] * n + [part * 2, part * 2 + 1], pa.int64())], ["a", "b", "hub", "path", "end"])

    raw = stored(tries.mapInArrow(run, "a long, b long, hub boolean, path binary, end long"), "tries")
    # Two rows per task: prefixes that go on in the next task with rows are linked here.
    ends = raw.where("end is not null").orderBy("end").collect()
    across = {(max(x, y), min(x, y)) for r, s in zip(ends[1::2], ends[2::2]) if r["path"] == s["path"]
              for x in (r["a"], r["b"]) for y in (s["a"], s["b"]) if x != y}
    inside = raw.where("end is null").select("a", "b", "hub")
    joined = spark.createDataFrame([(x, y, True) for x, y in sorted(across)], "a long, b long, hub boolean")
    return inside.unionByName(joined).groupBy("a", "b").agg(F.max("hub").alias("hub"))


def _verified(links: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The links whose shingle sets reach the threshold."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    share = round(threshold * 1000)  # in integers, so that a pair exactly at the threshold counts
    both = F.size(F.array_intersect("sa", "sb"))  # both / (a + b - both) >= share, with the costly size once
    return (links.join(one, "a").join(two, "b").where(both * (1000 + share) >= share * (F.size("sa") + F.size("sb")))
            .select("a", "b").distinct())


def _blocks(members: DataFrame, shingles: DataFrame, rows: int, most: int) -> DataFrame:
    """Members (group, rep, ...) with their sets, dealt so that every two of a group meet under one (group, i, j).

    A group is cut into blocks of about ``rows`` members and ``most`` shingles; ``own`` is the member's block, i <= j.
    """
    sized = members.join(shingles.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("n").alias("n")), "rep")
    cuts = sized.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum("n") / most)).cast("int").alias("k"))
    dealt = sized.join(cuts, "group").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        *members.columns, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return pairs.join(shingles.select(F.col("doc_id").alias("rep"), "shingles"), "rep")


def _meetings(block: pa.Table, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of block i, the rows of block j whose sets reach the threshold with it; of rows sorted by (own, rep)."""
    share = round(threshold * 1000)
    sets = pa.concat_arrays(block.column("shingles").chunks)
    sizes = np.diff(sets.offsets.to_numpy())
    at = np.concatenate([[0], np.cumsum(sizes)])
    values, codes = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    own = block.column("own").to_numpy()
    left, right = int((own == own[0]).sum()), int(np.searchsorted(own, own[-1]))
    if block.column("i")[0] != block.column("j")[0] and own[0] == own[-1]:
        return  # one of the two blocks is empty
    theirs, starts, mark = codes[at[right]:], at[right:-1] - at[right], np.zeros(len(values), np.int32)
    for x in range(left):
        mine = codes[at[x]:at[x + 1]]
        mark[mine] = 1
        both = np.add.reduceat(mark[theirs], starts, dtype=np.int64)
        mark[mine] = 0
        yield x, right + np.flatnonzero(both * (1000 + share) >= share * (sizes[x] + sizes[right:]))


def _across(members: DataFrame, shingles: DataFrame, threshold: float, rows: int, most: int) -> DataFrame:
    """a > b: verified links between the classes (comp) that meet in a group, one at least for each two classes linked there."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("own", "ascending"), ("rep", "ascending")])
        ids, comps = block.column("rep").to_numpy(), block.column("comp").to_numpy()
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        for x, near in _meetings(block, threshold) if len(np.unique(comps)) > 1 else ():
            near = near[comps[near] != comps[x]]
            for y in near[np.unique(comps[near], return_index=True)[1]]:
                seen.setdefault((min(comps[x], comps[y]), max(comps[x], comps[y])), (max(ids[x], ids[y]), min(ids[x], ids[y])))
        found = np.array(list(seen.values()), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return _blocks(members, shingles, rows, most).groupBy("group", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _degrees(members: DataFrame, shingles: DataFrame, threshold: float, rows: int, most: int) -> DataFrame:
    """rep, n_links: in how many other members of its group it has a partner that reaches the threshold."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("own", "ascending"), ("rep", "ascending")])
        ids, inside = block.column("rep").to_numpy(), block.column("i")[0] == block.column("j")[0]
        count: dict[int, int] = {}
        one, theirs = None, set()  # rows of one id are one node, so its partners are counted once
        for x, near in _meetings(block, threshold):
            if ids[x] != one:
                one, theirs = ids[x], set()
            new = set(ids[near].tolist()) - theirs - {int(one)}
            theirs |= new
            for y in [] if inside else new:
                count[y] = count.get(y, 0) + 1
            count[int(one)] = count.get(int(one), 0) + len(new)
        return pa.table({"rep": pa.array(count.keys(), pa.int64()), "n_links": pa.array(count.values(), pa.int64())})

    met = _blocks(members, shingles, rows, most).groupBy("group", "i", "j").applyInArrow(run, "rep long, n_links long")
    return met.groupBy(F.col("rep").alias("id")).agg(F.sum("n_links").alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """id, comp (smallest id of its connected component) for the ends of ``edges`` (a, b; a stored table).

    Smallest labels travel along edges and to the label's own label, until a
    round changes nothing.  Each round is written to the shared folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = stored(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("comp")), "components")
    while True:
        near = both.join(state.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = state.join(near, "id").select("id", "comp", F.least("comp", "near").alias("to"))
        root = state.select(F.col("id").alias("to"), F.col("comp").alias("root"))
        state = stored(step.join(root, "to").select("id", F.least("to", "root").alias("comp"), (
            F.least("to", "root") < F.col("comp")).alias("moved")), "components")
        moved = state.where("moved").limit(1).count()
        state = state.drop("moved")
        if not moved:
            return state


def classes(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES,
            label: int = LABEL, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, class_id, n_links per row of ``docs``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(signatures(own, n, trees, label), "signatures")
    every = signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    reps = every.where(F.col("sig").isNotNull() & F.col("rep").isNotNull())
    least = depth(threshold, recall, trees, label)
    proposed = stored(_proposals(reps.select("rep", "sig"), trees, label, least), "links")
    ends = proposed.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, texts in chunks(batches):
            found = [shingle_set(hash_words(words(t)), n).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(cols["doc_id"], pa.int64()), pa.array(found, pa.list_(pa.int64())),
                                              pa.array(map(len, found), pa.int64())], ["doc_id", "shingles", "n"])

    # The ids grow with the documents, so both sides are dealt by id at every size.
    shingles = stored(own.join(ends.hint("merge"), "doc_id", "left_semi").mapInArrow(sets, "doc_id long, shingles array<long>, n long").where("n > 0"), "shingles")
    links = stored(_verified(proposed.where("hub"), shingles, threshold), "verified")
    found = components(links)
    far = (proposed.where("not hub")
           .join(found.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a", "left")
           .join(found.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b", "left")
           .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
    more = stored(_verified(far, shingles, threshold), "verified")
    links = stored(links.unionByName(more), "verified")
    found = components(links)
    # Two members alone have met through the hub; among three and more, those of different classes may not have.
    held = _paths(reps.join(ends.withColumnRenamed("doc_id", "rep"), "rep", "left_semi"), trees, label, least).distinct().join(
        found.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("path").alias("group"), "rep", F.coalesce("comp", "rep").alias("comp"))
    mixed = held.groupBy("group").agg(F.count("*").alias("rows"), F.min("comp").alias("low"), F.max("comp").alias("high")).where(
        "rows > 2 and low < high").select("group")
    apart = stored(held.join(mixed, "group"), "apart")
    more = stored(_across(apart, shingles, threshold, block_rows, block_shingles), "verified")
    links = stored(links.unionByName(more), "verified")
    found = components(links)
    degree = _degrees(found.select(F.col("comp").alias("group"), F.col("id").alias("rep")), shingles, threshold, block_rows, block_shingles)
    known = (every.select("key", "rep", F.col("sig").isNull().alias("blank")).join(found.withColumnRenamed("id", "rep"), "rep", "left")
             .join(degree.withColumnRenamed("id", "rep"), "rep", "left")
             .select("key", "blank", F.coalesce("comp", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    return signed.select("doc_id", "key").join(known, "key").select(
        "doc_id", F.when(F.col("blank"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("blank") | F.col("doc_id").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"))


def keep_one(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest ``doc_id``; rows without an id stay."""
    gone = classes(docs, n, threshold).where(F.col("class_id") != F.col("doc_id")).select("doc_id").distinct()
    kept = docs.where(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
