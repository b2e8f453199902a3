"""Documents of nearly equal 3-word shingle sets, by trees of OR-combined token bitmaps.

Sets are first told apart by an exact rule: sets of similarity t differ in at most (1 - t) / (1 + t) of their summed sizes, so
if the token space is cut into more parts than that, some parts are equal in both. Documents that share such a part of one
range of sizes may be alike, and what hangs together by shared parts is a cluster. Each cluster gets a signature tree. Its
leaves are sets; nodes above hold the OR of their children's bitmaps, their range of sizes and the most tokens of one set
that its own bitmap doesn't show. Trees are traversed in pairs of nodes: a set shares no more tokens with another one than the bitmaps
have bits in common plus those hidden tokens, so most pairs of nodes are dropped as a whole, as are pairs whose sets are already
known to hang together. Pairs of leaves that remain are compared exactly.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm import hashing
from kerbline.llm.common import discard, find_package, join_checked, map_batches, written
from kerbline.llm.components import components

SHINGLE = 3
THRESHOLD = 90  # per cent
#: The smallest size of a range in per cent of its largest; no more than any threshold, so that alike sets are neighbours.
WIDTH = 80
BITS, FAN = 1024, 8
#: Shingles of a block of a large cluster; a task holds two blocks, or small clusters of that many in all: some 10 MB.
BLOCK = 500_000
_PLACE, _PART, _KEY = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x9E3779B97F4A7C15)

Batches = Iterator[pa.RecordBatch]


def _size_ranges(most: int) -> np.ndarray:
    """First sizes of ranges, up to two behind ``most``: alike sets lie in one range or in neighbouring ones."""
    first = [1]
    while first[-1] <= most:
        first.append(100 * first[-1] // WIDTH + 1)
    return np.array([*first, 100 * first[-1] // WIDTH + 1], np.int64)


def part_keys(items: np.ndarray, threshold: int) -> np.ndarray:
    """Keys of the parts of a set (sorted hashes), for its own range of sizes and the next one if sets of that can be like it: alike sets share a key.

    In a range that allows d differences there are d + 1 + z parts, of which z + 1 at least are equal. A set with no more than
    z empty parts can do without these, others name them as well.
    """
    if not len(items):
        return np.zeros(0, np.int64)
    mixed, ranges, keys = hashing.mix(items ^ _PART), _size_ranges(len(items)), []
    own = int(np.searchsorted(ranges, len(items), "right")) - 1
    for at in (own, own + 1) if 100 * len(items) // threshold >= ranges[own + 1] else (own,):
        last = int(ranges[at + 1]) - 1
        differences = (100 - threshold) * 2 * last // (100 + threshold)
        if not differences:
            continue  # only equal sets are alike
        spare = 1 + differences // 16
        parts = differences + 1 + spare
        part = ((mixed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0])
        held = part[order][heads]
        folded = np.zeros(parts, np.uint64)
        folded[held] = np.bitwise_xor.reduceat(mixed[order], heads)
        if parts - len(held) > spare:
            held = np.arange(parts)
        keys.append(hashing.mix(hashing.mix(folded[held]) ^ (np.uint64(at << 32) + held.astype(np.uint64)) * _KEY))
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``width`` lower-cased words; of the whole text if it has fewer."""
    words = hashing.split_words(column, lower=True)
    hashes, place = hashing.windows(words, width)
    whole, bounds = hashing.whole(words), np.searchsorted(place, words.first)
    return [np.unique(hashes[a:b]) if a < b else whole[i : i + 1][: words.first[i + 1] - words.first[i]] for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def bitmap(items: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, bool)
    bits[(hashing.mix(items ^ _PLACE) >> np.uint64(32)) * np.uint64(BITS) >> np.uint64(32)] = True
    return np.packbits(bits).view(np.uint64)


def _signatures(width: int, threshold: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for start, stop in hashing.slices(batch.column("text")):
                sets = shingle_sets(batch.column("text").slice(start, stop - start), width)
                digests = [pa.array(np.array([hashing.mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)) for salt in (0x2545F491, 0x4F6CDD1D5)]
                keys = pa.array([part_keys(s, threshold) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), pa.array([len(s) for s in sets], pa.int64()), *digests, keys], ["doc_id", "n_shingles", "d1", "d2", "keys"]
                )

    return run


def _sets(width: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for start, stop in hashing.slices(batch.column("text")):
                sets = shingle_sets(batch.column("text").slice(start, stop - start), width)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, stop - start), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n_shingles", "items"])

    return run


def alike(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether sorted sets have that similarity, in per cent."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < threshold * len(b):
        return False
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * shared >= threshold * (len(a) + len(b) - shared)


def _confirmed(threshold: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            keep = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), threshold) for x, y in zip(batch.column("xa"), batch.column("xb"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class Tree:
    """Nodes of a run of sets, level by level from the leaves; children of a node are ``FAN`` neighbours."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        maps = np.stack([bitmap(s) for s in sets])
        sizes = np.array([len(s) for s in sets], np.int64)
        self.levels = [(maps, sizes, sizes, sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, hidden = self.levels[-1]
            heads = np.arange(0, len(low), FAN)
            self.levels.append(
                (np.bitwise_or.reduceat(maps, heads), np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads), np.maximum.reduceat(hidden, heads))
            )

    def children(self, level: int, node: int) -> np.ndarray:
        return np.arange(FAN * node, min(FAN * (node + 1), len(self.levels[level - 1][1])))


def hopeful(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], threshold: int) -> np.ndarray:
    """Of two rows of nodes, which may hold alike sets: by their ranges of sizes and the most tokens that sets of them can share."""
    (maps, low, high, hidden), (other, low2, high2, hidden2) = one, two
    common = np.bitwise_count(maps & other).sum(axis=1, dtype=np.int64)
    shared = np.minimum(np.minimum(high, high2), common + np.minimum(hidden, hidden2))
    near = (100 * high >= threshold * low2) & (100 * high2 >= threshold * low)
    return near & ((100 + threshold) * shared >= threshold * (low + low2))


def linked(sets: list[np.ndarray], labels: np.ndarray, other: tuple[list[np.ndarray], np.ndarray] | None, threshold: int) -> list[tuple[int, int]]:
    """Links (place, place) that join all alike sets of one run, or of one run with another, to what they belong to.

    Sets of one label are known to hang together, so are sets joined on the way; these aren't compared again.
    """
    left = Tree(sets)
    right = left if other is None else Tree(other[0])
    right_sets = sets if other is None else other[0]
    shift = 0 if other is None else len(sets)
    _, root = np.unique(labels if other is None else np.r_[labels, other[1]], return_inverse=True)
    found: list[tuple[int, int]] = []
    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]

    def joined(level: int, node: int, level2: int, node2: int) -> bool:
        a = root[FAN**level * node : min(FAN**level * (node + 1), len(sets))]
        b = root[shift + FAN**level2 * node2 : shift + min(FAN**level2 * (node2 + 1), len(right_sets))]
        return bool((a == a[0]).all() and (b == a[0]).all())

    while stack:
        level, node, level2, node2 = stack.pop()
        if joined(level, node, level2, node2):
            continue
        if not level and not level2:
            if root[node] != root[shift + node2] and alike(sets[node], right_sets[node2], threshold):
                found.append((node, shift + node2))
                root[root == root[shift + node2]] = root[node]
            continue
        one = left.children(level, node) if level >= level2 and level else np.array([node])
        two = right.children(level2, node2) if level2 >= level and level2 else np.array([node2])
        down, down2 = level - (level >= level2 and level > 0), level2 - (level2 >= level and level2 > 0)
        i, j = (x.ravel() for x in np.meshgrid(one, two, indexing="ij"))
        if other is None and level == level2:
            keep = (i < j) if not down else (i <= j)
            i, j = i[keep], j[keep]
        ok = hopeful(tuple(x[i] for x in left.levels[down]), tuple(x[j] for x in right.levels[down2]), threshold)
        # What lies on the diagonal comes first: copies are neighbours there and join.
        pairs = sorted(zip(i[ok].tolist(), j[ok].tolist()), key=lambda p: other is None and p[0] == p[1])
        stack += [(down, a, down2, b) for a, b in pairs]
    return found


def _links(threshold: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        cluster, block, label, ids = (np.asarray(group.column(k)) for k in ("cluster", "block", "label", "id"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("items").combine_chunks()]
        sizes, least = np.array([len(s) for s in sets]), np.array([s[0] for s in sets], np.uint64)
        order = np.lexsort((least, sizes, block, cluster))
        heads = np.flatnonzero(np.r_[True, (np.diff(cluster[order]) != 0) | (np.diff(block[order]) != 0)])
        runs = np.split(order, heads[1:])
        out = []
        several = len(runs) == 2 and cluster[runs[0][0]] == cluster[runs[1][0]]
        for at, own in enumerate(runs):
            mine, ahead = [sets[k] for k in own], None
            if several:
                if at:
                    break
                ahead = ([sets[k] for k in runs[1]], label[runs[1]])
                own = np.r_[own, runs[1]]
            out += [(ids[own[a]], ids[own[b]]) for a, b in linked(mine, label[own[: len(mine)]], ahead, threshold)]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _blocks(leaves: DataFrame) -> DataFrame:
    """``leaves (cluster, id, n_shingles, label)`` with ``block``: runs of sizes of a cluster of some ``BLOCK`` shingles, from 0."""
    counts = leaves.groupBy("cluster", "n_shingles").agg(F.sum("n_shingles").alias("own"))
    upto = F.sum("own").over(Window.partitionBy("cluster").orderBy("n_shingles"))
    counts = counts.withColumn("begin", F.floor((upto - F.col("own")) / BLOCK)).withColumn("spread", F.floor((upto - 1) / BLOCK) - F.col("begin") + 1)
    dealt = leaves.join(counts.drop("own"), ["cluster", "n_shingles"])
    return dealt.withColumn("block", (F.col("begin") + F.pmod(F.xxhash64("id"), F.col("spread"))).cast("long")).drop("begin", "spread")


def _tree_links(leaves: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links within clusters; ``leaves (cluster, id, n_shingles, label)``, ``sets (id, n_shingles, items)``.

    A task gets one pair of blocks of a large cluster, or small clusters whole. Pairs of blocks are dropped if no sizes of
    theirs match or if all their sets have one label.
    """
    dealt = written(_blocks(leaves), "tree-leaves")
    nodes = dealt.groupBy("cluster", "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"), F.min("label").alias("first"), F.max("label").alias("last"), F.sum("n_shingles").alias("total"))
    nodes = written(nodes, "tree-blocks")
    two = nodes.select(F.col("cluster").alias("of"), F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("first").alias("first2"), F.col("last").alias("last2"))
    able = (F.col("cluster") == F.col("of")) & (F.col("block") <= F.col("other")) & (100 * F.col("high") >= threshold * F.col("low2")) & (100 * F.col("high2") >= threshold * F.col("low"))
    able = able & ~((F.col("first") == F.col("last")) & (F.col("first") == F.col("first2")) & (F.col("first2") == F.col("last2")))
    whole = nodes.groupBy("cluster").agg(F.count("*").alias("blocks"), F.sum("total").alias("all")).withColumnRenamed("cluster", "in")
    facts = whole.agg(F.sum(F.when(F.col("blocks") == 1, F.col("all")))).first()[0] or 0
    bins = max(8, facts // BLOCK)
    task = F.when(F.col("blocks") == 1, F.concat(F.lit("bin "), F.pmod(F.xxhash64("cluster"), F.lit(bins)).cast("string"))).otherwise(F.concat_ws(" ", "cluster", "block", "other"))
    tasks = nodes.join(two, able).join(whole, F.col("cluster") == F.col("in")).select("cluster", F.explode(F.array_distinct(F.array("block", "other"))).alias("block"), task.alias("task"))
    rows = dealt.join(tasks, ["cluster", "block"]).join(sets, ["id", "n_shingles"]).select("task", "cluster", "block", "label", "id", "items")
    find_package(leaves.sparkSession)
    return rows.groupBy("task").applyInArrow(_links(threshold), "a long, b long")


def jaccard_components(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, a row for each row of ``docs (doc_id, text, ...)``.

    Documents link if 100 * intersection >= threshold * union of their sets of word runs; ``component_id`` is the smallest
    doc_id reachable, and no link is missed (sets are compared by 64-bit hashes). Documents without words (null or blank
    text) have ``n_shingles`` 0 and stand alone. Rows that repeat a doc_id are one node. A row without doc_id takes no part: its
    ``component_id`` is null. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(map_batches(texts, _signatures(width, threshold), "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>"), "set-signatures")
    able = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal sets are one class that its smallest doc_id stands for.
    classes = written(able.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    classed = signed.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["n_shingles", "d1", "d2"], "left")
    classed = written(classed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "set-classes")
    several = classed.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("doc_id")
    known = written(classed.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "known-links")

    # Classes meet by a hash of theirs, so the keys go out as they were written; copies name the same class.
    kind = F.xxhash64("n_shingles", "d1", "d2")
    named = classes.select(kind.alias("class"), F.col("rep").alias("id"))
    # One shuffle, by bucket, serves the buckets' ends and their members.
    members = able.where("size(keys) > 0").select(kind.alias("class"), F.explode("keys").alias("bucket")).repartition("bucket")
    ends = members.groupBy("bucket").agg(F.min("class").alias("pivot"), F.max("class").alias("high")).where("pivot <> high").select("bucket", "pivot")
    met = written(members.hint("merge").join(ends, "bucket").where("class <> pivot").select("class", "pivot").distinct(), "class-pairs")
    discard(signed)
    met = met.join(named, "class").select("id", F.col("pivot").alias("class")).join(named.withColumnRenamed("id", "pivot"), "class").where("id <> pivot")
    met = written(met.select("id", "pivot").distinct(), "part-pairs")
    discard(classes)
    clusters = written(components(met.select(F.col("id").alias("a"), F.col("pivot").alias("b"))), "clusters").select("id", F.col("label").alias("cluster"))
    # A doc_id with several texts has a set for each.
    grouped = written(clusters.select(F.col("id").alias("doc_id")), "clustered")
    sets = map_batches(join_checked(texts, grouped, "doc_id", "left_semi"), _sets(width), "id long, n_shingles long, items binary")
    sets = written(sets.where("n_shingles > 0").dropDuplicates(), "sets")
    discard(grouped)
    clusters = written(clusters.join(sets.select("id", "n_shingles").distinct(), "id"), "sized-clusters")

    # A cluster that no single task should hold: in each shared part the first member meets the others, which joins copies.
    large = clusters.groupBy("cluster").agg(F.sum("n_shingles").alias("total")).where(F.col("total") > BLOCK).select("cluster")
    hot = written(clusters.join(large, "cluster", "left_semi").select("id").distinct(), "large-clusters")
    links = known
    if not hot.isEmpty():
        a, b = (sets.select(F.col("id").alias(k), F.col("items").alias(f"x{k}")) for k in "ab")
        pairs = met.join(hot, "id", "left_semi").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
        links = known.unionByName(map_batches(pairs.join(a, "a").join(b, "b"), _confirmed(threshold), "a long, b long"))
    links = written(links.distinct(), "first-links")
    labels = written(components(links), "first-labels")
    leaves = clusters.join(labels, "id", "left").select("cluster", "id", "n_shingles", F.coalesce("label", "id").alias("label"))
    leaves = written(leaves, "cluster-leaves")
    open_clusters = leaves.groupBy("cluster").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("cluster")
    found = written(_tree_links(leaves.join(open_clusters, "cluster", "left_semi"), sets, threshold), "tree-links")
    discard(sets)
    groups = written(components(links.unionByName(found)), "set-groups").withColumnRenamed("id", "of")
    out = classed.join(groups, classed["rep"] == groups["of"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
