"""Jaccard join of word shingles through a MinHash LSH forest.

Each text gets TREES labels of DEPTH minimum hashes. A tree of the forest is the prefix trie of its labels, kept as their
sorted order: texts below one node stand together. The prefix that must match is shortened from DEPTH for each text until
the pairs that a text of so many shingles can be part of meet in some tree with the target probability; short texts can only
be similar to few others and keep long prefixes. What meets below a node is joined to one text of it, first within each task
and then over all tasks, so a node of any size reaches the shuffle with one text a task; texts so connected form a candidate
cluster, and within each cluster all pairs are verified with their exact shingle sets, in blocks of bounded size, so that a
cluster of any size is spread over tasks and no pair is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, common, graph

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, TARGET = 24, 8, 0.9999
#: Texts of a cluster that are compared with one another, or with as many others, in one place.
CLUSTER_BLOCK = 128
#: Texts that a task links among themselves at once.
MEET_TEXTS = 1 << 15
U64 = np.uint64


#: Shingles of a text up to which its own prefix is looked for; from there on similarities come close to any threshold.
SHORT = 200


def matched_depth(similarity: float, trees: int = TREES, depth: int = DEPTH, target: float = TARGET) -> int:
    """The longest prefix at which a pair of that similarity meets in one of the trees with the target probability."""
    for k in range(depth, 0, -1):
        if 1 - (1 - similarity**k) ** trees >= target:
            return k
    return 1


def least_similarity(n: int, threshold: float) -> float:
    """The smallest similarity from threshold on that a set of n can have with another set."""
    found = 1.0
    for m in range(math.ceil(threshold * n - 1e-9), math.floor(n / threshold + 1e-9) + 1):
        i = math.ceil(threshold * (n + m) / (1 + threshold) - 1e-9)  # the least common part
        if i <= min(n, m):
            found = min(found, i / (n + m - i))
    return found


def depths(threshold: float = THRESHOLD) -> np.ndarray:
    """By number of shingles, SHORT at most, the prefix that must match."""
    return np.array([DEPTH] + [matched_depth(least_similarity(n, threshold)) for n in range(1, SHORT)] + [matched_depth(threshold)], np.int32)


def labels(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """uid, depth, labels of each row of docs (uid, text) with words: the prefix that must match, and for each tree DEPTH minimum
    hashes of 16 bits, the first ones in the first of two numbers."""
    draw = np.random.default_rng(20240229)
    n = TREES * DEPTH
    factors, offsets_ = draw.integers(1, 1 << 32, n, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, n, np.uint32)
    prefix = depths(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in arrays.blocks(batch.column(1)):
                sh, at = arrays.shingles(*arrays.word_hashes(data, offsets), k)
                full = np.flatnonzero(np.diff(at) > 0)
                if not len(full):
                    continue
                out = np.zeros((len(full), TREES, 2), U64)
                low = (sh >> U64(32)).astype(np.uint32)
                # the same order every time: each function is a bijection of 32 bits
                for p in range(n):
                    h = low * factors[p] + offsets_[p]
                    h ^= h >> np.uint32(15)
                    h *= np.uint32(0x2C1B3C6D)
                    h ^= h >> np.uint32(12)
                    least = np.minimum.reduceat(h, at[full]) * np.uint32(0x9E3779B1)  # least hashes are small: spread them
                    tree, level = divmod(p, DEPTH)
                    out[:, tree, level // 4] |= (least >> np.uint32(16)).astype(U64) << U64(48 - 16 * (level % 4))
                own = _distinct(sh, at, full)
                ends = pa.array(np.arange(len(full) + 1) * 2 * TREES, pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(out.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].take(pa.array(full)), pa.array(prefix[own]), lists], ["uid", "depth", "labels"])

    return common.pick(docs, "uid", "text").mapInArrow(run, "uid long, depth int, labels array<long>")


def _distinct(sh: np.ndarray, at: np.ndarray, full: np.ndarray) -> np.ndarray:
    """The number of distinct shingles of each of these texts, or SHORT for texts of more shingles than that."""
    sizes = np.diff(at)[full]
    out, short = np.full(len(full), SHORT), np.flatnonzero(sizes < SHORT)
    of, values = np.repeat(np.arange(len(short)), sizes[short]), sh[arrays._ranges(at[:-1][full][short], sizes[short])]
    by = np.lexsort((values, of))
    of, values = of[by], values[by]
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (values[1:] != values[:-1]))) if len(of) else np.empty(0, bool)
    out[short] = np.bincount(of[new], minlength=len(short))
    return out


def _meet(uid: np.ndarray, depth: np.ndarray, tree: np.ndarray, high: np.ndarray, low: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, which): rows in order of tree and label are linked with the first row of their trie node, at each depth at which both
    may match; which of them are the first row of some node."""
    n = len(uid)
    heads, a, b = np.zeros(n, bool), [], []
    for k in range(least, DEPTH + 1):
        shift = U64(16 * (DEPTH - k))
        upper, lower = (high, low >> shift) if k > 4 else (high >> U64(16 * (4 - k)), low[:0])
        new = np.ones(n, bool)
        new[1:] = (tree[1:] != tree[:-1]) | (upper[1:] != upper[:-1])
        if len(lower):
            new[1:] |= lower[1:] != lower[:-1]
        own = np.flatnonzero(depth <= k)
        node = np.cumsum(new)[own]
        first = np.concatenate(([True], node[1:] != node[:-1])) if len(own) else np.empty(0, bool)
        head = own[np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))] if len(own) else own
        heads[own[first]] = True
        apart = uid[head] != uid[own]
        a.append(uid[head][apart])
        b.append(uid[own][apart])
    a, b = np.concatenate(a), np.concatenate(b)
    both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
    return both[0], both[1], heads


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root), sorted: each node of the edges (a, b) and the smallest one that it is connected with."""
    node, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root, x, y = np.arange(len(node)), at[: len(a)], at[len(a) :]
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            return node, node[root]
        least = np.minimum(rx, ry)
        np.minimum.at(root, rx, least)
        np.minimum.at(root, ry, least)
        while (root != root[root]).any():
            root = root[root]


def _node(tree: np.ndarray, high: np.ndarray, low: np.ndarray, least: int) -> np.ndarray:
    """A hash of a label's prefix of the least depth, and of its tree."""
    high, low = (high, low >> U64(16 * (DEPTH - least))) if least > 4 else (high >> U64(16 * (4 - least)), low * U64(0))
    return arrays.mixed(arrays.mixed(high + tree.astype(U64) * U64(0x9E3779B97F4A7C15)) + low)


def met(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """a, b: uids of docs (uid, text) that are connected like those that meet below a node of the forest: within a task each with
    the smallest one that it is connected with there, which then stands for it, so that a text is in few rows."""
    least = int(depths(threshold).min())

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            uid, depth, label = (np.concatenate(x) for x in zip(*rows, strict=True))
            tree = np.tile(np.arange(TREES), len(uid))
            uid, depth, high, low = np.repeat(uid, TREES), np.repeat(depth, TREES), label[:, 0], label[:, 1]
            by = np.lexsort((uid, low, high, tree))
            uid, depth, tree, high, low = (x[by] for x in (uid, depth, tree, high, low))
            a, b, heads = _meet(uid, depth, tree, high, low, least)
            uid, depth, tree, high, low = (x[heads] for x in (uid, depth, tree, high, low))
            node, root = _stars(a, b)
            if len(node):
                at = np.minimum(np.searchsorted(node, uid), len(node) - 1)
                uid = np.where(node[at] == uid, root[at], uid)
            a, b = root[root != node], node[root != node]
            zeros = np.zeros(len(a), np.int64)
            node = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(_node(tree, high, low, least).view(np.int64))])
            columns = [(zeros, tree), (zeros, high.view(np.int64)), (zeros, low.view(np.int64)), (zeros, depth), (a, uid), (b, np.zeros(len(uid), np.int64))]
            return pa.RecordBatch.from_arrays([node, *(pa.array(np.concatenate(c).astype(np.int64)) for c in columns)], ["node", "tree", "high", "low", "depth", "a", "b"])

        for batch in batches:
            rows.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy().view(U64).reshape(-1, 2)))
            if sum(len(r[0]) for r in rows) >= MEET_TEXTS:
                yield flush()
                rows.clear()
        if rows:
            yield flush()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # rows of the last node, which may go on

        def pairs(node, tree, high, low, depth, uid) -> pa.RecordBatch:
            a, b, _ = _meet(uid, depth, tree, high.view(U64), low.view(U64), least)
            found, root = _stars(a, b)
            return pa.RecordBatch.from_arrays([pa.array(root[root != found]), pa.array(found[root != found])], ["a", "b"])

        for batch in batches:
            given = batch.column(0).null_count  # links that were made within a task come first
            if given:
                yield pa.RecordBatch.from_arrays([batch.column(5)[:given], batch.column(6)[:given]], ["a", "b"])
            now = [batch.column(c)[given:].to_numpy(zero_copy_only=False).astype(np.int64) for c in range(6)]
            now = [np.concatenate(x) for x in zip(left, now, strict=True)] if left is not None else now
            if not len(now[0]):
                continue
            end = int(np.searchsorted(now[0], now[0][-1]))  # nodes are in order
            yield pairs(*(x[:end] for x in now))
            left = [x[end:] for x in now]
        if left is not None:
            yield pairs(*left)

    near = labels(docs, threshold, k).mapInArrow(within, "node long, tree long, high long, low long, depth long, a long, b long")
    near = near.repartition(F.coalesce("node", F.xxhash64("a", "b"))).sortWithinPartitions(F.col("node").asc_nulls_first(), "tree", "high", "low")
    return near.mapInArrow(across, "a long, b long").distinct()


def shingle_sets(docs: DataFrame, *keep: str, k: int = SHINGLE) -> DataFrame:
    """keep and shingles: the set of a text's shingle hashes, sorted, as 8 bytes each."""
    docs = common.pick(docs, *keep, "text")
    at_text = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in arrays.blocks(batch.column(at_text)):
                sh, at = arrays.shingles(*arrays.word_hashes(data, offsets), k)
                sets = [np.unique(sh[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in range(at_text)), pa.array(sets, pa.binary())], [*keep, "shingles"])

    return docs.mapInArrow(run, docs.select(*keep).schema.add("shingles", "binary"))


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets of different places have that similarity."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float32)
    both, of = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    _, place, count = np.unique(both, return_inverse=True, return_counts=True)
    shared = count > 1
    column = (np.cumsum(shared) - 1)[place]
    keep = shared[place]
    column, of = column[keep], of[keep]
    by = np.argsort(column, kind="stable")
    column, of = column[by], of[by]
    common_ = np.zeros((n, n), np.float32)
    width = 4096
    for a in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(column, [a, a + width])
        part = np.zeros((n, width), np.float32)
        part[of[i:j], column[i:j] - a] = 1
        common_ += part @ part.T
    # intersection / union >= threshold, in whole numbers but for the threshold itself
    found = common_ >= threshold * (sizes[:, None] + sizes[None, :] - common_) - 1e-3
    np.fill_diagonal(found, False)
    return found


def _verify(threshold: float):
    """Rows sorted by block pair -> (key, links, root): how many rows of other texts each is linked with, and a text that
    it is connected with. Of two blocks, only the smallest of those that are connected within a block has a root."""

    def roots(found: np.ndarray) -> np.ndarray:
        root = np.arange(len(found))
        while True:
            new = np.minimum(root, np.where(found, root[None, :], len(found)).min(1))
            new = new[new]
            if (new == root).all():
                return root
            root = new

    def one(rows: list[tuple]) -> list[tuple]:
        rows.sort(key=lambda r: (r[1], r[0]))
        side = np.array([r[1] for r in rows])
        split = int(np.searchsorted(side, 1))
        across = rows[0][4]
        if across and (split == 0 or split == len(rows)) or len(rows) < 2:
            return []
        sets = [np.frombuffer(r[3], U64) for r in rows]
        weights, here = np.array([r[2] for r in rows]), np.arange(len(rows))
        found = similar(sets, threshold)
        if not across:
            links, root = found @ weights, roots(found)
            return [(r[0], int(n), rows[t][0]) for r, n, t in zip(rows, links, root, strict=True) if n]
        inner = found & ((here < split)[:, None] == (here < split)[None, :])
        root = roots(found)
        stands = (roots(inner) == here) & (root != here)
        links = (found & ~inner) @ weights
        return [(r[0], int(n), rows[t][0] if s else None) for r, n, t, s in zip(rows, links, root, stands, strict=True) if n or s]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            out = []
            cluster, low, high, key, side, n, sets = (batch.column(c).to_pylist() for c in range(7))
            for c, i, j, k, s, w, x in zip(cluster, low, high, key, side, n, sets, strict=True):
                if (c, i, j) != now:
                    out += one(rows) if rows else []
                    now, rows = (c, i, j), []
                rows.append((k, s, w, x, i != j))
            if out:
                yield _edges(out)
        if rows and (out := one(rows)):
            yield _edges(out)

    return run


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["key", "links", "root"])


def join(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """key, doc_id, n_copies, links, root for each distinct text of docs (doc_id, text) that has words.

    key: md5 of the text; doc_id: the smallest of its rows; n_copies: its rows; links: rows of other texts whose shingle
    sets have the similarity; root: the smallest key of the texts that it is connected with through links.
    """
    docs = common.pick(docs, "doc_id", "text").withColumn("key", F.md5(F.coalesce("text", F.lit(""))))
    classes = docs.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"), F.first(F.coalesce("text", F.lit("")).rlike(common.ANY_WORD)).alias("worded"))
    classes = common.store(classes.where("worded").select("key", "doc_id", "n_copies", F.xxhash64("key").alias("uid")), "classes")
    clusters = graph.components(met(docs.select(F.xxhash64("key").alias("uid"), "text"), threshold, k))
    clusters = clusters.union(clusters.select("root", "root").distinct()).toDF("uid", "cluster")
    clusters = common.store(clusters.join(classes, "uid").drop("uid"), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / CLUSTER_BLOCK).cast("int").alias("blocks"))
    own = clusters.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    # by text and id: copies of one text have ids of their own, and no task gets all of them
    of = docs.toDF("_id", "text", "_key")
    texts = of.join(own, (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("doc_id"))).dropDuplicates(["key"])
    sets = shingle_sets(texts, "key", "cluster", "blocks", "block", "n_copies", k=k)
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "key", (F.col("block") > F.col("other")).cast("int").alias("side"), "n_copies", "shingles")
    pairs = pairs.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
    linked = common.store(pairs.mapInArrow(_verify(threshold), "key string, links long, root string"), "links")
    roots = graph.components(linked.where("root IS NOT NULL").select(F.col("root").alias("a"), F.col("key").alias("b")))
    total = linked.groupBy("key").agg(F.sum("links").alias("links")).join(roots.withColumnRenamed("node", "key"), "key", "left")
    out = classes.drop("uid").join(total, "key", "left")
    return out.select("key", "doc_id", "n_copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "key").alias("root"))


def groups(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """key, class_id (smallest doc_id of the group of near copies), keep_key (a text of that document), n_links, n_copies.

    n_links: rows linked with a row of that text, its own copies included. Texts without words (null, empty, signs only)
    are linked with nothing and are missing here.
    """
    joined = common.store(join(docs, threshold, k), "joined")
    first = joined.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    out = joined.join(first, "root")
    return out.select("key", F.col("first.doc_id").alias("class_id"), F.col("first.key").alias("keep_key"), (F.col("links") + F.col("n_copies") - 1).alias("n_links"), "n_copies")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its class (the smallest id of its group of near copies), the number of its links, and of rows of its
    text. Null, empty and wordless texts are linked with nothing; repeated rows are copies; a null id is named last."""
    docs = common.pick(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    own = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    out = own.join(groups(docs), "key", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, of its smallest doc_id; texts without words all stay."""
    own = common.packed(docs, "doc_id", "text").select("doc", "doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    first = groups(docs).where("key = keep_key").select("keep_key", "class_id")
    kept = own.join(first, (F.col("key") == F.col("keep_key")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).dropDuplicates(["key"])
    loose = own.where(~F.coalesce(F.col("text").rlike(common.ANY_WORD), F.lit(False)))
    return common.unpacked(loose.select("doc").union(kept.select("doc")), docs.columns)
