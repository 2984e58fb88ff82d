"""N-gram Jaccard join over prefix trees of globally ordered n-gram sets.

The order of n-grams is that of their 64-bit hashes, the same in every task and run.

1. Texts with equal sets form a class, named by a 128-bit digest of the set.
2. Candidates: two sets at Jaccard 0.9 or more whose smaller one has at most u
   n-grams differ in at most u // 9 of them. Cut the global order into more than
   that many stretches: at least one of them then holds the same n-grams in both.
   Sets share a key for such a stretch. Sizes are in levels, and a set gives keys
   for its own level and the one below, so that every pair that can link meets in
   the level of its smaller set. Sets that share keys of a level are connected to
   a cluster of that level only, so that no chain runs through all sizes.
3. A cluster is dealt to pairs of bounded parts, and each pair of parts is joined
   by a prefix tree: ordered sets are stored in a compressed trie; a probe walks
   it once, sharing the overlap of common prefixes, and leaves a subtree when the
   n-grams missing so far, on either side, exceed what the remaining lengths allow,
   or when all below it is already in the probe's component.
4. Verified links are merged to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowmill.llm import common
from windowmill.llm.components import components
from windowmill.llm.shingles import mix, shingle_set

SPARE = 3
PART_NGRAMS = 300_000
#: Sets that a task remembers as done.
SEEN_SETS = 200_000
#: Ids of candidates are broadcast up to so many (about 40 bytes each), and shuffled with the texts beyond.
BROADCAST_IDS = 200_000
#: The low bits of a key are its level.
LEVEL_BITS = 12


class Threshold:
    """Jaccard at least num / den in whole numbers, num / den >= 1/2."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.tops = [num // (den - num)]  # two different sets need a smaller one of this size
        while self.tops[-1] < 1 << 33:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * den // num))

    def overlap(self, a: int, b: int) -> int:
        """The least intersection of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def differ(self, top: int) -> int:
        """The largest symmetric difference of linked sets, the smaller of at most top."""
        return top * (self.den - self.num) // self.num


def _sets(size: int, limit: Threshold):
    """doc_id, text_key, n_shingles, mark of the set, node (its first 64 bits) and, once for each set and task, its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, seen = np.empty(0, np.uint64), set()
        for batch in batches:
            n, mark, keys = [], [], []
            for text in batch["text"].to_pylist():
                grams = shingle_set(text, size)
                n.append(len(grams))
                mark.append(blake2b(grams.tobytes(), digest_size=16).digest())
                keys.append(none if mark[-1] in seen else range_keys(grams, limit))
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(mark[-1])
            node = np.frombuffer(b"".join(mark), "<i8")[::2]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([none, *keys]).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.array(n, pa.int64()), pa.array(mark, pa.binary()), pa.array(node), listed], ["doc_id", "text_key", "n_shingles", "mark", "node", "keys"]
            )

    return run


def range_keys(grams: np.ndarray, limit: Threshold) -> np.ndarray:
    """Keys of the stretches of a sorted set, for its level and the one below."""
    if len(grams) < limit.tops[0]:
        return np.empty(0, np.uint64)
    own = int(np.searchsorted(limit.tops, len(grams)))
    mixed, out = mix(grams), []
    for c in {own, max(own - 1, 0)}:
        k = limit.differ(limit.tops[c]) + 1 + SPARE
        segment = (grams >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(segment, prepend=np.uint64(k)))
        present = segment[cuts]
        sums = np.add.reduceat(mixed, cuts)
        if k - len(present) > SPARE:  # then an equal range may be an empty one
            missing = np.setdiff1d(np.arange(k, dtype=np.uint64), present)
            present, sums = np.concatenate([present, missing]), np.concatenate([sums, np.zeros(len(missing), np.uint64)])
        key = mix(sums ^ mix(present + (np.uint64(c + 1) << np.uint64(40))))
        out.append(key << np.uint64(LEVEL_BITS) | np.uint64(c))
    return np.concatenate(out)


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, node) to edges to the first of each run.

    A key may go on in the next partition: the first and the last run of each
    give their hub with the key, to be tied by key afterwards.
    """
    last_key = last_hub = None
    first = True
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        key, doc = batch["key"].to_numpy(), batch["node"].to_numpy()
        if not len(key):
            continue
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        hub = doc[start].copy()
        if key[0] == last_key:
            hub[0] = last_hub
        if first:
            yield pa.RecordBatch.from_pydict({"key": key[:1], "u": hub[:1], "v": hub[:1]})
            first = False
        each = np.repeat(hub, np.diff(np.append(start, len(key))))
        linked = np.flatnonzero(each != doc)
        if len(linked):
            pairs = np.unique(np.stack([doc[linked], each[linked]], axis=1), axis=0)
            fresh = [p for p in map(tuple, pairs.tolist()) if p not in seen]
            if len(seen) > 200_000:
                seen.clear()
            seen.update(fresh)
            if fresh:
                u, v = zip(*fresh, strict=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["key", "u", "v"])
        last_key, last_hub = key[-1], hub[-1]
    if last_key is not None:
        yield pa.RecordBatch.from_pydict({"key": pa.array([last_key], pa.int64()), "u": pa.array([last_hub], pa.int64()), "v": pa.array([last_hub], pa.int64())})


class Node:
    __slots__ = ("edge", "after", "ends", "least", "most", "item", "mixed")

    def __init__(self, edge: np.ndarray, item: int, size: int):
        self.edge, self.after, self.ends = edge, {}, []
        self.least = self.most = size
        self.item, self.mixed = item, False


class PrefixTree:
    """A compressed trie of sets of ranks, with components of what it found."""

    def __init__(self, limit: Threshold, universe: int):
        self.limit, self.root = limit, Node(np.empty(0, np.int64), -1, 0)
        self.held = np.zeros(universe + 1, bool)
        self.parent: list[int] = []
        self.sizes: list[int] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def add(self, ranks: np.ndarray) -> int:
        """Register a set without storing it."""
        self.parent.append(len(self.parent))
        self.sizes.append(len(ranks))
        return len(self.parent) - 1

    def store(self, item: int, ranks: np.ndarray) -> None:
        node, at, size = self.root, 0, len(ranks)
        if not node.after:
            node.least, node.most, node.item = size, size, item
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            if not node.mixed and self.find(node.item) != self.find(item):
                node.mixed = True
            if at == size:
                node.ends.append(item)
                return
            child = node.after.get(int(ranks[at]))
            if child is None:
                node.after[int(ranks[at])] = new = Node(ranks[at:], item, size)
                new.ends.append(item)
                return
            n = min(len(child.edge), size - at)
            differs = child.edge[:n] != ranks[at : at + n]
            same = int(differs.argmax()) if differs.any() else n
            if same < len(child.edge):  # split the edge
                upper = Node(child.edge[:same], child.item, child.least)
                upper.most, upper.mixed = child.most, child.mixed
                upper.after[int(child.edge[same])] = child
                child.edge = child.edge[same:]
                node.after[int(ranks[at])] = upper
                child = upper
            node, at = child, at + same

    def probe(self, item: int, ranks: np.ndarray) -> None:
        """Unite the item with every stored set that it links with."""
        if not self.root.after and not self.root.ends:
            return
        held, find, limit, size = self.held, self.find, self.limit, len(ranks)
        held[ranks] = True
        low, high = -(-size * limit.num // limit.den), size * limit.den // limit.num
        stack = [(self.root, 0, 0)]
        while stack:
            node, depth, shared = stack.pop()
            if node.most < low or node.least > high or (not node.mixed and find(node.item) == find(item)):
                continue
            edge = node.edge
            if len(edge):
                depth += len(edge)
                shared += int(held[edge].sum())
                top = min(node.most, high)
                passed = int(np.searchsorted(ranks, edge[-1], "right"))
                if depth - shared > top - limit.overlap(size, top) or passed - shared > size - limit.overlap(size, max(node.least, low)):
                    continue
            for other in node.ends:
                if shared >= limit.overlap(size, self.sizes[other]):
                    a, b = find(other), find(item)
                    if a != b:
                        self.parent[b] = a
            stack.extend((child, depth, shared) for child in node.after.values())
        held[ranks] = False


def _join(size: int, limit: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lo, hi, own, doc, raw in common.grouped(batches, 3):
            if len(doc) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in raw]
            lengths = np.array([len(s) for s in sets])
            grams, rank = np.unique(np.concatenate(sets), return_inverse=True)
            ranked = np.split(rank, np.cumsum(lengths)[:-1])  # each ascends, as its set does
            tree = PrefixTree(limit, len(grams))
            inner = lo[0] == hi[0]
            order = sorted(range(len(doc)), key=lambda i: (own[i], doc[i]))
            for i in order:
                item = tree.add(ranked[i])
                if inner or own[i] == hi[0]:
                    tree.probe(item, ranked[i])
                if inner or own[i] == lo[0]:
                    tree.store(item, ranked[i])
            tied = [(doc[i], doc[order[root]]) for k, i in enumerate(order) if (root := tree.find(k)) != k]
            if tied:
                u, v = zip(*tied, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    return run


def _raw_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [shingle_set(t, size).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([blake2b(x, digest_size=16).digest() for x in raw], pa.binary()), pa.array(raw, pa.binary())], ["mark", "grams"])

    return run


def ngram_components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, text_key, group_key.

    Words stand between ASCII white space, A-Z lower-cased; the set of a text is
    its distinct shingles of ``size`` words, of all its words if it has fewer. Two
    texts link when den * intersection >= num * union. A null or empty text, or one
    of white space, has an empty set and links with nothing. Rows of a null id
    link with nothing either. Where an id is repeated, each of its rows links by its
    own text, and ``text_key`` (xxhash64 of the text) tells them apart; a row's
    component_id is the smallest id of any row that it reaches. ``group_key`` is the
    component's own, also where two share their smallest id; it is NULL where nothing
    can link. Other columns are ignored.

    Keys are given once for each set in a task, so that a group of copies that
    holds much of the table costs as much as one text. The sets of candidates alone
    are shuffled a second time, in blocks.
    """
    limit = Threshold(num, den)
    n = common.partitions(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    marked = common.materialize(own.mapInArrow(_sets(size, limit), "doc_id long, text_key long, n_shingles long, mark binary, node long, keys array<long>"), "ngram-sets")
    full = marked.filter("n_shingles > 0 and doc_id is not null")
    classes = common.materialize(full.groupBy("mark").agg(F.min("doc_id").alias("rep"), F.min("node").alias("node"), F.min("n_shingles").alias("n")), "ngram-classes")

    vertex = lambda level: F.xxhash64(F.col("node"), level.cast("int"))
    keys = marked.select(F.explode("keys").alias("key"), "node").select("key", vertex(F.col("key").bitwiseAND((1 << LEVEL_BITS) - 1)).alias("node"))
    ordered = keys.repartitionByRange(n, "key", "node").sortWithinPartitions("key", "node")
    hubs = common.materialize(ordered.mapInArrow(_hubs, "key long, u long, v long"), "ngram-hubs")
    cut = hubs.filter("key is not null")
    over = cut.join(cut.groupBy("key").agg(F.min("u").alias("hub")), "key").select("u", F.col("hub").alias("v"))
    edges = hubs.filter("key is null").select("u", "v").unionByName(over)
    cluster = components(edges, "u", "v").select(F.col("id").alias("vertex"), F.col("component_id").alias("cluster"))

    tops = F.array([F.lit(t) for t in limit.tops])
    level = F.size(F.filter(tops, lambda t: t < F.col("n")))
    levels = classes.withColumn("level", F.explode(F.array_distinct(F.array(level, F.greatest(level - 1, F.lit(0))))))
    gathered = common.materialize(levels.select("mark", "rep", "n", vertex(F.col("level")).alias("vertex")).join(cluster, "vertex").drop("vertex"), "ngram-clusters")
    dealt = common.blocks(gathered.drop("rep"), ["cluster"], "mark", F.col("n"), PART_NGRAMS)
    wanted = common.broadcast_if_small(gathered.select(F.col("rep").alias("doc_id")).distinct(), BROADCAST_IDS)
    sets = own.join(wanted, "doc_id", "left_semi").select("text").mapInArrow(_raw_sets(size), "mark binary, grams binary").dropDuplicates(["mark"])
    by = ["cluster", "lo", "hi"]
    joined = dealt.select(*by, "own", "mark").join(sets, "mark").select(*by, "own", "mark", "grams")
    links = joined.repartition(n, *by).sortWithinPartitions(*by).mapInArrow(_join(size, limit), "u binary, v binary")
    merged = components(links, "u", "v").select(F.col("id").alias("mark"), F.col("component_id").alias("root"))

    linked = common.materialize(classes.join(merged, "mark").select("mark", "root", "rep"), "ngram-linked")
    lowest = linked.groupBy("root").agg(F.min("rep").alias("lowest"))
    member = classes.select("mark", "rep").join(linked.join(lowest, "root").select("mark", "root", "lowest"), "mark", "left")
    member = member.select("mark", F.coalesce("lowest", "rep").alias("component_id"), F.coalesce("root", "mark").alias("group_key"))
    usable = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("mark"))
    out = marked.withColumn("mark", usable).join(member, "mark", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_key", "group_key")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: components of documents at Jaccard 0.9 of 3-word shingles."""
    return ngram_components(common.table(spark, sf_dir, "documents")).drop("text_key", "group_key")
