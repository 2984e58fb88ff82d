"""Repeated passages: runs of 13 words that an earlier document holds as well are removed.

A window is hashed word by word; its minimiser is the smallest hash of its runs of
three words, and depends on nothing else, so that equal windows have equal minimisers
wherever they stand. Consecutive windows of one minimiser travel as one packed string
to the bucket of that minimiser; strings of one task and bucket are compressed together.
There they are cut again, sorted by a 128-bit fingerprint and document, and the windows
that are not in the first document that holds them are hits.

A minimiser that many strings share would fill one bucket. A first pass finds those
that hold more than a quarter of a partition, at most four times as many as there are
partitions; their windows travel one by one as fingerprints, where
the first holder is a minimum that is combined before the shuffle, and hits are what a
join on fingerprint and document together leaves over: no key of it is a common one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowmill.llm import common

WIDTH, GRAM = 13, 3
_CHUNK = 1 << 20
#: Bytes of packed strings that a task holds before it sends them.
_HELD = 48 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(1213)
_BYTES = _RNG.integers(1, 2**63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


class _Powers:
    """Powers of the base and of its inverse, modulo 2**64, as far as they are asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self._table(b, 2 * n) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)


_POWERS = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cut(raw: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, [np.empty(0, np.uint64)] * kinds
    up, down = _POWERS.get(len(raw))
    hashes = []
    for table in _BYTES[:kinds]:
        term = table[raw] * up
        term[~inside] = 0
        hashes.append(_mix(np.add.reduceat(term, starts) * down[starts] + (ends - starts).astype(np.uint64)))
    return starts, ends, hashes


def _words(raw: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts, ends and hashes of the words of a text; a long one is cut at white space, so memory follows its words."""
    if len(raw) <= _CHUNK:
        return _cut(raw, kinds)
    out, at = [], 0
    while at < len(raw):
        end = at + _CHUNK
        while end < len(raw) and not (stop := np.flatnonzero(_SPACE[raw[end : end + _CHUNK]])).size:
            end += _CHUNK
        if end < len(raw):
            end += int(stop[0])
        s, e, h = _cut(raw[at:end], kinds)
        out.append((s + at, e + at, h))
        at = end
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), [np.concatenate([x[2][k] for x in out]) for k in range(kinds)]


def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of so many words; words must be at least as many."""
    up, down = _POWERS.get(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1])])
    return _mix((sums[size:] - sums[:-size]) * down[: len(sums) - size])


def minimisers(hashes: np.ndarray, width: int) -> np.ndarray:
    """The smallest hash of the runs of GRAM words in each window."""
    least, span, wanted = _runs(hashes, min(GRAM, width)), 1, width - min(GRAM, width) + 1
    while 2 * span <= wanted:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    rest = wanted - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    for k, text in enumerate(batch["text"].cast(pa.binary())):
        if data := text.as_py():
            yield k, data + b" "


def _strings(data: bytes, width: int, kinds: int = 1) -> tuple | None:
    """Word places and hashes, the minimisers of the windows, and where consecutive ones change."""
    starts, ends, hashes = _words(np.frombuffer(data, np.uint8), kinds)
    if len(starts) < width:
        return None
    least = minimisers(hashes[0], width)
    return starts, ends, hashes, least, np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))


def _repeated_keys(width: int):
    """text to the minimisers that several strings of a batch have, and the number of strings: key, strings.

    The last row of a batch, of a null key, has the number of all its strings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s[3][s[4]] for _, data in _texts(batch) if (s := _strings(data, width))]
            if found:
                key, often = np.unique(np.concatenate(found).view(np.int64), return_counts=True)
                keys = pa.array([*key[often > 1].tolist(), None], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.append(often[often > 1], often.sum()))], ["key", "strings"])

    return run


_META = ["<i8", "<i4", "<i4", "<i4"]  # of a packed string: document, key of its text, first word, windows
_ZSTD = "zstd"


def _blob(meta: list[np.ndarray], strings: list[bytes]) -> bytes:
    """Packed strings of one bucket in one compressed piece."""
    first, *rest = meta
    parts = [np.diff(first, prepend=0), *rest]
    data = b"".join([np.array([len(first)], "<i8").tobytes(), *(x.astype(t).tobytes() for x, t in zip(parts, _META, strict=True)), *strings])
    return len(data).to_bytes(8, "little") + pa.compress(data, _ZSTD, asbytes=True)


def _unpacked(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    data = pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), _ZSTD, asbytes=True)
    n, at, meta = int.from_bytes(data[:8], "little"), 8, []
    for t in _META:
        meta.append(np.frombuffer(data, t, n, at))
        at += n * np.dtype(t).itemsize
    return [np.cumsum(meta[0]), *meta[1:]], data[at:]


def _packed(width: int, hot: np.ndarray, buckets: int):
    """doc_id, text_key, text to packed strings of minimisers that are not hot, by bucket: bucket, blob."""

    def flushed(out: list[list]) -> pa.RecordBatch:
        bucket, *meta = (np.concatenate(x) for x in out[:5])
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        strings, ends = out[5], np.append(cuts[1:], len(order))
        blobs = [_blob([x[own] for x in meta], [strings[k] for k in own.tolist()]) for own in (order[a:b] for a, b in zip(cuts, ends))]
        return pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], [], []]
        held = 0
        for batch in batches:
            docs, keys = batch["doc_id"].to_numpy(), batch["text_key"].to_numpy()
            for k, data in _texts(batch):
                if not (s := _strings(data, width)):
                    continue
                starts, ends, _, least, first = s
                after = np.append(first[1:], len(least))
                cold = ~_among(least[first].view(np.int64), hot)
                first, after = first[cold], after[cold]
                from_, to = starts[first], ends[after + width - 2] + 1  # the white space behind the last word goes along
                for column, values in zip(out, [(least[first] % np.uint64(buckets)).astype(np.int64), np.full(len(first), docs[k]), np.full(len(first), keys[k]), first, after - first], strict=False):
                    column.append(values)
                out[5] += [data[a:b] for a, b in zip(from_.tolist(), to.tolist())]
                held += int((to - from_).sum())
                if held >= _HELD:
                    yield flushed(out)
                    out, held = [[], [], [], [], [], []], 0
        if out[5]:
            yield flushed(out)

    return run


def _among(key: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(key), bool)
    return ordered[np.minimum(np.searchsorted(ordered, key), len(ordered) - 1)] == key


def _hot_windows(width: int, hot: np.ndarray):
    """doc_id, text_key, text to the windows of hot minimisers: high, low, doc_id, text_key, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out = ["high", "low", "doc_id", "text_key", "start"], []
        for batch in batches:
            docs, keys = batch["doc_id"].to_numpy(), batch["text_key"].to_numpy()
            for k, data in _texts(batch):
                if not (s := _strings(data, width, 2)):
                    continue
                at = np.flatnonzero(_among(s[3].view(np.int64), hot))
                if len(at):
                    high, low = (_runs(h, width)[at].view(np.int64) for h in s[2])
                    out.append([high, low, np.full(len(at), docs[k]), np.full(len(at), keys[k]), at.astype(np.int32)])
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)

    return run


def _count(width: int):
    """bucket, blob, sorted by bucket, to hits: doc_id, text_key, start, windows (consecutive ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs = None, []
        for bucket, blob in common.rows(batches):
            if bucket != at and blobs:
                yield from _bucket(blobs, width)
                blobs = []
            at = bucket
            blobs.append(blob)
        if blobs:
            yield from _bucket(blobs, width)

    return run


def _bucket(blobs: list[bytes], width: int) -> Iterator[pa.RecordBatch]:
    parts = [_unpacked(b) for b in blobs]
    docs, text_keys, begin, windows = (np.concatenate(x) for x in zip(*(meta for meta, _ in parts), strict=True))
    raw = np.frombuffer(b"".join(data for _, data in parts), np.uint8)
    _, _, hashes = _words(raw, 2)
    first = np.concatenate([[0], np.cumsum(windows + width - 1)])  # the first word of each string
    row = np.repeat(np.arange(len(windows)), windows)
    place = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)  # within its string
    high, low = (_runs(h, width)[first[row] + place] for h in hashes)
    doc = docs[row]
    order = np.argsort(high)
    same = high[order][1:] == high[order][:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]  # what occurs once is no hit
    order = order[np.lexsort((doc[order], low[order], high[order]))]
    begins = np.concatenate([[True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])])[: len(order)]
    least = doc[order][np.flatnonzero(begins)][np.cumsum(begins) - 1]
    hit = np.zeros(len(row), bool)
    hit[order[doc[order] > least]] = True
    if hit.any():
        at = np.flatnonzero(hit)
        fresh = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])])
        runs = np.diff(np.append(np.flatnonzero(fresh), len(at)))
        at = at[fresh]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[at]), pa.array(text_keys[row[at]]), pa.array((begin[row[at]] + place[at]).astype(np.int32)), pa.array(runs.astype(np.int32))],
            ["doc_id", "text_key", "start", "windows"],
        )


def _kept(width: int):
    """text and hits to n_words, n_removed, the digest of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest = [], [], []
            for text, hits in zip(batch["text"].cast(pa.binary()), batch["hits"], strict=True):
                words = (text.as_py() or b"").split()  # at ASCII white space
                n_words.append(len(words))
                if hits.is_valid:
                    start, runs = (hits.values.field(c).to_numpy() for c in ("start", "windows"))  # a set, in any order
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + runs + width - 1, -1)
                    free = np.cumsum(change[:-1]) == 0
                    words = [w for w, f in zip(words, free.tolist()) if f]
                n_removed.append(n_words[-1] - len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _hot(texts: DataFrame, width: int) -> np.ndarray:
    """Minimisers that hold more than one in four times as many strings as there are partitions; there are no more than that.

    What is single in a batch is not counted, so at most one string for each batch is missed.
    """
    most = 4 * common.partitions(texts.sparkSession)
    counted = texts.select("text").mapInArrow(_repeated_keys(width), "key long, strings long").groupBy("key").agg(F.sum("strings").alias("strings"))
    counted = common.materialize(counted, "repeated-minimisers")
    every = counted.filter("key is null").first()
    found = counted.filter(F.col("key").isNotNull() & (F.col("strings") * most > (every.strings if every else 0))).select("key").collect()
    return np.sort(np.array([r.key for r in found], np.int64))


def repeated_windows(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (hash of the text), start, windows: runs of windows that a document of a smaller id holds as well."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text_col).alias("text_key"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    n = common.partitions(docs.sparkSession)
    hot = _hot(texts, width)
    packed = texts.mapInArrow(_packed(width, hot, 4 * n), "bucket int, blob binary")
    hits = packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(width), "doc_id long, text_key int, start int, windows int")
    if not len(hot):
        return hits
    single = texts.mapInArrow(_hot_windows(width, hot), "high long, low long, doc_id long, text_key int, start int")
    single = common.materialize(single, "hot-windows")
    least = single.groupBy("high", "low").agg(F.min("doc_id").alias("doc_id"))
    later = single.join(least, ["high", "low", "doc_id"], "left_anti")
    return hits.unionByName(later.select("doc_id", "text_key", "start", F.lit(1).alias("windows")))


def substring_dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    Words stand between ASCII white space and are taken as they are. A null or empty
    text has no words; one of fewer than ``width`` words keeps them all. Rows of a null
    id are neither earlier nor later than any and keep all. Rows of one id remove
    nothing from each other; each is judged by its own text. Other columns are ignored;
    an empty table gives no row. Windows are compared by two 64-bit hashes.
    """
    found = common.materialize(repeated_windows(docs, width, id_col, text_col), "repeated-windows")
    hits = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "windows")).alias("hits"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text_col).alias("text_key"), F.col(text_col).alias("text"))
    joined = own.join(hits, ["doc_id", "text_key"], "left").select("doc_id", "text", "hits")
    return joined.mapInArrow(_kept(width), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: runs of 13 words over all documents."""
    return substring_dedup(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s : s + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM d WHERE len(ws) >= 13)),
hit AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY win) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT doc_id, list(pos) AS gone FROM (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS pos FROM hit) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM d),
left_over AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.pos) AS kept FROM word w ANTI JOIN (SELECT doc_id, unnest(gone) AS pos FROM gone) g USING (doc_id, pos) GROUP BY w.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
