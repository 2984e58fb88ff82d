"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

1. Items are cut into windows of 13 consecutive words; a shorter item is one
   window. The tokens of a window are its shingles of three words.
2. Shingles are ordered by rarity: a first pass counts how often the documents hold
   each shingle of an item, adding up before the shuffle.
3. A window must be whole in a document to count, so its necessary prefix is its
   single rarest shingle. A second pass joins only prefix shingles, which gives the
   places where a window would have to start.
4. Length and positional bounds drop places where no window fits.
5. The item-sized runs of words at what remains are compared with the windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowmill.llm import common

WINDOW = 13
GRAM = 3
#: A table is broadcast up to so many rows of its own (32 to 300 bytes each), and shuffled beyond.
BROADCAST_ROWS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of ASCII digits, letters (lower-cased) and non-ASCII characters."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _grams(words_: Column, size: int) -> Column:
    """The hash of each run of ``size`` words, by position."""
    last = F.size(words_) - size
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(size), *(F.get(words_, i + k) for k in range(size))))


def windows(benchmark: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, gram (shingle size), window (words): each distinct window of an item."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("words")).filter("item_id is not null and size(words) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - width))
    cut = items.withColumn("at", F.explode(starts)).select("item_id", F.slice("words", F.col("at") + 1, width).alias("window"))
    return cut.distinct().withColumn("gram", F.least(F.lit(GRAM), F.size("window")))


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = 20, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key.

    A document is contaminated if words inside windows make up at least one in
    ``share``. A null or empty text has no words. Items of a null id, or without
    words, match nothing; repeated items count once. Where an id is repeated, each row
    is judged by its own text, and ``text_key`` (xxhash64 of the text) tells them
    apart; a null doc_id has no hits. Other columns are ignored. Either table may be
    empty.
    """
    own = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    row = ["doc_id", "text_key"]
    listed = common.materialize(windows(benchmark, width, item_col, item_text_col), "benchmark-windows")
    cut = common.materialize(listed.select("window", "gram").distinct().withColumn("n", F.size("window")), "benchmark-distinct")
    by_size = F.array([F.struct(F.lit(g).alias("gram"), _grams(F.col("window"), g).alias("hashes")) for g in range(1, GRAM + 1)])
    tokens = cut.select("window", "n", F.posexplode(F.filter(by_size, lambda s: s.gram == F.col("gram"))[0].hashes).alias("offset", "hash"))
    tokens = common.materialize(tokens, "benchmark-tokens")
    sizes = sorted(r.gram for r in cut.select("gram").distinct().collect())  # at most GRAM values

    texts = own.filter("doc_id is not null and text is not null")
    split = texts.select(*row, words(F.col("text")).alias("words")).withColumn("size", F.size("words"))
    hashes = F.concat(*(_grams(F.col("words"), g) for g in sizes)) if sizes else F.array().cast("array<bigint>")
    known = common.materialize(tokens.select("hash").distinct(), "benchmark-known")
    every = split.select(F.explode(hashes).alias("hash"))
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        often = every.join(F.broadcast(known), "hash").groupBy("hash").agg(F.count("*").alias("places"))
    else:  # counted before they are joined, so that a common shingle is one row of each task
        often = every.groupBy("hash").agg(F.count("*").alias("places")).join(known, "hash")
    ranked = tokens.join(common.materialize(often, "benchmark-rarity"), "hash")  # a window of which a shingle is nowhere cannot be whole
    rarest = ranked.groupBy("window", "n").agg(F.count("*").alias("found"), F.min_by(F.struct("hash", "offset"), F.struct("places", "hash", "offset")).alias("t"))
    whole_size = F.col("n") - F.least(F.lit(GRAM), F.col("n")) + 1
    whole_found = rarest.filter(F.col("found") == whole_size)
    prefix = common.materialize(whole_found.select("t.hash", "t.offset", "n", F.least(F.lit(GRAM), F.col("n")).alias("gram")).distinct(), "benchmark-prefix")
    prefix = common.broadcast_if_small(prefix, BROADCAST_ROWS)

    # the size is made before, so that no place carries the words
    places = split.select(*row, "size", F.posexplode(hashes).alias("at", "hash")).join(prefix, "hash")
    at, runs = F.col("at"), F.lit(0)
    for g in sizes:  # the arrays of all sizes stand one after another
        at = F.when(F.col("gram") == g, F.col("at") - runs).otherwise(at)
        runs = runs + F.greatest(F.lit(0), F.col("size") - g + 1)
    candidates = places.select(*row, (at - F.col("offset")).alias("start"), "n", "size").filter("start >= 0 and start + n <= size").drop("size")
    by_doc = candidates.groupBy(*row).agg(F.collect_set(F.struct("start", "n")).alias("candidates"))
    by_doc = common.broadcast_if_small(common.materialize(by_doc, "benchmark-candidates"), BROADCAST_ROWS)

    again = texts.join(by_doc, row).select(*row, words(F.col("text")).alias("words"), "candidates")
    found = again.select(*row, F.explode(F.transform("candidates", lambda c: F.struct(c.start.alias("start"), F.slice("words", c.start + 1, c.n).alias("window")))).alias("c"))
    whole = found.select(*row, "c.start", "c.window").join(common.broadcast_if_small(cut.select("window", "n"), BROADCAST_ROWS), "window")
    whole = common.materialize(whole.distinct(), "benchmark-hits")

    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))),
        F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("hit")),
        lambda acc, x: F.struct(F.greatest(acc.reach, x.end).alias("reach"), (acc.hit + F.greatest(F.lit(0), x.end - F.greatest(x.start, acc.reach))).alias("hit")),
        lambda acc: acc.hit,
    )
    hit = whole.groupBy(*row).agg(covered.alias("n_hit"))
    pairs = whole.select(*row, "window").distinct().join(common.broadcast_if_small(listed.select("window", "item_id"), BROADCAST_ROWS), "window").select(*row, "item_id")
    held = pairs.groupBy(*row).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    counted = own.select(*row, F.coalesce(F.size(words(F.col("text"))).cast("long"), F.lit(0).cast("long")).alias("n_words"))
    judged = common.broadcast_if_small(common.materialize(hit.join(held, row), "benchmark-judged"), BROADCAST_ROWS)
    out = counted.join(judged, row, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), "text_key",
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all documents against all benchmark items."""
    return contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("text_key")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[s : s + n - 1], ' ') AS win
        FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS s FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, sizes WHERE len(ws) >= n),
hit AS (SELECT doc_id, p.s, p.n, item_id FROM (SELECT doc_id, s, n, array_to_string(ws[s : s + n - 1], ' ') AS win FROM place) p JOIN win USING (n, win)),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS at FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
