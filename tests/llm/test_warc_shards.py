"""WARC files: payloads of repeated ids, and the same bytes whatever the partitions."""

from pyspark.sql import functions as F

from windowmill.llm import warc


def digests(manifest):
    return sorted((r.part, r.file, r.records, r.sha256) for r in manifest.collect())


def test_each_payload_of_an_id_is_stored(spark, tmp_path):
    rows = [(5, "u", "A" * 50), (5, "u", "BBBB only here"), (6, "u", "A" * 50), (6, "u", "A" * 50), (None, "u", "A" * 50), (7, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("id", "digest", "n", "shard", "at", "order", "refers")})
    target = f"file://{tmp_path}/a"
    found = warc.read(warc.write(pages, target), target).collect()
    seen = sorted((-1 if r.page_id is None else r.page_id, r.record_type, r.refers_to, r.payload if r.payload is None else bytes(r.payload)) for r in found if r.page_id != 5)
    assert seen == [(-1, "response", None, b"A" * 50), (6, "response", None, b"A" * 50), (6, "response", None, b"A" * 50), (7, "response", None, b"")]
    five = {r.payload_bytes: (r.record_type, r.refers_to, r.payload if r.payload is None else bytes(r.payload)) for r in found if r.page_id == 5}
    assert five == {50: ("revisit", 6, None), 14: ("response", None, b"BBBB only here")}


def test_same_bytes_from_any_partitions(spark, tmp_path):
    pages = spark.range(50_000).select((F.col("id") * 3 - 7).alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("text "), F.pmod(F.xxhash64("id"), F.lit(20_000)), F.repeat(F.lit(" word"), (F.col("id") % 40).cast("int"))).alias("html"))
    pages = pages.union(spark.createDataFrame([(2**60, "far", "x"), (-(2**60), "far", "y")], pages.schema))
    first = digests(warc.write(pages, f"file://{tmp_path}/a", roll_bytes=20_000))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = digests(warc.write(pages.repartition(13), f"file://{tmp_path}/b", roll_bytes=20_000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first == again and sum(r[2] for r in first) == 50_002
    per = {}
    for part, _, records, _ in first:
        per[part] = per.get(part, 0) + records
    assert len(per) == warc.LEAST_SHARDS and max(per.values()) < 3 * 50_002 / warc.LEAST_SHARDS
