"""Deterministic sharded WARC writer and reader.

Shards are ranges of ids of about equal weight. Their bounds are quantiles of the
ids whose hash is small, so that they depend on the table alone, not on how Spark
deals its rows out. A task sorts the records of its shards, writes them as gzip
members and starts a new file with each shard, and when the compressed size passes a
bound, so that the same table always gives the same bytes. Each file is written under
a temporary name and renamed to a name that holds its digest; the manifest, a
Parquet table, names the files that count, so that a repeated task or a lost
executor leaves nothing double. Records with equal payloads are stored once:
that with the largest id is the response, the others are revisits to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowmill.llm import common

ROLL_BYTES = 64 << 20
#: Weight of a shard (bytes of html, and of overhead for each row), and bounds of the number of shards.
SHARD_BYTES, ROW_BYTES, LEAST_SHARDS, MOST_SHARDS = 256 << 20, 512, 32, 16_384
#: Bounds are found from about so many distinct ids, four for each shard at least.
SAMPLE_IDS = 65_536
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"  # fixed, so that the bytes depend on the table alone
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "path string, part int, file int, records long, bytes long, sha256 string"


def _base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _record_id(kind: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{key}')}>"


def _clean(url: str | None) -> str:
    """A URL fit for a header line."""
    return "".join(c for c in (url or "") if c not in "\r\n")


def _member(head: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    raw = f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _record(key: object, url: str | None, payload: bytes, digest: str, refers: object, copy: int) -> bytes:
    """One record with headers made anew from the row; ``copy`` numbers rows of the same id and payload."""
    name = "" if key is None else str(key)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", _record_id("record", f"{name}:{digest}:{copy}")),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Source-Key", name),
        ("WARC-Block-Digest", f"sha1:{_base32_sha1(block)}"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id("record", f"{refers}:{digest}:0")), ("WARC-Refers-To-Key", refers)]
    return _member([*head, ("Content-Type", "application/http; msgtype=response")], block)


def plan(marked: DataFrame, least_bytes: int = 0) -> DataFrame:
    """id, digest, refers: the revisits among rows of id, digest and n (bytes of the payload).

    The largest id of a digest is found by an aggregate that combines before it
    shuffles, and joined back by a join that splits a hot digest. Rows that repeat
    both the id and the payload of a response are responses as well; a null id is
    always a response.
    """
    usable = marked.filter((F.col("n") >= least_bytes) & F.col("id").isNotNull()).select("id", "digest")
    first = usable.groupBy("digest").agg(F.max("id").alias("refers"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    return usable.join(common.materialize(first, "warc-responses"), "digest").filter("id <> refers").distinct()


def bounds(marked: DataFrame) -> list[float]:
    """Inner bounds of the shards, ascending: weighted quantiles of the ids of small hash.

    At most a few times ``SAMPLE_IDS`` distinct ids reach the driver, however many
    rows repeat one of them.
    """
    weight = F.col("n") + ROW_BYTES
    total, rows = marked.agg(F.sum(weight), F.count("*")).first()
    shards = min(MOST_SHARDS, max(LEAST_SHARDS, -(-(total or 0) // SHARD_BYTES)))
    one_in = max(1, (rows or 0) // max(SAMPLE_IDS, 4 * shards))
    seen = marked.filter(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0)).groupBy("id").agg(F.sum(weight).alias("w")).collect()
    seen = sorted((float(r.id), r.w) for r in seen)
    every, out, passed = sum(w for _, w in seen) / shards, [], 0
    for key, w in seen:
        if passed >= every * (len(out) + 1) and (not out or key > out[-1]):
            out.append(key)
        passed += w
    return out


def write(pages: DataFrame, target: str, roll_bytes: int = ROLL_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record per row; return the manifest.

    Ids are whole numbers. A null html is an empty payload and a null url an empty
    one. Where an id is repeated, each row is stored or revisits by its own payload.
    Rows of a null id come first. Other columns are ignored; an empty table gives no file.
    """
    spark = pages.sparkSession
    n = common.partitions(spark)
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    marked = common.materialize(own.select("id", F.sha1(payload).alias("digest"), F.length(payload).alias("n")), "warc-digests")
    revisits = plan(marked, least_bytes)
    rows = own.select("id", F.sha1(payload).alias("digest"), F.lit(1).alias("order"), "url", "html", F.lit(None).cast("long").alias("refers")).unionByName(
        revisits.select("id", "digest", F.lit(0).alias("order"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers")
    )  # so that one shuffle brings a row and its decision together
    splits = [float("-inf"), *bounds(marked), float("inf")]
    rows = rows.withColumn("at", F.coalesce(F.col("id").cast("double"), F.lit(-1e300)))
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="at", outputCol="shard").transform(rows)
    else:
        rows = rows.withColumn("shard", F.lit(0.0))
    rows = rows.select(F.col("shard").cast("int").alias("shard"), "id", "digest", "order", "url", "html", "refers")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, folder = common.filesystem(target)
        task, part, number, known, last, copy = TaskContext.get().partitionId(), -1, 0, None, None, 0
        out, temp, size, count, sha = None, "", 0, 0, hashlib.sha256()

        def close() -> pa.RecordBatch:
            nonlocal out, number
            out.close()
            path = f"{folder}/part-{part:06d}-{number:04d}-{sha.hexdigest()[:16]}.warc.gz"
            fs.move(temp, path)
            row = {"path": [path], "part": pa.array([part], pa.int32()), "file": pa.array([number], pa.int32()), "records": [count], "bytes": [size], "sha256": [sha.hexdigest()]}
            out, number = None, number + 1
            return pa.RecordBatch.from_pydict(row)

        for shard, key, digest, order, url, html, refers in common.rows(batches):
            if shard != part:
                if out is not None:
                    yield close()
                part, number = shard, 0
            if not order:
                known = (key, digest, refers)
                continue
            copy = copy + 1 if last == (key, digest) else 0
            last = (key, digest)
            payload = (html or "").encode("utf-8", "surrogatepass")
            refers = known[2] if known is not None and key is not None and known[:2] == last else None
            data = _record(key, url, payload, _base32_sha1(payload), refers, copy)
            if out is None:
                fs.create_dir(folder, recursive=True)
                temp, size, count, sha = f"{folder}/.tmp-{task:06d}-{uuid.uuid4().hex}", 0, 0, hashlib.sha256()
                out = fs.open_output_stream(temp, compression=None)
                first = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id("file", f"{part}-{number}")), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                out.write(first)
                sha.update(first)
                size += len(first)
            out.write(data)
            sha.update(data)
            size, count = size + len(data), count + 1
            if size >= roll_bytes:
                yield close()
        if out is not None:
            yield close()

    ordered = rows.repartition(n, "shard").sortWithinPartitions("shard", "id", "digest", "order", "url")
    ordered.mapInArrow(save, _MANIFEST).write.parquet(f"{target}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{target}/manifest")


def _members(f, step: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one gzip member at a time."""
    rest, z, parts = b"", zlib.decompressobj(31), []
    while True:
        data = rest or f.read(step)
        if not data:
            return
        parts.append(z.decompress(data))
        rest = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    return fields, block[: int(fields["Content-Length"])]


def read(manifest: DataFrame, target: str) -> DataFrame:
    """page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to."""
    n = common.partitions(manifest.sparkSession)
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = common.filesystem(target)
        out: list[tuple] = []
        for (path,) in common.rows(batches):
            with fs.open_input_stream(path, compression=None) as f:
                for member in _members(f):
                    fields, block = parse(member)
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    if fields["WARC-Block-Digest"] != f"sha1:{_base32_sha1(block)}" or (not revisit and (len(payload), _base32_sha1(payload)) != (size, digest)):
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']} in {path}")
                    key, refers = fields.get("WARC-Source-Key", ""), fields.get("WARC-Refers-To-Key")
                    out.append((int(key) if key else None, fields["WARC-Target-URI"], None if revisit else payload, size, digest, fields["WARC-Type"], int(refers) if refers else None))
                    if len(out) >= 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return manifest.repartitionByRange(n, "part", "file").select("path").mapInArrow(load, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: write all pages as WARC files and return what is read back from them."""
    target = common.scratch_path(spark, "warc")
    manifest = write(common.table(spark, sf_dir, "pages"), target)
    return read(manifest, target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response FROM pages),
h AS (SELECT page_id, response, strlen(payload) AS n, list_transform(string_split(sha1(payload), ''), lambda c: instr('0123456789abcdef', c) - 1) AS x FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((x[i * 5 // 4 + 1] * 16 + x[i * 5 // 4 + 2]) >> CAST(3 - (i * 5) % 4 AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM h
"""
