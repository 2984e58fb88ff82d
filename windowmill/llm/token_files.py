"""Token-ID files: patched frame-of-reference blocks in document order.

A file holds groups of blocks. A block is 1,024 ids: its minimum is subtracted,
the differences are packed at the bit width of their 90th percentile, larger
ones keep their low bits there and go with their position to an exception list.
Each group starts with an index of its blocks (minimum, width, exceptions,
start), so that one block can be read alone. The footer lists the documents.
Files are written under a temporary name and renamed; the manifest, a Parquet
table, names the files that count, so that a repeated task leaves no double.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windowmill.llm import common
from windowmill.llm.tokens import encoder

BLOCK = 1024
GROUP_BLOCKS = 256
PERCENTILE = 90
MAGIC = b"PFORIDS1"
_INDEX = np.dtype([("low", "<u4"), ("width", "u1"), ("patches", "<u2"), ("start", "<u4")])
_LANES = BLOCK // 64


def _bits(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(k, 1024) values below 2**width to (k, width * 16) words of 64 bits."""
    v = values.reshape(len(values), 64, _LANES).astype(np.uint64)
    out = np.zeros((len(values), width, _LANES), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[:, word] |= v[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, i] >> np.uint64(64 - shift)
    return out.reshape(len(values), width * _LANES)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = words.reshape(len(words), width, _LANES)
    out = np.empty((len(words), 64, _LANES), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[:, i] = w[:, word] >> np.uint64(shift)
        if shift + width > 64:
            out[:, i] |= w[:, word + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << width) - 1)).reshape(len(words), BLOCK).astype(np.uint32)


def encode_group(ids: np.ndarray) -> bytes:
    """Pack up to 256 blocks; the last is filled up with its own last id."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    full = np.concatenate([ids, np.full(blocks * BLOCK - n, ids[-1], np.uint32)]).reshape(blocks, BLOCK)
    low = full.min(axis=1)
    over = full - low[:, None]
    rank = (BLOCK - 1) * PERCENTILE // 100
    width = _bits(np.partition(over, rank, axis=1)[:, rank])
    patched = _bits(over) > width[:, None]
    index = np.zeros(blocks, _INDEX)
    index["low"], index["width"], index["patches"] = low, width, patched.sum(axis=1)
    bodies: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        if w:
            packed = _pack(over[at] & np.uint32((1 << int(w)) - 1), int(w))
            for k, b in enumerate(at):
                bodies[b] = packed[k].tobytes()
    for b in np.flatnonzero(index["patches"]):
        at = np.flatnonzero(patched[b])
        bodies[b] += at.astype("<u2").tobytes() + over[b, at].astype("<u4").tobytes()
    index["start"] = np.cumsum([0, *map(len, bodies[:-1])])
    body = b"".join(bodies)
    return struct.pack("<III", n, blocks, len(body)) + index.tobytes() + body


def decode_group(f) -> np.ndarray:
    """The ids of the group at the reader's position; empty at the footer."""
    n, blocks, size = struct.unpack("<III", f.read(12))
    index = np.frombuffer(f.read(blocks * _INDEX.itemsize), _INDEX)
    body = f.read(size)
    out = np.zeros((blocks, BLOCK), np.uint32)
    width = index["width"]
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        words = np.stack([np.frombuffer(body, "<u8", int(w) * _LANES, int(index["start"][b])) for b in at])
        out[at] = _unpack(words, int(w))
    for b in np.flatnonzero(index["patches"]):
        k, at = int(index["patches"][b]), int(index["start"][b]) + int(width[b]) * _LANES * 8
        out[b, np.frombuffer(body, "<u2", k, at)] = np.frombuffer(body, "<u4", k, at + 2 * k)
    return (out + index["low"][:, None]).reshape(-1)[:n]


_MANIFEST = "path string, part int, docs long, ids long, bytes long"


def write(docs: DataFrame, target: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents in ascending order of id; return the manifest.

    Range partitions keep the order across files; each task streams its rows, so
    that its memory is one group of blocks, one document, and for each document of
    the task its id and its count for the footer. A null or empty text has the end id
    only; rows of a null id come first; rows of equal ids follow one another by their
    text, so that each has one place. Other columns are ignored. An empty table gives
    no file.
    """
    n = common.partitions(docs.sparkSession)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(tokenizer).encode, struct.pack("<I", end_id)
        fs, folder = common.filesystem(target)
        part = TaskContext.get().partitionId()
        names, counts, kept, size, total, out, temp = [], [], [], 0, 0, None, ""
        limit = BLOCK * GROUP_BLOCKS * 4

        def flush(last: bool) -> None:
            nonlocal kept, size
            raw = b"".join(kept)
            cut = len(raw) if last else len(raw) // limit * limit
            for a in range(0, cut, limit):
                out.write(encode_group(np.frombuffer(raw[a : min(a + limit, cut)], "<u4")))
            kept, size = [raw[cut:]], len(raw) - cut

        for doc, text in common.rows(batches):
            if out is None:
                fs.create_dir(folder, recursive=True)
                temp = f"{folder}/.tmp-{part:06d}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(temp, compression=None)
                out.write(MAGIC)
            ids = encode(text) + end
            names.append(doc)
            counts.append(len(ids) // 4)
            kept.append(ids)
            size += len(ids)
            total += len(ids) // 4
            if size >= limit:
                flush(False)
        if out is None:
            return
        if size:
            flush(True)
        sink = io.BytesIO()
        footer = pa.table({"id": pa.array(names), "ids": pa.array(counts, pa.int64())})
        with pa.ipc.new_stream(sink, footer.schema) as w:
            w.write_table(footer)
        out.write(struct.pack("<III", 0, 0, 0) + sink.getvalue())
        length = out.tell()
        out.close()
        path = f"{folder}/ids-{part:06d}-{temp[-32:]}.pfor"
        fs.move(temp, path)
        yield pa.RecordBatch.from_pydict({"path": [path], "part": pa.array([part], pa.int32()), "docs": [len(names)], "ids": [total], "bytes": [length]})

    ordered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(save, _MANIFEST).write.parquet(f"{target}/manifest")
    return docs.sparkSession.read.schema(_MANIFEST).parquet(f"{target}/manifest")


def read(manifest: DataFrame, target: str, id_type: str = "long") -> DataFrame:
    """Read the files of a manifest: id, start, ids as bytes, one row per document."""
    n = common.partitions(manifest.sparkSession)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = common.filesystem(target)
        for path, start in common.rows(batches):
            with fs.open_input_file(path) as f:
                if f.read(len(MAGIC)) != MAGIC:
                    raise ValueError(f"not a token-ID file: {path}")
                tail = _footer(f)
                f.seek(len(MAGIC))
                left = np.empty(0, np.uint32)
                out: list[tuple] = []
                for doc, count in zip(tail["id"].to_pylist(), tail["ids"].to_pylist(), strict=True):
                    parts, have = [left], len(left)
                    while have < count:
                        parts.append(decode_group(f))
                        have += len(parts[-1])
                    ids = np.concatenate(parts) if len(parts) > 1 else left
                    left = ids[count:]
                    out.append((doc, start, ids[:count].tobytes()))
                    start += count
                    if len(out) >= 512:
                        yield _batch(out, tail["id"].type)
                        out = []
                if out:
                    yield _batch(out, tail["id"].type)

    files = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"), "part")
    dealt = files.repartitionByRange(n, "part").select("path", "start")
    return dealt.mapInArrow(load, f"id {id_type}, start long, ids binary")


def _batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    doc, start, ids = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, kind), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], ["id", "start", "ids"])


def _footer(f) -> pa.Table:
    while True:
        n, blocks, size = struct.unpack("<III", f.read(12))
        if not n:
            return pa.ipc.open_stream(io.BytesIO(f.read())).read_all()
        f.seek(f.tell() + blocks * _INDEX.itemsize + size)


def crc32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["ids"].to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["start"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
        )


def query(spark, sf_dir: str) -> DataFrame:
    """op8: write documents as token-ID files and return what is read back from them."""
    import public_tokenizers

    target = common.scratch_path(spark, "token-ids")
    manifest = write(common.table(spark, sf_dir, "documents"), target, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read(manifest, target).mapInArrow(crc32, "doc_id long, start long, n_tokens long, ids_crc32 long")
