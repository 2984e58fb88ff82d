"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowmill.llm import common
from windowmill.llm.tokens import encoder

CAPACITY = 2048
OPEN_BINS = 16_384
LOOK_AHEAD = 65_536


class BestFit:
    """Open bins in a bitset keyed by free space.

    A piece goes to the bin with the least free space that holds it: the lowest
    set bit at or above its length. When the fixed number of open bins is
    reached, the fullest closes.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it."""
        above = self.bits >> length
        if above:
            room = length + (above & -above).bit_length() - 1
            bin_ = self._take(room)
        else:
            if self.open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            room, bin_ = self.capacity, self.made
            self.made += 1
        if room > length:
            self.free[room - length].append(bin_)
            self.bits |= 1 << (room - length)
            self.open += 1
        return bin_, self.capacity - room

    def _take(self, room: int) -> int:
        bin_ = self.free[room].pop()
        self.open -= 1
        if not self.free[room]:
            self.bits ^= 1 << room
        return bin_


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode whole texts, append the end id and cut what is longer than a sequence.

    A null or empty text is a piece of one id. Null and repeated ids are kept as
    they are; other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = encoder(tokenizer).encode, struct.pack("<I", end_id), 4 * capacity
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                ids = encode(text) + end
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    out.append((doc, k // step, k // 4, len(part) // 4, zlib.crc32(part), *((part,) if keep_ids else ())))
            cols = list(zip(*out, strict=True)) or [()] * (5 + keep_ids)
            kinds = [batch[0].type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: len(cols)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def pack(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """Add sequence_id and offset to rows with a length of 1 to the capacity.

    Rows are dealt out by hash to partitions that the data's size decides, so
    that a partition holds many pieces and few sequences stay half full; each
    partition packs alone, in the order of another hash, so that a task that runs
    again gives the same sequences. Pieces wait in a bounded block, where longer ones
    go first, and blocks follow one another through the same open bins. Memory is
    one block and the open bins whatever the size of a partition. An empty table
    gives no row.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40

        def placed(block: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(block).combine_chunks()
            length = whole["length"].to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for i in np.argsort(-length, kind="stable"):
                seq[i], off[i] = bins.place(int(length[i]))
            return whole.append_column("sequence_id", pa.array(seq + base)).append_column("offset", pa.array(off)).combine_chunks().to_batches()[0]

        block, n = [], 0
        for batch in batches:
            block.append(batch)
            n += len(batch)
            if n >= look_ahead:
                yield placed(block)
                block, n = [], 0
        if n:
            yield placed(block)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    row = ["doc_id", "piece", "start", "ids_crc32"]
    dealt = parts.repartition(F.hash(*row)).sortWithinPartitions(F.xxhash64(*row), *row)
    return dealt.mapInArrow(fill, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, tokenizer, end_id, capacity), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all documents in sequences of at most 2,048 tokens."""
    import public_tokenizers

    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0)
